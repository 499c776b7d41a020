"""Key prefixes, list sizes and defaults shared by all jobs."""

# Key prefixes. Stores written by an earlier system keep working.
ITEM_FEATURE_PREFIX = "animeF:"
USER_FEATURE_PREFIX = "userF:"
TAG_PREFIX = "tag:"
ITEM_EMBEDDING_PREFIX = "animeEmb:"
USER_EMBEDDING_PREFIX = "userEmb:"
USER_RECS_PREFIX = "userRec:"
SIMILAR_ITEMS_PREFIX = "simAnime:"
SIMILAR_USERS_PREFIX = "simUser:"

# List sizes and lifetimes. Fixed values.
RECALL_SIZE = 300
MAX_RECOMMENDATIONS = 1000
MAX_SIMILAR_ITEMS = 2000
POPULAR_SIZE = 5000
SEARCH_SIZE = 10
RECOMMENDATION_TTL_SECONDS = 300

# Sample and feature rules. Fixed values.
POSITIVE_RATING = 6
UNRATED = 0
HISTORY_ROWS = 100
HISTORY_SHOWN = 5
ITEM_TAGS_SHOWN = 3
USER_TAGS_SHOWN = 5
DECIMALS = 2
DEFAULT_RELEASE_YEAR = 1990
TRAIN_SHARE = 0.8
SPLIT_ERROR = 0.05
MIN_TAG_COUNT = 1

# Encodings of the rankers. Fixed values.
USER_ID_BUCKETS = 600000
ITEM_ID_BUCKETS = 323877
CROSS_BUCKETS = 10000

# Item embedding training and bucketing. Fixed values.
EMBEDDING_SIZE = 20
EMBEDDING_WINDOW = 5
EMBEDDING_ITERATIONS = 10
LSH_BUCKET_LENGTH = 0.1
LSH_TABLES = 3
NEIGHBOURS = 5

# Scale defaults (ours). A key with more rows than HOT_KEY_ROWS is worked on in
# pieces of about CHUNK_ROWS rows instead of in one task.
HOT_KEY_ROWS = 1_000_000
CHUNK_ROWS = 500_000
# Longest piece of a user's sequence kept in one row; Word2Vec cuts longer ones
# at the same length anyway.
SEQUENCE_ROWS = 1000
# Sentences one task of a training pass reads.
SENTENCES_PER_SHARD = 20_000
# Item vectors per scoring block and query vectors per scoring block.
ITEM_BLOCK_ROWS = 4096
QUERY_BLOCK_ROWS = 1024
# Largest tag vocabulary handed to an encoder.
MAX_VOCABULARY = 1_000_000
# Item vectors up to this size travel to the tasks whole; each worker and the driver hold a copy.
RESIDENT_BYTES = 16 * 1024 * 1024
# Queries that one task scores while all items go past, and the most best rows it keeps for them.
QUERY_CHUNK_ROWS = 4096
CHUNK_KEYS = 4_000_000
# Queries one task scores against one item block.
QUERIES_PER_TASK = 100_000
# Stored length of similar-user lists (ours; readers ask for fewer).
MAX_SIMILAR_USERS = 1000
# Key lists of up to this many rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
