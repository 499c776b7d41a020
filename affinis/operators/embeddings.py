"""Item sequences, item vectors, user vectors and hash buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import (
    BucketedRandomProjectionLSH,
    BucketedRandomProjectionLSHModel,
    Word2Vec,
    Word2VecModel,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vector
from pyspark.sql import DataFrame, functions as F

from affinis import settings
from affinis.operators import pieces
from affinis.session import settled


def item_sequences(
    interactions: DataFrame,
    order: Sequence[str] = ("ts", "event_id"),
    user: str = "user_id",
    item: str = "item_id",
    length: int = settings.SEQUENCE_ROWS,
    hot_rows: int = settings.HOT_KEY_ROWS,
    piece_rows: int = settings.CHUNK_ROWS,
    min_count: int = 1,
) -> DataFrame:
    """Each user's items, newest first, in segments of at most ``length``.

    Training drops items of fewer than its minimum count and then cuts a longer
    sequence at the same length. With that ``min_count`` given here, segments
    give the training the same sentences without a whole user in one row.
    """
    if min_count > 1:
        often = interactions.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count).select(item)
        interactions = interactions.join(often, item, "left_semi")
    back = [f"_back_{i}" for i in range(len(order))]
    keyed = interactions.select(user, item, *[_descending(interactions, c).alias(b) for c, b in zip(order, back)])
    numbered = pieces.row_numbers(keyed, user, back, "_at", hot_rows, piece_rows)
    segment = F.floor((F.col("_at") - 1) / length).cast("int").alias("segment")
    gathered = numbered.groupBy(user, segment).agg(
        F.array_sort(F.collect_list(F.struct("_at", F.col(item).cast("string").alias("item")))).alias("_rows")
    )
    return gathered.select(user, "segment", F.transform("_rows", lambda r: r["item"]).alias("items"))


def _descending(df: DataFrame, column: str):
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return -F.unix_micros(F.col(column).cast("timestamp"))
    if kind == "string":
        return -F.unix_micros(F.col(column).try_cast("timestamp"))
    return -F.col(column)


def train_item2vec(
    sequences: DataFrame,
    size: int = settings.EMBEDDING_SIZE,
    window: int = settings.EMBEDDING_WINDOW,
    iterations: int = settings.EMBEDDING_ITERATIONS,
    min_count: int = 5,
    partitions: int | None = None,
    seed: int = 42,
    column: str = "items",
) -> Word2VecModel:
    """Skip-gram vectors of items from their neighbours in user sequences.

    ``partitions`` trains that many shards side by side and averages them each
    iteration; by default it follows the number of sequences. The vocabulary is
    the catalogue, not the interactions.
    """
    # Counted, then read by each pass.
    sequences = settled(sequences.select(column))
    partitions = partitions or shards(sequences.count(), sequences.sparkSession.sparkContext.defaultParallelism)
    return Word2Vec(
        vectorSize=size,
        windowSize=window,
        maxIter=iterations,
        minCount=min_count,
        numPartitions=partitions,
        maxSentenceLength=settings.SEQUENCE_ROWS,
        seed=seed,
        inputCol=column,
        outputCol="_mean",
    ).fit(sequences)


def shards(sentences: int, slots: int = 1) -> int:
    """Shards to train in: one per so many sentences, and more up to whole rounds of the cluster's slots,
    of which each still has a quarter of them."""
    n = max(1, -(-sentences // settings.SENTENCES_PER_SHARD))
    return max(n, min(-(-n // slots) * slots, 4 * sentences // settings.SENTENCES_PER_SHARD))


def item_vectors(model: Word2VecModel) -> DataFrame:
    return model.getVectors().select(
        F.col("word").cast("long").alias("id"), vector_to_array("vector").alias("emb")
    )


def user_vectors(
    interactions: DataFrame,
    embeddings: DataFrame,
    weight=None,
    user: str = "user_id",
    item: str = "item_id",
) -> DataFrame:
    """Mean item vector per user.

    The denominator counts every interaction, also those of items that have no
    vector; users left without any vector at all are dropped. Repeats of an
    item are added up before the join. Each vector position is one plain sum,
    which stays in generated code and is combined before the shuffle.

    ``weight`` is an expression over an interaction; by default each counts 1.
    """
    w = F.lit(1.0) if weight is None else weight
    known = embeddings.where(F.col("emb").isNotNull()).select(F.col("id").alias(item), F.col("emb").alias("_emb"))
    width = embeddings.agg(F.coalesce(F.max(F.size("emb")), F.lit(0))).first()[0]
    totals = interactions.groupBy(F.col(user).alias("_user")).agg(F.sum(w).alias("_total"))
    # Items without a vector count in the total alone; the wide sums see only the others.
    pairs = interactions.join(known.select(item), item, "left_semi").groupBy(user, item).agg(F.sum(w).alias("_w"))
    sums = pairs.join(known, item).groupBy(user).agg(
        F.count(F.lit(1)).alias("_pairs"),
        *[F.sum(F.get("_emb", F.lit(i)) * F.col("_w")).alias(f"_sum_{i}") for i in range(width)],
    ).join(totals, F.col(user).eqNullSafe(F.col("_user")))
    mean = [F.try_divide(F.coalesce(f"_sum_{i}", F.lit(0.0)), F.col("_total")) for i in range(width)]
    return sums.select(F.col(user).alias("id"), F.array(*mean).alias("emb"))


def recency_weight(as_of, ts: str = "ts", rating: str = "rating", half_life_days: float = 90.0):
    """Weight of an interaction: its rating times an exponential decay by age.

    Unrated collections weigh like a rating at the liking threshold.
    """
    age = (F.unix_micros(as_of) - F.unix_micros(F.col(ts))) / F.lit(86_400_000_000.0)
    given = F.when(F.col(rating) > settings.UNRATED, F.col(rating)).otherwise(settings.POSITIVE_RATING)
    return given * F.exp(-age / half_life_days)


def fit_buckets(
    embeddings: DataFrame,
    bucket_length: float = settings.LSH_BUCKET_LENGTH,
    tables: int = settings.LSH_TABLES,
    seed: int = 42,
) -> BucketedRandomProjectionLSHModel:
    return BucketedRandomProjectionLSH(
        inputCol="vector", outputCol="bucket_ids", bucketLength=bucket_length, numHashTables=tables, seed=seed
    ).fit(as_vectors(embeddings))


def as_vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("id", array_to_vector("emb").alias("vector"))


def bucket(model: BucketedRandomProjectionLSHModel, embeddings: DataFrame) -> DataFrame:
    """Hash bucket of each vector in each table."""
    hashed = model.transform(as_vectors(embeddings))
    return hashed.select(
        "id", F.transform("bucket_ids", lambda v: F.get(vector_to_array(v), F.lit(0)).cast("long")).alias("buckets")
    )


def nearest(
    model: BucketedRandomProjectionLSHModel, embeddings: DataFrame, key: Vector, n: int = settings.NEIGHBOURS
) -> DataFrame:
    """The ``n`` vectors nearest to one given vector, among those sharing a bucket."""
    found = model.approxNearestNeighbors(as_vectors(embeddings), key, n, distCol="distance")
    return found.select("id", "distance")
