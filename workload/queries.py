"""Every operator as a query over a folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from affinis import schemas, session, settings
from affinis.functions import arrays, text, vectors
from affinis.operators import (
    embeddings,
    encoders,
    features,
    history,
    lists,
    payload,
    rankers,
    samples,
    search,
)
from affinis.operators.latest import latest_per_key
from affinis.plans import features as feature_plan, recommend as rec
from affinis.session import settled, shared_path
from affinis.operators.day_sketches import DaySketches
from affinis.operators.neighbour_graph import neighbour_graph, recall_of as graph_recall
from affinis.operators.text_index import TextIndex
from affinis.operators.tiles import top_k_tiles
from affinis.sources import collections, embedding_text, index, keyvalue, samples_csv
from affinis.sources.buckets import BucketTable
from affinis.streaming import refresh, user_state
from affinis.streaming.fates import CountedIngest
from affinis.streaming.revisions import RevisionTable
from workload import tables as t

RATED = [f"user_rated_item_{i}" for i in range(1, 6)]
ITEM_TAGS = encoders.ITEM_TAGS
BIG_KEY = ["l_orderkey", "l_linenumber", "item_id", "l_suppkey", "l_extendedprice"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def micros(column: str, name: str):
    return F.unix_micros(column).alias(name)


def six(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


def stats():
    return ["user_rating_count", *six("user_avg_rating", "user_rating_stddev")]


def joined_ids(column):
    return F.concat_ws(",", F.transform(column, lambda x: x.cast("string")))


def labelled(spark, d):
    return samples.add_label(t.interactions(spark, d))


def labelled_big(spark, d):
    return samples.add_label(t.interactions_big(spark, d))


def item_columns(spark, d):
    return collections.item_columns(t.items(spark, d))


def with_items(spark, d, keep_tags=False):
    items = features.with_release_year(item_columns(spark, d))
    return features.add_item_features(labelled(spark, d), items, keep_tags)


def training(spark, d):
    return feature_plan.training_samples(t.interactions(spark, d), item_columns(spark, d))


def user_emb(spark, d):
    return embeddings.user_vectors(t.interactions(spark, d), t.item_emb(spark, d))


def recalled(spark, d, k=settings.RECALL_SIZE):
    return rec.recall(user_emb(spark, d), t.item_emb(spark, d), k, t.interactions(spark, d))


# Samples ---------------------------------------------------------------------


@query
def explode_collects(spark, d):
    docs = collections.user_columns(t.user_docs(spark, d))
    rows = samples.explode_collects(docs)
    return rows.select(
        "user_id", "item_id", "rating", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        *[f"user_tag_{i}" for i in range(1, 6)],
    )


@query
def label(spark, d):
    return labelled(spark, d).select("event_id", "rating", "label")


@query
def rating_histogram(spark, d):
    return samples.rating_histogram(t.interactions(spark, d)).select("rating", "n", *six("share"))


@query
def rating_histogram_big(spark, d):
    return samples.rating_histogram(t.interactions_big(spark, d)).select("rating", "n", *six("share"))


@query
def user_history(spark, d):
    rows = history.add_positive_history(labelled(spark, d))
    return rows.select("event_id", "user_id", joined_ids("positive_history").alias("history"))


@query
def user_history_ties(spark, d):
    rows = history.add_positive_history(labelled_big(spark, d), order=t.BIG_ORDER)
    return rows.select(
        *BIG_KEY, micros("l_shipdate", "shipdate_us"), "user_id", joined_ids("positive_history").alias("history")
    )


@query
def user_running_stats(spark, d):
    rows = history.add_running_stats(labelled_big(spark, d))
    return rows.select(*BIG_KEY, micros("l_shipdate", "shipdate_us"), "user_id", *stats())


@query
def formatted_stats(spark, d):
    rows = features.for_export(history.add_running_stats(t.interactions(spark, d)))
    return rows.select("event_id", "user_avg_rating", "user_rating_stddev")


def _training_columns(rows):
    return rows.select(
        "event_id", "user_id", "item_id", "rating", "label", micros("ts", "ts_us"), "votes", *six("score"),
        *ITEM_TAGS, *RATED, *stats(),
    )


@query
def training_samples(spark, d):
    return _training_columns(training(spark, d))


def nested_training(spark, d):
    return feature_plan.nested_samples(collections.user_columns(t.user_docs(spark, d)), item_columns(spark, d))


@query
def training_samples_nested(spark, d):
    """From collection lists to samples with the user's tags."""
    return nested_training(spark, d).select(
        "user_id", "item_id", "rating", "label", micros("ts", "ts_us"), "votes", *six("score"), *ITEM_TAGS, *RATED, *stats(),
        *encoders.USER_TAGS)


@query
def training_samples_in_pieces(spark, d):
    """The same with every user worked on in pieces."""
    rows = feature_plan.training_samples(
        t.interactions(spark, d), item_columns(spark, d), hot_rows=10, piece_rows=2000
    )
    return _training_columns(rows)


@query
def training_samples_ties(spark, d):
    rows = history.add_user_features(labelled_big(spark, d), order=t.BIG_ORDER)
    return rows.select(
        *BIG_KEY, micros("l_shipdate", "shipdate_us"), "user_id", "rating", "label", micros("ts", "ts_us"), *RATED, *stats()
    )


@query
def training_samples_ties_in_pieces(spark, d):
    rows = history.add_user_features(labelled_big(spark, d), order=t.BIG_ORDER, hot_rows=40, piece_rows=5000)
    return rows.select(
        *BIG_KEY, micros("l_shipdate", "shipdate_us"), "user_id", "rating", "label", micros("ts", "ts_us"), *RATED, *stats()
    )


@query
def release_year_stats(spark, d):
    rows = history.add_release_year_stats(with_items(spark, d))
    return rows.select("event_id", *six("user_avg_release_year", "user_release_year_stddev"))


@query
def favourite_tags(spark, d):
    rows = history.add_favourite_tags(with_items(spark, d, keep_tags=True))
    return rows.select("event_id", F.concat_ws(",", "favourite_tags").alias("tags"))


# Items and tags --------------------------------------------------------------


@query
def item_tags(spark, d):
    rows = features.with_top_tags(item_columns(spark, d))
    return rows.select(F.col("item_id").alias("id"), F.concat_ws(",", "tags").alias("tags"), *ITEM_TAGS)


@query
def tag_frequency(spark, d):
    rows = with_items(spark, d, keep_tags=True).where(F.col("label") == 1)
    return features.tag_frequency(rows, "user_id")


@query
def sample_item_join(spark, d):
    return with_items(spark, d).select(
        "event_id", "item_id", "label", "votes", *six("score"), "release_year", *ITEM_TAGS
    )


@query
def sample_item_join_big(spark, d):
    rows = features.add_item_features(labelled_big(spark, d), item_columns(spark, d))
    return rows.groupBy("item_id", "item_tag_1").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("likes"), F.max("votes").alias("votes")
    )


@query
def release_year(spark, d):
    rows = features.with_release_year(item_columns(spark, d))
    return rows.select(F.col("item_id").alias("id"), "release_year")


# Split -----------------------------------------------------------------------

SPLIT_COLUMNS = ["event_id", "user_id", "item_id", "rating", "label"]


@query
def split_train(spark, d):
    return samples.split_by_time(training(spark, d), error=0.0)[0].select(*SPLIT_COLUMNS)


@query
def split_test(spark, d):
    return samples.split_by_time(training(spark, d), error=0.0)[1].select(*SPLIT_COLUMNS)


@query
def split_point(spark, d):
    days = training(spark, d).select(text.day_millis(F.col("ts").cast("string")).alias("day"))
    return samples.split_point(days, "day", settings.TRAIN_SHARE)


@query
def split_point_sketch(spark, d):
    days = training(spark, d).select(text.day_millis(F.col("ts").cast("string")).alias("day"))
    at = samples.split_point(days, "day", settings.TRAIN_SHARE, settings.SPLIT_ERROR)
    # Rows below the point and up to it: the wanted share lies between them, give or take the error.
    share = days.join(at).agg(F.avg((F.col("day") < F.col("split_at")).cast("double")).alias("below"), F.avg((F.col("day") <= F.col("split_at")).cast("double")).alias("upto"))
    e = settings.SPLIT_ERROR
    return share.select(((F.col("below") <= settings.TRAIN_SHARE + e) & (F.col("upto") >= settings.TRAIN_SHARE - e)).alias("within_error"))


@query
def split_point_daily(spark, d):
    """The split point from stored sketches of three batches of samples, and whether it lies within the error."""
    rows = settled(training(spark, d).select("event_id", "ts"))
    sketches = DaySketches(spark, shared_path(spark, "sketches"))
    for k in range(3):
        sketches.add(rows.where(F.col("event_id") % 3 == k), "ts", k)
    at = sketches.split_point(settings.TRAIN_SHARE)
    below = F.avg((F.unix_millis("ts") < F.col("split_at")).cast("double"))
    upto = F.avg((F.unix_millis("ts") <= F.col("split_at")).cast("double"))
    e = settings.SPLIT_ERROR / 2
    return rows.join(at).groupBy("n", "sketches").agg(
        ((below <= settings.TRAIN_SHARE + e) & (upto >= settings.TRAIN_SHARE - e)).alias("within_error"))


@query
def train_csv(spark, d):
    """The exported train files read back."""
    train, _ = samples.split_by_time(training(spark, d), error=0.0)
    names = [c for c in schemas.TRAINING_SAMPLE.names if c in train.columns]
    path = shared_path(spark, "samples")
    samples_csv.write(features.for_export(train).select(*names), path)
    schema = type(schemas.TRAINING_SAMPLE)([f for f in schemas.TRAINING_SAMPLE.fields if f.name in names])
    return samples_csv.read(spark, path, schema).select(
        "user_id", "item_id", "rating", "label", "votes", *six("score"), *ITEM_TAGS, *RATED,
        "user_rating_count", "user_avg_rating", "user_rating_stddev",
    )


# Latest features and the key-value store -------------------------------------


@query
def latest_item_features(spark, d):
    rows = features.latest_item_features(training(spark, d))
    return rows.select("item_id", *ITEM_TAGS, "votes", *six("score"))


@query
def latest_user_features_nested(spark, d):
    """With the user's tags, from collection lists."""
    rows = features.latest_user_features(nested_training(spark, d), feature_plan.NESTED_ORDER)
    return rows.select("user_id", *RATED, *stats(), *encoders.USER_TAGS)


@query
def latest_user_features(spark, d):
    return features.latest_user_features(training(spark, d)).select("user_id", *RATED, *stats())


def _store(spark, d):
    """Item, user, tag and vector entries in one stored table."""
    rows = settled(training(spark, d))
    path = shared_path(spark, "kv")
    keyvalue.write(
        keyvalue.encode(features.latest_item_features(rows), settings.ITEM_FEATURE_PREFIX, "item_id")
        .unionByName(keyvalue.encode(features.latest_user_features(rows), settings.USER_FEATURE_PREFIX, "user_id"))
        .unionByName(keyvalue.encode_tags(t.items(spark, d)))
        .unionByName(keyvalue.encode_vectors(t.item_emb(spark, d), settings.ITEM_EMBEDDING_PREFIX)),
        path,
    )
    return spark.read.schema(schemas.KEY_VALUE).parquet(path)


@query
def kv_point_read(spark, d):
    asked = t.read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    got = keyvalue.point_read(_store(spark, d), asked, settings.ITEM_FEATURE_PREFIX)
    rows = keyvalue.decode_json(got.withColumn("found", F.col("value").isNotNull()), schemas.ITEM_FEATURES)
    return rows.select("id", "found", *ITEM_TAGS, "votes", *six("score"))


USER_STORED = type(schemas.USER_FEATURES)(
    [f for f in schemas.USER_FEATURES.fields if not f.name.startswith("user_tag")]
)


@query
def kv_prefix_scan(spark, d):
    got = keyvalue.prefix_scan(_store(spark, d), settings.USER_FEATURE_PREFIX)
    return keyvalue.decode_json(got, USER_STORED).select("id", *RATED, *stats())


@query
def kv_prefix_count(spark, d):
    return keyvalue.prefix_count(_store(spark, d), settings.ITEM_EMBEDDING_PREFIX)


@query
def kv_vectors(spark, d):
    pairs = keyvalue.encode_vectors(t.item_emb(spark, d), settings.ITEM_EMBEDDING_PREFIX)
    rows = keyvalue.decode_vectors(keyvalue.prefix_scan(pairs, settings.ITEM_EMBEDDING_PREFIX))
    total = F.aggregate("emb", F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", F.size("emb").cast("long").alias("dims"), F.round(total, 6).alias("total"))


@query
def tag_map(spark, d):
    pairs = keyvalue.encode_tags(t.items(spark, d))
    rows = keyvalue.decode_tags(keyvalue.prefix_scan(pairs, settings.TAG_PREFIX))
    return rows.select("id", F.explode("tags").alias("tag", "n"))


def _eligible(spark, d):
    rows, order = settled(nested_training(spark, d)), feature_plan.NESTED_ORDER
    found = recalled(spark, d).select("user_id", "item_id", "rank")
    return payload.assemble(
        found, features.latest_item_features(rows, order), features.latest_user_features(rows, order)
    )


PAYLOAD = ["votes", "score", *ITEM_TAGS, "user_rating_count", "user_avg_rating", "user_rating_stddev", "user_rated_item_1", *encoders.USER_TAGS]


@query
def score_payload(spark, d):
    """The JSON per user, decoded again to compare its fields."""
    sent = payload.score_payload(_eligible(spark, d), PAYLOAD)
    instance = (
        "user_id long, item_id long, votes long, score double, item_tag_1 string, item_tag_2 string, "
        "item_tag_3 string, user_rating_count long, user_avg_rating double, user_rating_stddev double, "
        "user_rated_item_1 long, user_tag_1 string, user_tag_2 string, user_tag_3 string, user_tag_4 string, user_tag_5 string"
    )
    parsed = F.from_json("payload", f"instances array<struct<{instance.replace(' ', ':').replace(',:', ',')}>>")
    rows = sent.select("user_id", F.posexplode(parsed["instances"]).alias("position", "i"))
    return rows.select(
        "user_id", "position", "i.item_id", "i.votes", F.round("i.score", 6).alias("score"), *[f"i.{c}" for c in ITEM_TAGS],
        "i.user_rating_count", F.round("i.user_avg_rating", 6).alias("user_avg_rating"),
        F.round("i.user_rating_stddev", 6).alias("user_rating_stddev"), "i.user_rated_item_1", *[f"i.{c}" for c in encoders.USER_TAGS],
    )


@query
def score_parse(spark, d):
    """Answers in candidate order, read back and joined by position."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("user_id").orderBy("rank")) - 1
    sent = settled(_eligible(spark, d).withColumn("position", at).select("user_id", "item_id", "rank", "position", "score"))
    scores = F.array_sort(F.collect_list(F.struct("position", F.array(F.col("score") / 10).alias("p"))))
    answers = sent.groupBy("user_id").agg(
        F.to_json(F.struct(F.transform(scores, lambda r: r["p"]).alias("predictions"))).alias("answer")
    )
    rows = payload.parse_scores(answers, sent.drop("score"))
    return rows.select("user_id", "item_id", "rank", *six("score"))


# Vectors ---------------------------------------------------------------------


def _sum(column):
    return F.aggregate(column, F.lit(0.0), lambda s, x: s + x)


@query
def user_embedding(spark, d):
    return user_emb(spark, d).select(
        "id", F.size("emb").cast("long").alias("dims"), F.round(_sum("emb"), 6).alias("total"),
        F.array_join(F.transform("emb", lambda x: F.round(x * 1e6).cast("long").cast("string")), ",").alias("micros"),
    )


@query
def user_embedding_sparse(spark, d):
    """Most order lines are of items without a vector; they still count."""
    rows = embeddings.user_vectors(t.interactions_big(spark, d), t.item_emb(spark, d))
    return rows.select("id", F.round(_sum("emb"), 6).alias("total"))


@query
def user_embedding_weighted(spark, d):
    weight = embeddings.recency_weight(F.lit("2024-03-01").cast("timestamp"))
    rows = embeddings.user_vectors(t.interactions(spark, d), t.item_emb(spark, d), weight)
    return rows.select("id", F.round(_sum("emb"), 6).alias("total"), F.round(F.get("emb", F.lit(0)), 6).alias("first"))


@query
def embedding_text_roundtrip(spark, d):
    path = shared_path(spark, "emb")
    embedding_text.write(t.item_emb(spark, d), path)
    rows = embedding_text.read(spark, path).select("id", F.posexplode("emb").alias("pos", "v"))
    return rows.select("id", (F.col("pos") + 1).cast("long").alias("pos"), *six("v"))


@query
def cosine(spark, d):
    users = user_emb(spark, d).select(F.col("id").alias("user_id"), F.col("emb").alias("u"))
    items = t.item_emb(spark, d).select(F.col("id").alias("item_id"), F.col("emb").alias("i"))
    rows = t.interactions(spark, d).join(items, "item_id").join(users, "user_id")
    return rows.select("event_id", F.round(vectors.cosine(F.col("u"), F.col("i")), 6).alias("cosine"))


@query
def recall_topk(spark, d):
    return recalled(spark, d).select("user_id", "item_id", "score", "rank")


@query
def recall_topk_distributed(spark, d):
    """The same with the items passing through a shuffle instead of carried, in small blocks."""
    rows = rec.recall(
        user_emb(spark, d), t.item_emb(spark, d), settings.RECALL_SIZE, t.interactions(spark, d),
        item_block_rows=100, query_block_rows=64, resident_bytes=0,
    )
    return rows.select("user_id", "item_id", "score", "rank")


@query
def recall_catalogue(spark, d):
    """Recall among the items of a catalogue only."""
    catalogue = collections.catalogue(t.items(spark, d)).where("item_id % 3 = 0")
    rows = rec.recall(user_emb(spark, d), t.item_emb(spark, d), 50, t.interactions(spark, d), catalogue=catalogue)
    return rows.select("user_id", "item_id", "score", "rank")


@query
def vector_sums(spark, d):
    """Each item's vector plus half of the next one's, number by number."""
    rows = t.item_emb(spark, d)
    after = rows.select((F.col("id") - 1).alias("id"), F.col("emb").alias("next"))
    mixed = vectors.add(F.col("emb"), vectors.scale(F.col("next"), F.lit(0.5)))
    return rows.join(after, "id").select("id", F.posexplode(mixed).alias("pos", "value")).select("id", "pos", *six("value"))


@query
def similar_items(spark, d):
    return rec.similar_items(t.item_emb(spark, d))


@query
def similar_items_page(spark, d):
    return lists.page_or_all(rec.similar_items(t.item_emb(spark, d)), "id", 5, 10).select("id", "similar_id", "rank")


@query
def recall_tiles(spark, d):
    """Recall tile by tile; items already collected are masked where they are scored."""
    own = t.interactions(spark, d).select(F.col("user_id").alias("query_id"), "item_id")
    rows = top_k_tiles(user_emb(spark, d), t.item_emb(spark, d), 50, exclude=own, tile_rows=64, pack_rows=64)
    return rows.withColumnRenamed("query_id", "user_id")


@query
def similar_items_tiles(spark, d):
    rows = top_k_tiles(t.item_emb(spark, d), t.item_emb(spark, d), 20, exclude_self=True, tile_rows=32, pack_rows=64)
    return rows.select(F.col("query_id").alias("id"), F.col("item_id").alias("similar_id"), "score", "rank")


@query
def item_graph(spark, d):
    """How many neighbours each item has in the graph, how many with the right score, and whether nine of ten of the exact ones are found."""
    emb = settled(t.item_emb(spark, d))
    graph = settled(neighbour_graph(emb, 10))
    exact = rec.similar_items(emb, k=10).select("id", F.col("similar_id").alias("other"))
    found = graph_recall(graph, exact).select((F.col("recall") >= 0.9).alias("recall_reached"))
    other = emb.select(F.col("id").alias("other"), F.col("emb").alias("other_emb"))
    right = F.abs(vectors.cosine(F.col("emb"), F.col("other_emb")) - F.col("score")) < 2e-6
    checked = graph.join(emb, "id").join(other, "other").groupBy("id").agg(F.count("*").alias("n"), F.count_if(right).alias("right_scores"))
    return checked.join(found)


@query
def similar_users(spark, d):
    return rec.similar_users(user_emb(spark, d))


# Recommendations -------------------------------------------------------------


def _inputs(spark, d):
    return dict(
        user_emb=settled(user_emb(spark, d)), item_emb=t.item_emb(spark, d),
        collected=t.interactions(spark, d), documents=t.items(spark, d),
    )


@query
def recommend(spark, d):
    page = rec.recommend(t.all_users(spark, d), "emb", 20, 20, **_inputs(spark, d))
    return page.select("user_id", "item_id", "rank", "total", "has_more")


@query
def recommend_stored(spark, d):
    """Users whose number is even have a stored list, the own one backwards; that of every other of them is too old."""
    inputs = _inputs(spark, d)
    now = t.interactions(spark, d).agg(F.max("ts").alias("now")).scalar()
    made = F.when(F.col("user_id") % 4 == 0, now).otherwise(now - F.expr(f"INTERVAL {settings.RECOMMENDATION_TTL_SECONDS} SECONDS"))
    own = recalled(spark, d, 50).where("user_id % 2 = 0").withColumn("rank", 51 - F.col("rank"))
    stored = settled(rec.to_store(own, "emb", made))
    rows = rec.recommend_lists(t.all_users(spark, d), "emb", stored=stored, as_of=now, max_size=100, **inputs)
    return rows.select("user_id", "item_id", "rank", "source")


@query
def recommend_unknown_model(spark, d):
    page = rec.recommend(t.all_users(spark, d), "none", 20, 20, **_inputs(spark, d))
    return page.select("user_id", "item_id", "rank", "total", "has_more")


@query
def cold_start(spark, d):
    known = user_emb(spark, d).select(F.col("id").alias("user_id"))
    cold = t.all_users(spark, d).join(known, "user_id", "left_anti")
    return rec.cold_start(cold, t.items(spark, d)).select("user_id", "item_id", "rank")


@query
def popularity(spark, d):
    from pyspark.sql import Window as W

    by = W.orderBy(F.col("total").desc(), F.col("score").desc(), "id")
    return search.popular(t.items(spark, d)).select("id", F.row_number().over(by).alias("rank"))


@query
def page(spark, d):
    rows = lists.page(recalled(spark, d, settings.MAX_RECOMMENDATIONS), "user_id", 290, 20)
    return rows.select("user_id", "item_id", "rank", "total", "has_more")


@query
def list_text(spark, d):
    rows = lists.cap(recalled(spark, d, settings.MAX_RECOMMENDATIONS), settings.MAX_RECOMMENDATIONS)
    stored = lists.to_text(rows, "user_id", settings.USER_RECS_PREFIX)
    return lists.from_text(stored, settings.USER_RECS_PREFIX, "user_id").select("user_id", "item_id", "rank")


@query
def hydrate(spark, d):
    rows = lists.with_documents(recalled(spark, d), t.items(spark, d))
    return rows.select("user_id", "rank", F.col("api.id").alias("api_id"), "api.name_cn")


@query
def fresh_recs(spark, d):
    """Lists made at each user's last event, as of the last event of all."""
    events = t.interactions(spark, d)
    made = events.groupBy("user_id").agg(F.max("ts").alias("computed_at"))
    stored = recalled(spark, d).select("user_id", "item_id", "rank").join(made, "user_id")
    as_of = events.agg(F.max("ts").alias("now")).scalar()
    return lists.fresh(stored, as_of, settings.RECOMMENDATION_TTL_SECONDS).select("user_id", "item_id", "rank")


@query
def find_all(spark, d):
    """Every document of a stored collection."""
    path, documents = shared_path(spark, "collection"), t.items(spark, d).select("id", "name", "score", "votes", "tags")
    documents.write.parquet(path)
    return collections.find_all(spark, path, schema=documents.schema).select("id", "name", *six("score"), "votes", F.size("tags").alias("n_tags"))


@query
def find_one(spark, d):
    return collections.find_one(t.items(spark, d), F.col("id") == 0).select("id", "name")


# Search and documents --------------------------------------------------------


@query
def search_items(spark, d):
    return search.search_items(t.items(spark, d), "Small ri").select("id", "name", "match_at")


QUERIES["search"] = QUERIES.pop("search_items")


@query
def suggest(spark, d):
    return search.suggest(t.items(spark, d), "r")


@query
def text_matches(spark, d):
    """Phrase-prefix matches over whole document texts."""
    docs = t.read(spark, d, "documents").select("doc_id", "text")
    return search.matches(docs, "of the by", "text").select("doc_id", "match_at")


def _text_index(spark, rows, key, name, buckets=8):
    found = TextIndex(spark, shared_path(spark, "text-index"), buckets=buckets)
    found.create(rows, key, name)
    return found


def _changed_index(spark, d):
    """An index of wrong names of every third item, and of the others' own, into which the right ones are brought, and one item too much, which goes."""
    items = t.items(spark, d).select("id", "api.name_cn")
    wrong = F.when(F.col("id") % 3 == 0, F.concat(F.lit("small ring "), F.col("id").cast("string"))).otherwise(F.col("name_cn"))
    more = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("small ring of nobody").alias("name_cn"))
    found = _text_index(spark, items.withColumn("name_cn", wrong).unionByName(more), "id", "name_cn")
    found.update(items.where("id % 3 = 0"), more, "id", "name_cn")
    return found


@query
def search_indexed(spark, d):
    """The same page from a positional index that has taken changes."""
    return _changed_index(spark, d).page(t.items(spark, d), "Small ri").select("id", "name", "match_at")


@query
def suggest_indexed(spark, d):
    return _changed_index(spark, d).suggest(t.items(spark, d), "r")


@query
def text_matches_indexed(spark, d):
    found = _text_index(spark, t.read(spark, d, "documents"), "doc_id", "text")
    return found.matches("of the by").withColumnRenamed("id", "doc_id")


@query
def item_detail(spark, d):
    asked = t.supplier_changes(spark, d).select("id")
    rows = collections.item_details(t.items(spark, d), asked)
    info = F.when(
        F.col("found"), F.array_join(F.transform("info", lambda p: F.array_join(p, "=")), ";")
    )
    return rows.select("id", "found", "name", info.alias("info"))


@query
def user_profile(spark, d):
    return collections.user_profiles(t.profiles(spark, d), t.all_users(spark, d))


def _documents(spark, d):
    return t.items(spark, d).select("id", "name", "score", "votes")


@query
def upsert(spark, d):
    rows = index.upsert(_documents(spark, d), t.supplier_changes(spark, d), version="version")
    return rows.select("id", "name", *six("score"), "votes")


@query
def patch(spark, d):
    rows = index.patch(_documents(spark, d), t.supplier_changes(spark, d), version="version")
    return rows.select("id", "name", *six("score"), "votes")


@query
def delete(spark, d):
    return index.delete(_documents(spark, d), t.supplier_changes(spark, d)).select("id", "name", *six("score"), "votes")


@query
def documents_after_changes(spark, d):
    """Five batches of whole documents, fields and deletions, each of which rewrites only the buckets it touches."""
    table = BucketTable(spark, shared_path(spark, "documents"), _documents(spark, d).schema, buckets=16)
    table.create(_documents(spark, d))
    changes, ids = t.supplier_changes(spark, d), t.read(spark, d, "supplier").select("s_suppkey", "s_name")
    for k in range(5):
        mine = ids.where(F.col("s_suppkey") % 5 == k)
        patches = mine.select((F.col("s_suppkey") * 45).alias("id"), F.concat("s_name", F.lit(" patched")).alias("name"), F.lit(k).alias("version"))
        table.change(changes.where(F.col("id") % 7 == k), patches, mine.select((F.col("s_suppkey") * 70).alias("id")), version="version")
    return table.read().select("id", "name", *six("score"), "votes")


@query
def bucket_point_read(spark, d):
    """Documents of some ids, read from their buckets alone."""
    table = BucketTable(spark, shared_path(spark, "documents"), _documents(spark, d).schema, buckets=64)
    table.create(_documents(spark, d))
    return table.of_keys(t.supplier_changes(spark, d)).select("id", "name", *six("score"), "votes")


@query
def get_by_id(spark, d):
    return index.get(_documents(spark, d), t.supplier_changes(spark, d)).select("id", "name", *six("score"), "votes")


@query
def tag_vocabulary(spark, d):
    return collections.tag_vocabulary(t.tag_dict(spark, d))


@query
def item_id_text(spark, d):
    return collections.item_ids(t.items(spark, d))


@query
def catalogue(spark, d):
    return collections.catalogue(t.items(spark, d))


# Training --------------------------------------------------------------------


@query
def item_sequences(spark, d):
    rows = embeddings.item_sequences(t.interactions(spark, d))
    return rows.select("user_id", "segment", F.concat_ws(",", "items").alias("items"))


@query
def item_sequences_in_pieces(spark, d):
    rows = embeddings.item_sequences(t.interactions(spark, d), hot_rows=10, piece_rows=1500)
    return rows.select("user_id", "segment", F.concat_ws(",", "items").alias("items"))


@query
def item_sequences_nested(spark, d):
    """Sequences inside each nested document; pages hold a bounded number of events."""
    rows = t.interactions(spark, d).groupBy("user_id", F.floor(F.col("event_id") / t.PAGE_EVENTS).alias("page")).agg(
        F.collect_list(F.array(F.col("item_id").cast("string"), F.col("rating").cast("string"),
                               F.lpad(F.unix_micros("ts").cast("string"), 20, "0"))).alias("collects")
    )
    return rows.select("user_id", "page", F.concat_ws(",", arrays.newest_first(F.col("collects"))).alias("items"))


def _item2vec(spark, d):
    return embeddings.train_item2vec(
        embeddings.item_sequences(t.interactions(spark, d)), iterations=settings.EMBEDDING_ITERATIONS,
        partitions=4,
    )


@query
def item2vec(spark, d):
    """Items with a learned vector, and how many finite numbers it has."""
    finite = F.size(F.filter("emb", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6)))
    return embeddings.item_vectors(_item2vec(spark, d)).select("id", finite.alias("dims"))


@query
def lsh_buckets(spark, d):
    emb = t.item_emb(spark, d)
    rows = embeddings.bucket(embeddings.fit_buckets(emb), emb)
    return rows.select("id", F.size("buckets").alias("tables"))


@query
def nearest_items(spark, d):
    """The five nearest of one vector: that of the first item."""
    from pyspark.ml.functions import array_to_vector

    emb = t.item_emb(spark, d)
    key = emb.where(F.col("id") == 0).select(array_to_vector("emb").alias("v")).first()["v"]
    found = embeddings.nearest(embeddings.fit_buckets(emb, bucket_length=2.0), emb, key)
    mine = emb.where(F.col("id") == 0).select(F.col("emb").alias("mine"))
    squares = F.aggregate(F.zip_with("emb", "mine", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    held = found.join(emb, "id").join(mine, F.lit(True))
    return held.agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("id") == 0) & (F.col("distance") == 0)).alias("itself"),
        F.min(F.abs(F.sqrt(squares) - F.col("distance")) < 1e-6).alias("exact_distances"))


@query
def cross_feature(spark, d):
    rows = training(spark, d)
    return rows.select("event_id", encoders.cross_bucket().alias("bucket"))


@query
def tag_one_hot(spark, d):
    """The place of the one in each encoded tag, -1 for unknown tags."""
    from pyspark.ml.functions import vector_to_array

    rows = training(spark, d).select("event_id", *ITEM_TAGS)
    model = encoders.tag_encoder(collections.tag_vocabulary(t.tag_dict(spark, d)), ITEM_TAGS)
    return model.transform(rows).select("event_id", *[
        (F.array_position(vector_to_array(f"{c}_hot"), 1.0) - 1).alias(f"{c}_at") for c in ITEM_TAGS
    ])


def _model_frames(spark, d):
    """Train and test inputs; the id encodings get the range of the given ids.

    Vectors come from interactions up to the split, so that no model has seen
    what it is tested on.
    """
    # One row a user: the tags come from the documents, not from each collected entry.
    tags = t.user_tags(spark, d).select("user_id", *[F.get("tags", F.lit(i))["name"].alias(c) for i, c in enumerate(encoders.USER_TAGS)])
    # Samples and past interactions are read several times each; all that makes them is done once.
    rows = settled(training(spark, d).join(tags, "user_id", "left"))
    train, test = samples.split_by_time(rows, error=0.0)
    end = train.agg(F.max("ts")).first()[0]
    past = settled(t.interactions(spark, d).where(F.col("ts") <= F.lit(end)))
    model = embeddings.train_item2vec(embeddings.item_sequences(past, min_count=5))
    vec = settled(embeddings.item_vectors(model))
    users = settled(embeddings.user_vectors(past, vec))
    sizes = _id_ranges(spark, d)
    ready = [settled(encoders.with_model_inputs(f, users, vec, **sizes)) for f in (train, test)]
    return ready, users, vec, rows


def _id_ranges(spark, d):
    ranges = {"user_buckets": (t.all_users(spark, d), "user_id"), "item_buckets": (t.items(spark, d), "id")}
    return {name: 1 + (rows.agg(F.max(column)).first()[0] or 0) for name, (rows, column) in ranges.items()}


def _scored(pipeline, frames):
    train, test = frames
    return rankers.predict(rankers.fit(pipeline, train), test, ["event_id", "user_id", "item_id", "label"])


def _sound(scored):
    """Every test sample with its label, and that its score is a probability: what SQL can tell of a model."""
    return scored.select("event_id", "user_id", "item_id", "label", F.col("score").between(0, 1).alias("in_range"))


@query
def wide_deep(spark, d):
    frames, *_ = _model_frames(spark, d)
    return _sound(_scored(rankers.wide_and_deep(spark), frames))


@query
def embedding_mlp(spark, d):
    frames, *_ = _model_frames(spark, d)
    return _sound(_scored(rankers.embedding_mlp(), frames))


@query
def ncf(spark, d):
    frames, *_ = _model_frames(spark, d)
    return _sound(_scored(rankers.neural_cf(), frames))


@query
def deepfm(spark, d):
    frames, *_ = _model_frames(spark, d)
    vocabulary = collections.tag_vocabulary(t.tag_dict(spark, d))
    places = rankers.id_places(frames[0])
    ready = [settled(places.encode(f)) for f in frames]
    return _sound(_scored(rankers.deep_fm(vocabulary, **places.sizes), ready))


@query
def two_tower(spark, d):
    train, test = samples.split_by_time(training(spark, d), error=0.0)
    model = rankers.two_tower(train)
    return model.score(test.select("event_id", "user_id", "item_id")).select("event_id", F.col("prediction").isNotNull().alias("known"))


@query
def model_metrics(spark, d):
    """Metrics of the concat model, saved and loaded before it predicts."""
    (train, test), *_ = _model_frames(spark, d)
    path = rankers.save(rankers.fit(rankers.neural_cf(), train), shared_path(spark, "model"))
    metrics = rankers.evaluate(rankers.predict(rankers.load(path), test))
    return metrics.select(
        F.col("loss").between(0, 2).alias("loss_sound"),
        *[F.col(c).between(0, 1).alias(f"{c}_sound") for c in ("accuracy", "roc_auc", "pr_auc")])


@query
def shown_predictions(spark, d):
    frames, *_ = _model_frames(spark, d)
    shown = rankers.shown(_scored(rankers.neural_cf(), frames))
    right = (F.col("label") == 1) == (F.col("actual") == "Good Rating")
    return shown.agg(F.count(F.lit(1)).alias("n"), F.min(right).alias("worded_right"))


@query
def recommend_wide_deep(spark, d):
    (train, _), users, vec, rows = _model_frames(spark, d)
    model = rankers.fit(rankers.wide_and_deep(spark), train)
    scorer = rankers.scorer(
        model, features.latest_item_features(rows), features.latest_user_features(rows), users, vec,
        # The encodings take any id, so no candidate is left out for its own.
        id_bound=None, **_id_ranges(spark, d),
    )
    return rec.recommend(
        t.all_users(spark, d), "widendeep", 0, 20, user_emb=users, item_emb=vec,
        collected=t.interactions(spark, d), documents=t.items(spark, d), scorers={"widendeep": scorer},
    )


@query
def recommend_neural_cf(spark, d):
    (train, _), users, vec, _ = _model_frames(spark, d)
    scorer = rankers.id_scorer(rankers.fit(rankers.neural_cf(), train), users, vec)
    return rec.recommend(
        t.all_users(spark, d), "neuralcf", 0, 20, user_emb=users, item_emb=vec,
        collected=t.interactions(spark, d), documents=t.items(spark, d), scorers={"neuralcf": scorer},
    )


def _list_facts(spark, d, page):
    """What holds of each user's page whatever the model learned."""
    own = t.interactions(spark, d).select("user_id", "item_id", F.lit(1).alias("own")).distinct()
    known = t.item_emb(spark, d).select(F.col("id").alias("item_id"), F.lit(1).alias("known"))
    popular = t.items(spark, d).select(F.col("id").alias("item_id"), F.lit(1).alias("listed"))
    rows = settled(page.select("user_id", "item_id", "rank", "source"))
    rows = rows.join(own, ["user_id", "item_id"], "left").join(known, "item_id", "left").join(popular, "item_id", "left")
    return rows.groupBy("user_id", "source").agg(
        F.count("*").alias("n"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.count_distinct("item_id").alias("items"),
        F.count("own").alias("collected"), F.count_if(F.coalesce("known", "listed").isNull()).alias("unknown"))


@query
def recommend_wide_deep_lists(spark, d):
    return _list_facts(spark, d, recommend_wide_deep(spark, d))


@query
def recommend_neural_cf_lists(spark, d):
    return _list_facts(spark, d, recommend_neural_cf(spark, d))


# Streaming -------------------------------------------------------------------


def _stream(spark, d):
    session.use_utc(spark)
    """The events as they would arrive: in three deliveries, each with a part of the one before again."""
    path = shared_path(spark, "incoming")
    events = spark.read.schema(t.RAW_EVENTS).parquet(f"{d}/events.parquet")
    part = F.pmod(F.xxhash64("event_id"), F.lit(6))
    for k in range(3):
        events.where((part % 3 == k) | (part == (k + 2) % 3)).write.mode("append").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    raw = refresh.read_table(spark, path, t.RAW_EVENTS, maxFilesPerTrigger=-(-files // 3))
    # Deliveries are not in order of time, so no event counts as late.
    return refresh.ingest(t.as_interactions(raw), delay="36500 days")


@query
def stream_user_features(spark, d):
    path = shared_path(spark, "stream")
    table = RevisionTable(spark, f"{path}/features", refresh.RUNNING_FEATURES)
    refresh.keep_running_features(_stream(spark, d), table, f"{path}/checkpoint").awaitTermination()
    return table.latest("user_id").select(
        "user_id", "user_rating_count", *six("user_avg_rating", "user_rating_stddev"), micros("last_ts", "last_us")
    )


def _refreshed(spark, d, schema, recompute):
    path = shared_path(spark, "stream")
    kept = RevisionTable(spark, f"{path}/interactions", refresh.INTERACTIONS, key="user_id", buckets=8)
    results = RevisionTable(spark, f"{path}/results", schema)
    refresh.keep_refreshed(_stream(spark, d), kept, results, recompute, f"{path}/checkpoint").awaitTermination()
    return results.latest_lists("user_id")


@query
def stream_last_positives(spark, d):
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in USER_STORED.fields)
    rows = _refreshed(spark, d, schema, lambda every, touched: refresh.touched_features(every, touched))
    return rows.select("user_id", *RATED, *stats())


@query
def stream_refresh(spark, d):
    """Recommendations of the users each batch touches."""
    # Every batch reads these again.
    item_emb, documents = settled(t.item_emb(spark, d)), settled(t.items(spark, d).select("id", "rating"))

    def recompute(every, touched):
        own = settled(every)
        return rec.recommend_lists(
            touched, "none", user_emb=settled(embeddings.user_vectors(own, item_emb)), item_emb=item_emb,
            collected=own, documents=documents,
        )

    return _refreshed(spark, d, refresh.LISTS, recompute).select("user_id", "item_id", "rank")


def _deliveries(spark, d):
    """Interactions in three deliveries by time: one in twenty comes with the next, one in six again with the next."""
    rows = t.interactions(spark, d)
    own = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    first = F.when(F.col("event_id") % 20 == 7, F.least(own + 1, F.lit(2))).otherwise(own)
    for k in range(3):
        yield rows.where(first == k).unionByName(rows.where((F.col("event_id") % 6 == 1) & (own + 1 == k)))


@query
def stream_fates(spark, d):
    """How many rows of each batch were kept, late or repeated; the stream starts anew from its checkpoint for each delivery."""
    ingest, path = _counted(spark, d)
    us = [micros(c, n) for c, n in (("watermark", "watermark_us"), ("last_ts", "last_us"))]
    return ingest.counts.all().select("batch_id", "given", "kept", "late", "repeated", *us)


def _counted(spark, d):
    path = shared_path(spark, "counted")
    ingest = CountedIngest(spark, f"{path}/tables", refresh.INTERACTIONS, delay="3 days")
    for part in _deliveries(spark, d):
        part.write.mode("append").parquet(f"{path}/incoming")
        ingest.start(refresh.read(spark, f"{path}/incoming", refresh.INTERACTIONS), f"{path}/checkpoint").awaitTermination()
    return ingest, path


@query
def stream_late_rows(spark, d):
    """The rows that came too late, with the batch they came in."""
    return _counted(spark, d)[0].late.all().select("batch_id", "event_id", "user_id", "item_id", "rating", micros("ts", "ts_us"))


@query
def stream_state_features(spark, d):
    """Running figures and last liked items of users from state alone, over three deliveries with a restart before each."""
    path = shared_path(spark, "state")
    table = RevisionTable(spark, f"{path}/features", user_state.FEATURES)
    for part in _deliveries(spark, d):
        part.write.mode("append").parquet(f"{path}/incoming")
        # Deliveries overlap in time, and here no event counts as late.
        stream = refresh.ingest(refresh.read(spark, f"{path}/incoming", refresh.INTERACTIONS), delay="36500 days")
        user_state.keep_state_features(stream, table, f"{path}/checkpoint").awaitTermination()
    return table.latest("user_id").select("user_id", *RATED, *stats(), micros("last_ts", "last_us"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
