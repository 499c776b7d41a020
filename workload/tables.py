"""Interactions, items, users and vectors derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from affinis import session

# Interactions per collection page of a user; keeps every document bounded.
PAGE_EVENTS = 64

RAW_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    session.use_utc(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_interactions(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        (F.floor("value").cast("int") % 11).alias("rating"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as ratings; no two of a user share a time."""
    return as_interactions(read(spark, folder, "events"))


BIG_ORDER = ("ts", "l_orderkey", "l_linenumber", "item_id", "l_suppkey", "l_extendedprice", "l_shipdate")


def interactions_big(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as ratings; all lines of an order share their time."""
    orders = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )
    lines = read(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("item_id"), "l_suppkey", "l_extendedprice",
        F.col("l_shipdate").cast("timestamp").alias("l_shipdate"),
        (F.col("l_quantity").cast("int") % 11).alias("rating"),
    )
    return lines.join(orders, "l_orderkey")


def user_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Event types of each user by descending count, then name."""
    counts = read(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct((-F.col("n")).alias("down"), F.col("event_type").alias("name"))
    return counts.groupBy("user_id").agg(F.array_sort(F.collect_list(entry)).alias("_t")).select(
        "user_id", F.transform("_t", lambda t: F.struct(t["name"].alias("name"))).alias("tags")
    )


def user_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Nested collection lists, one document per user and page of events."""
    rows = interactions(spark, folder)
    entry = F.struct(
        "ts",
        F.array(
            F.col("item_id").cast("string"), F.col("rating").cast("string"), F.col("ts").cast("string")
        ).alias("c"),
    )
    pages = rows.groupBy("user_id", F.floor(F.col("event_id") / PAGE_EVENTS).alias("page")).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["c"]).alias("collects")
    )
    api = F.struct(F.col("user_id").alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("nickname"))
    return pages.join(user_tags(spark, folder), "user_id").select("user_id", "collects", "tags", api.alias("api"))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One profile per user seen in ``events``."""
    api = F.struct(F.col("user_id").alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("nickname"))
    return read(spark, folder, "events").select("user_id").distinct().select("user_id", api.alias("api"))


def items(spark: SparkSession, folder: str) -> DataFrame:
    """``part`` as item documents; votes are the order lines of the part."""
    votes = read(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("votes")
    )
    part = read(spark, folder, "part").join(votes, "p_partkey", "left")
    key, size = F.col("p_partkey"), F.col("p_size")
    words = F.split("p_name", " ")

    def tag(name, count):
        return F.array(name, count.cast("string"))

    score = (key % 100) / F.lit(10.0)
    votes = F.coalesce("votes", F.lit(0)).cast("long")
    return part.select(
        key.alias("id"),
        F.col("p_name").alias("name"),
        F.array(
            tag(F.col("p_type"), size),
            tag(F.col("p_brand"), size % 7 + 1),
            tag(F.get(words, F.lit(0)), key % 11),
            tag(F.get(words, F.lit(1)), key % 5),
        ).alias("tags"),
        score.alias("score"),
        votes.alias("votes"),
        F.concat(F.lit("Title ("), (F.lit(1990) + size % 30).cast("string"), F.lit(")")).alias("release_year"),
        F.struct(votes.alias("total"), score.alias("score")).alias("rating"),
        F.create_map(
            F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), size.cast("string")
        ).alias("info"),
        F.struct(key.alias("id"), F.col("p_name").alias("name_cn")).alias("api"),
    )


def item_emb(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("emb")
    )


def all_users(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and event users; most have no interactions."""
    customers = read(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    return customers.union(read(spark, folder, "events").select("user_id")).distinct()


def tag_dict(spark: SparkSession, folder: str) -> DataFrame:
    """Words of part names, brands and types with their frequency."""
    part = read(spark, folder, "part")
    names = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type", F.concat(F.lit("part "), F.col("p_partkey"))))
    return part.select(F.explode(names).alias("name")).groupBy("name").agg(
        F.count(F.lit(1)).cast("int").alias("count")
    )


def supplier_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Changes to item documents: some ids exist, some are new, some come twice."""
    s = read(spark, folder, "supplier")
    every = s.select((F.col("s_suppkey") * 30).alias("id"), F.col("s_name").alias("name"),
                     F.round("s_acctbal", 2).alias("score"), F.col("s_nationkey").cast("long").alias("votes"),
                     F.lit(1).alias("version"))
    again = s.select((F.col("s_suppkey") * 60).alias("id"), F.concat(F.col("s_name"), F.lit(" again")).alias("name"),
                     F.round("s_acctbal", 2).alias("score"), F.lit(None).cast("long").alias("votes"),
                     F.lit(2).alias("version"))
    return every.unionByName(again)


