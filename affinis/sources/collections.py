"""Scans of the item, user and tag collections and lookups by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from affinis import schemas, settings
from affinis.functions import arrays


def find_all(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """All documents of a collection; the schema is given, never inferred from text."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def items(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The item columns the samples need."""
    return item_columns(find_all(spark, path, fmt, schemas.ITEM))


def item_columns(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("id").alias("item_id"), "tags", "score", "votes", "release_year"
    )


def user_collections(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Collection lists with the user's tags; the profile is left behind."""
    return user_columns(find_all(spark, path, fmt, schemas.USER_COLLECTION))


def user_columns(documents: DataFrame) -> DataFrame:
    return documents.select("user_id", "collects", F.col("tags").alias("user_tags"))


def tag_vocabulary(tags: DataFrame) -> DataFrame:
    """Names of the tags used more than once."""
    return tags.where(F.col("count") > settings.MIN_TAG_COUNT).select("name").distinct()


def item_ids(documents: DataFrame) -> DataFrame:
    """Item ids as distinct text."""
    return documents.select(F.col("id").cast("string").alias("id")).distinct()


def catalogue(documents: DataFrame) -> DataFrame:
    """The ids recommendations may choose from."""
    return documents.select(F.col("id").alias("item_id"))


def find_one(df: DataFrame, predicate: Column) -> DataFrame:
    """The first row that fits, or none. For many keys use :func:`find_by_keys`."""
    return df.where(predicate).limit(1)


def find_by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One output row per asked key, with a ``found`` flag."""
    return keys.select(key).distinct().join(df.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def user_profiles(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """The nested profile of the asked users, flattened."""
    return find_by_keys(documents.select("user_id", "api"), keys, "user_id").select("user_id", "found", "api.*")


def item_details(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Whole documents with ``info`` as pairs; unknown ids come back with ``found`` false."""
    return find_by_keys(documents, keys, "id").withColumn("info", arrays.info_pairs(F.col("info")))
