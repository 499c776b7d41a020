"""Feature tables as ``key, value`` rows with JSON values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from affinis import settings
from affinis.functions import arrays, text, vectors


def encode(df: DataFrame, prefix: str, id_col: str) -> DataFrame:
    """Key = prefix + id, value = the whole row as JSON."""
    return df.select(
        F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("key"),
        F.to_json(F.struct(*df.columns)).alias("value"),
    )


def encode_tags(documents: DataFrame) -> DataFrame:
    """``tag:<id>`` with the item's tags and counts, for every item."""
    return documents.where(F.col("tags").isNotNull()).select(
        F.concat(F.lit(settings.TAG_PREFIX), F.col("id").cast("string")).alias("key"),
        F.to_json(arrays.tag_counts(F.col("tags"))).alias("value"),
    )


def encode_vectors(embeddings: DataFrame, prefix: str) -> DataFrame:
    return embeddings.select(
        F.concat(F.lit(prefix), F.col("id").cast("string")).alias("key"),
        vectors.to_commas(F.col("emb")).alias("value"),
    )


def write(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    pairs.write.mode(mode).parquet(path)


def point_read(pairs: DataFrame, ids: DataFrame, prefix: str, id_col: str = "id") -> DataFrame:
    """The value of each asked id, null when the key is absent."""
    asked = ids.select(
        F.col(id_col), F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("key")
    )
    return asked.join(pairs, "key", "left").select(id_col, "key", "value")


def prefix_scan(pairs: DataFrame, prefix: str) -> DataFrame:
    """All ids under a prefix with their values; the filter reaches the scan."""
    return pairs.where(F.col("key").startswith(prefix)).select(
        text.without_prefix(F.col("key"), prefix).alias("id"), "value"
    )


def prefix_count(pairs: DataFrame, prefix: str) -> DataFrame:
    return pairs.where(F.col("key").startswith(prefix)).agg(F.count(F.lit(1)).alias("n"))


def decode_json(pairs: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed columns of a JSON value; numbers may be stored as text."""
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    parsed = pairs.withColumn("_row", F.from_json("value", as_text))
    kept = [c for c in pairs.columns if c != "value" and c not in schema.names]
    return parsed.select(
        *kept, *[F.col("_row")[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def decode_tags(pairs: DataFrame) -> DataFrame:
    kept = [c for c in pairs.columns if c != "value"]
    return pairs.select(*kept, F.from_json("value", "map<string,int>").alias("tags"))


def decode_vectors(pairs: DataFrame) -> DataFrame:
    kept = [c for c in pairs.columns if c != "value"]
    return pairs.select(*kept, vectors.from_commas(F.col("value")).alias("emb"))
