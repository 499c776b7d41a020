"""Upsert, patch, delete and read of documents held in a table keyed by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from affinis.operators.latest import latest_per_key


def newest(delta: DataFrame, key: str, version: str | None) -> DataFrame:
    """One change per key: the last version wins when a batch holds several.

    Without versions there is no last one, so a repeated key fails the job.
    """
    if version is None:
        return _single(delta, key)
    return latest_per_key(delta, key, [version]).drop(version)


def _single(delta: DataFrame, key: str) -> DataFrame:
    repeated = F.raise_error(F.concat(F.lit("several changes of one id and no version: "), F.col(key).cast("string"))).cast("boolean")
    counted = delta.withColumn("_changes", F.count(F.lit(1)).over(W.partitionBy(key)))
    return counted.where(F.when(F.col("_changes") > 1, repeated).otherwise(True)).drop("_changes")


def upsert(base: DataFrame, delta: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """Whole documents of ``delta`` replace or join those of ``base``."""
    changes = newest(delta, key, version)
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def patch(base: DataFrame, delta: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """Fields given in ``delta`` overwrite, the others stay; unknown ids are ignored.

    A field is given when it is not null, or, where ``delta`` has a boolean
    column ``has_<field>``, when that is true (so a field can be set to null).
    Several changes of one id apply one after the other: each field gets the
    value of the last version that gives it.
    """
    changes = _single(delta, key).withColumn("_version", F.lit(0)) if version is None else delta.withColumn("_version", F.col(version))
    fields = [c for c in base.columns if c != key and c in changes.columns and c != version]

    def given(c: str):
        return F.coalesce(F.col(f"has_{c}"), F.lit(False)) if f"has_{c}" in changes.columns else F.col(c).isNotNull()

    last = [
        F.max_by(F.struct(F.col(c).alias("value")), F.when(given(c), F.col("_version"))).alias(f"_new_{c}") for c in fields
    ]
    joined = base.join(changes.groupBy(key).agg(*last), key, "left") if fields else base
    return joined.select(*[
        F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}")["value"]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in base.columns
    ])


def delete(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti")


def get(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_semi")
