"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder the cluster names; only where none is named, one below the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back: later steps see fixed rows, read only
    the columns they need, know the size for planning, and no lost executor repeats the work."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rename(columns: list[str], taken: str) -> str:
    """A column name that none of ``columns`` has, whatever its case."""
    low = {c.lower() for c in columns}
    while taken.lower() in low:
        taken += "_"
    return taken


def named(column: str):
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")
