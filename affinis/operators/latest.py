"""Latest row per key and top rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_rows(df: DataFrame, key: str, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key, ranked from 1.

    Each task keeps at most ``k`` rows of a key before the shuffle, so a key
    that holds most of the rows costs no more than any other. Spark does so up
    to a limit, which is raised here for larger ``k``.
    """
    conf = df.sparkSession.conf
    if int(conf.get(_LIMIT, "1000")) < k:
        conf.set(_LIMIT, str(k))
    window = W.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` values of each key."""
    down = [F.col(c).desc_nulls_last() for c in order]
    return top_rows(df, key, down, 1, "_rank").drop("_rank")
