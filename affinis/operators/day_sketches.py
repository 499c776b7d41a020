"""The split point of a growing history from stored quantile sketches: new samples cost a pass over themselves alone.

Each batch of samples leaves one mergeable sketch (KLL) per day of their times. The split point of all samples so far,
or of any range of days, is a quantile of the merged sketches, whatever the number of samples behind them.

At scale: sketches are built before the shuffle, so a day moves one sketch a task; a stored sketch has a bounded
size (about 3 * ``k`` numbers), and merging reads one row per batch and day.

Defined results: null times are in no sketch; a batch written again replaces its own sketches; without sketches the point is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from affinis.streaming.revisions import RevisionTable

SCHEMA = "day date, sketch binary"
#: Rank error of about 1.3 % with certainty 0.99; it falls with 1 / k.
K = 200


class DaySketches:
    def __init__(self, spark: SparkSession, path: str, k: int = K):
        self.k, self.table = k, RevisionTable(spark, path, SCHEMA)

    def add(self, times: DataFrame, column: str, batch_id: int) -> None:
        """Sketches of one batch of times (timestamps), in milliseconds."""
        at = F.col(column)
        rows = times.where(at.isNotNull()).groupBy(F.to_date(at).alias("day")).agg(F.kll_sketch_agg_bigint(F.unix_millis(at), F.lit(self.k)).alias("sketch"))
        self.table.write(rows, batch_id)

    def merged(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """One sketch of all days, or of those from ``first`` to ``last``."""
        rows = self.table.all()
        if first is not None:
            rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
        if last is not None:
            rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
        return rows.agg(F.kll_merge_agg_bigint("sketch", F.lit(self.k)).alias("sketch"), F.count("*").alias("sketches"))

    def split_point(self, share: float, **days) -> DataFrame:
        """One row: the time in milliseconds below which about ``share`` of the rows lie, and how many rows there are."""
        found = self.merged(**days)
        some = F.col("sketches") > 0
        return found.select(
            F.when(some, F.kll_sketch_get_quantile_bigint("sketch", F.lit(share))).alias("split_at"),
            F.when(some, F.kll_sketch_get_n_bigint("sketch")).otherwise(0).alias("n"), "sketches")
