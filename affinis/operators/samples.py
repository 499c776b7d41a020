"""From collection lists to labelled samples and their time split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from affinis import settings
from affinis.functions import arrays, text


def explode_collects(collections: DataFrame) -> DataFrame:
    """One row per collected item; users with an empty list vanish.

    ``position`` is the place in its list, which tells apart entries of the same
    time. The user's tags are cut to the five that are used before the list is
    exploded, so that they and not the whole tag array are repeated.
    """
    names = [f"user_tag_{i + 1}" for i in range(settings.USER_TAGS_SHOWN)]
    tags = arrays.tag_names(F.col("user_tags"), names) if "user_tags" in collections.columns else []
    entry = F.col("_entry")
    return collections.select("user_id", F.posexplode("collects").alias("position", "_entry"), *tags).select(
        "user_id",
        "position",
        F.get(entry, F.lit(0)).try_cast("long").alias("item_id"),
        F.get(entry, F.lit(1)).try_cast("int").alias("rating"),
        F.get(entry, F.lit(2)).alias("ts"),
        *(names if tags else []),
    )


def label(rating: Column) -> Column:
    """1 for a rating of at least 6 or a collection without a rating, else 0."""
    liked = (rating >= settings.POSITIVE_RATING) | (rating == settings.UNRATED)
    return F.when(liked, 1).otherwise(0)


def add_label(samples: DataFrame) -> DataFrame:
    return samples.withColumn("label", label(F.col("rating")))


def rating_histogram(samples: DataFrame) -> DataFrame:
    """Rows and share of the total per rating, in one pass.

    The window sees one row per distinct rating.
    """
    counts = samples.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())
    return counts.withColumn("share", share).orderBy("rating")


def split_point(times: DataFrame, column: str, share: float, error: float = 0.0) -> DataFrame:
    """One row with the time below which ``share`` of the rows lie.

    With ``error`` 0 it is the exact value at rank ``ceil(share * n)``. Equal
    times are counted together first, and days are few, so the running sum sees
    one row per day however many samples there are. For times finer than days
    use ``error`` above 0, a sketch of fixed size.
    """
    if error > 0:
        return times.agg(
            F.percentile_approx(column, share, F.lit(int(1 / error))).alias("split_at")
        )
    counts = times.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy().orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.sum("n").over(W.partitionBy())
    running = counts.select(column, upto.alias("upto"), total.alias("total"))
    return running.where(F.col("upto") >= F.ceil(F.col("total") * F.lit(share))).agg(
        F.min(column).alias("split_at")
    )


def split_by_time(
    samples: DataFrame,
    ts: str = "ts",
    share: float = settings.TRAIN_SHARE,
    error: float = settings.SPLIT_ERROR,
) -> tuple[DataFrame, DataFrame]:
    """Train samples up to the split day and test samples after it."""
    timed = dict(samples.dtypes)[ts].startswith("timestamp")
    # The day of a time is cut from its number; only text has to be read.
    millis = F.unix_millis(F.date_trunc("day", F.col(ts).cast("timestamp"))) if timed else text.day_millis(F.col(ts).cast("string"))
    at = split_point(samples.select(millis.alias("_millis")), "_millis", share, error).scalar()
    return samples.where(millis <= at), samples.where(millis > at)
