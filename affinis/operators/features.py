"""Item features, latest features per item and user, tag frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from affinis import schemas, settings
from affinis.functions import arrays, text
from affinis.operators.latest import latest_per_key


def with_top_tags(items: DataFrame) -> DataFrame:
    """The item's tags by count, and the first three as columns."""
    names = [f"item_tag_{i + 1}" for i in range(settings.ITEM_TAGS_SHOWN)]
    ordered = items.withColumn("tags", arrays.sort_tags(F.col("tags")))
    return ordered.select(*items.columns, *arrays.positions(F.col("tags"), names))


def add_item_features(samples: DataFrame, items: DataFrame, keep_tags: bool = False) -> DataFrame:
    """Samples of known items with the item's tags, votes and score.

    Tags are ordered once per item, before the join. The item table is
    broadcast when its measured size allows; otherwise a hot item is split by
    the adaptive skew join.
    """
    features = with_top_tags(items)
    if not keep_tags:
        features = features.drop("tags")
    return samples.join(features, "item_id", "inner")


def with_release_year(items: DataFrame) -> DataFrame:
    return items.withColumn("release_year", text.release_year(F.col("release_year")))


def latest_item_features(samples: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Features of each item as of its latest sample."""
    columns = schemas.ITEM_FEATURES.names
    latest = latest_per_key(samples.select(*columns, *[c for c in order if c not in columns]), "item_id", order)
    return latest.select(*columns).na.fill("")


def latest_user_features(samples: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Features of each user as of their latest sample; no liked item counts as 0."""
    columns = [c for c in schemas.USER_FEATURES.names if c in samples.columns]
    latest = latest_per_key(samples.select(*columns, *[c for c in order if c not in columns]), "user_id", order)
    return latest.select(*columns).na.fill("").na.fill(0)


def for_export(features: DataFrame) -> DataFrame:
    """Averages and deviations as fixed two-decimals text."""
    return features.withColumns(
        {c: text.two_decimals(F.col(c)) for c in ("user_avg_rating", "user_rating_stddev") if c in features.columns}
    )


def tag_frequency(samples: DataFrame, key: str, tags: str = "tags") -> DataFrame:
    """How often each tag occurs per key, ranked by count and then name."""
    counts = (
        samples.select(key, F.explode(tags).alias("tag"))
        .groupBy(key, "tag")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_count = W.partitionBy(key).orderBy(F.col("n").desc(), "tag")
    return counts.withColumn("rank", F.row_number().over(by_count))
