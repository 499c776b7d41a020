"""The feature job: from collections and items to samples, splits and features."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from affinis import settings
from affinis.operators import features, history, samples as sample_ops
from affinis.session import settled
from affinis.sources import keyvalue, samples_csv


class FeatureTables(NamedTuple):
    samples: DataFrame
    train: DataFrame
    test: DataFrame
    item_features: DataFrame
    user_features: DataFrame


def training_samples(interactions: DataFrame, items: DataFrame, order: Sequence[str] = ("ts", "event_id"), **sizes) -> DataFrame:
    """Labelled samples of known items with item features and the user's running features."""
    labelled = sample_ops.add_label(interactions)
    with_items = features.add_item_features(labelled, items)
    return history.add_user_features(with_items, order=order, counted=interactions, **sizes)


#: Order of samples from nested lists, whose entries have no id of their own.
NESTED_ORDER = ("ts", "position", "item_id")


def nested_samples(collections: DataFrame, items: DataFrame, **sizes) -> DataFrame:
    """Training samples with the user's tags, straight from nested collection lists."""
    entries = sample_ops.explode_collects(collections)
    timed = entries.withColumn("ts", F.col("ts").try_cast("timestamp"))
    return training_samples(timed, items, order=NESTED_ORDER, **sizes)


def feature_tables(
    interactions: DataFrame,
    items: DataFrame,
    order: Sequence[str] = ("ts", "event_id"),
    split_error: float = settings.SPLIT_ERROR,
    **sizes,
) -> FeatureTables:
    """All results of one run; the samples are computed once and stored."""
    samples = settled(training_samples(interactions, items, order, **sizes))
    train, test = sample_ops.split_by_time(samples, order[0], error=split_error)
    return FeatureTables(
        samples,
        train,
        test,
        features.latest_item_features(samples, order),
        features.latest_user_features(samples, order),
    )


def write(tables: FeatureTables, folder: str) -> None:
    """Sample files and the two feature stores."""
    samples_csv.write_split(features.for_export(tables.train), features.for_export(tables.test), folder)
    keyvalue.write(
        keyvalue.encode(tables.item_features, settings.ITEM_FEATURE_PREFIX, "item_id"), f"{folder}/itemFeatures"
    )
    keyvalue.write(
        keyvalue.encode(features.for_export(tables.user_features), settings.USER_FEATURE_PREFIX, "user_id"),
        f"{folder}/userFeatures",
    )
