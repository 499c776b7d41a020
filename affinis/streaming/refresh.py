"""Interaction stream: ingest, running features and refreshed recommendations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from affinis.operators import features, history, samples as sample_ops
from affinis.streaming.revisions import RevisionTable

INTERACTIONS = "event_id long, user_id long, item_id long, rating int, ts timestamp"
RUNNING_FEATURES = (
    "user_id long, user_rating_count long, user_avg_rating double, user_rating_stddev double, last_ts timestamp"
)
LISTS = "user_id long, item_id long, score double, rank int, source string"


def read(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def read_table(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """A Parquet table as a stream, whether it is a folder of files or one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return read(spark, path, schema, **options)
    return read(spark, at.getParent().toString(), schema, pathGlobFilter=at.getName(), **options)


def ingest(stream: DataFrame, delay: str = "1 hour", ts: str = "ts", event: str = "event_id") -> DataFrame:
    """Each event once, late ones only within ``delay``."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([event])


def running_features(interactions: DataFrame) -> DataFrame:
    """Count, mean and deviation of the ratings and the last time per user.

    Partial sums are merged before the shuffle to the state, so a busy user
    costs one row per task and batch.
    """
    return interactions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("user_rating_count"),
        F.avg("rating").alias("user_avg_rating"),
        F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("user_rating_stddev"),
        F.max("ts").alias("last_ts"),
    )


def keep_running_features(stream: DataFrame, table: RevisionTable, checkpoint: str) -> StreamingQuery:
    """Write the changed users of each batch as one revision."""
    return (
        running_features(stream)
        .writeStream.outputMode("update")
        .foreachBatch(lambda rows, batch_id: table.write(rows, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def touched_features(
    interactions: DataFrame, touched: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), **sizes
) -> DataFrame:
    """Latest features of the touched users, from all their interactions."""
    own = interactions.join(touched.select("user_id").distinct(), "user_id", "left_semi")
    rows = history.add_user_features(sample_ops.add_label(own), order=order, **sizes)
    return features.latest_user_features(rows, order)


def keep_refreshed(
    stream: DataFrame,
    interactions: RevisionTable,
    results: RevisionTable,
    recompute: Callable[[DataFrame, DataFrame], DataFrame],
    checkpoint: str,
) -> StreamingQuery:
    """Recompute something for the users each batch touches.

    The batch is stored first and everything after reads the stored rows, so
    the stream's state is advanced once. ``recompute`` gets the touched users
    and all their interactions so far; with a table split by user only the
    buckets of these users are read.
    """

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        interactions.write(rows, batch_id)
        touched = interactions.batch(batch_id).select("user_id").distinct()
        results.write(recompute(interactions.of_keys(touched, batch_id), touched), batch_id)

    return (
        stream.writeStream.outputMode("append")
        .foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
