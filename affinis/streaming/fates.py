"""Ingest in which every row given has a counted fate: kept, late or repeated.

Spark's watermark drops late rows without a word. Here the rule is the same (a batch's watermark is the latest time
kept before it, less the delay) but the rows behind it are stored, and each batch's numbers are a row of a table, so that
given = kept + late + repeated holds for every batch and can be checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from affinis.streaming.revisions import RevisionTable

COUNTS = "given long, kept long, late long, repeated long, untimed long, watermark timestamp, last_ts timestamp"


class CountedIngest:
    """Tables ``given``, ``kept``, ``late`` and ``counts`` below one path, a partition of each per batch.

    A replayed batch writes its own partitions again from the same rows and the counts of the batches before it, so it
    changes nothing. Batches whose kept rows all lie behind the watermark can't hold a row's first copy; only the others
    are read to find repeats, whatever has gathered since the start.

    Of rows of one event the least, by all columns, is kept; a copy whose time is behind the watermark is late rather than repeated. Rows
    without an event are each kept; rows without a time are never late, and a copy of one is found among all kept rows
    without a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, delay: str = "1 hour", ts: str = "ts", event: str = "event_id"):
        self.spark, self.delay, self.ts, self.event = spark, delay, ts, event
        self.given, self.kept, self.late = (RevisionTable(spark, f"{path}/{name}", schema) for name in ("given", "kept", "late"))
        self.counts = RevisionTable(spark, f"{path}/counts", COUNTS)

    def _before(self, batch_id: int) -> DataFrame | None:
        """Counts of earlier batches: one row each."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.counts.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.counts.all().where(F.col("batch_id") < batch_id)

    def take(self, rows: DataFrame, batch_id: int) -> None:
        self.given.write(rows, batch_id)
        given = self.given.batch(batch_id)
        before, mark, near = self._before(batch_id), None, []
        if before is not None:
            delay = F.unix_micros(F.expr(f"TIMESTAMP_SECONDS(0) + INTERVAL {self.delay}"))
            mark = before.select((F.unix_micros(F.max("last_ts")) - delay).alias("mark")).first()["mark"]
            # Batches with kept rows that a row of this one may repeat; at most one number a batch.
            open_ = (F.col("untimed") > 0) | F.lit(mark is None) | (F.unix_micros("last_ts") >= F.lit(mark))
            near = [r["batch_id"] for r in before.where((F.col("kept") > 0) & open_).select("batch_id").toLocalIterator()]
        us = F.unix_micros(self.ts)
        behind = F.coalesce(us < F.lit(mark).cast("long"), F.lit(False))
        timely, known, columns = given.where(~behind), F.col(self.event).isNotNull(), given.columns
        first = timely.where(known).groupBy(self.event).agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
        if near:
            earlier = self.kept.all().where(F.col("batch_id").isin(near)).select(self.event)
            first = first.join(earlier, self.event, "left_anti").select(*columns)
        self.late.write(given.where(behind), batch_id)
        self.kept.write(first.unionByName(timely.where(~known)), batch_id)
        tables = {"given": self.given, "kept": self.kept, "late": self.late}
        sizes = [table.batch(batch_id).select(F.lit(name).alias("fate"), F.col(self.ts).alias("ts")) for name, table in tables.items()]
        of = sizes[0].unionAll(sizes[1]).unionAll(sizes[2]).agg(
            *[F.count_if(F.col("fate") == name).alias(name) for name in tables],
            F.count_if((F.col("fate") == "kept") & F.col("ts").isNull()).alias("untimed"),
            F.max(F.when(F.col("fate") == "kept", F.col("ts"))).alias("last_ts"))
        watermark = F.timestamp_micros(F.lit(mark).cast("long")).alias("watermark")
        repeated = (F.col("given") - F.col("kept") - F.col("late")).alias("repeated")
        self.counts.write(of.select("given", "kept", "late", repeated, "untimed", watermark, "last_ts"), batch_id)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Take what has arrived, batch by batch."""
        timed = stream.withColumn(self.ts, F.col(self.ts).cast("timestamp"))
        return (
            timed.writeStream.outputMode("append").foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
