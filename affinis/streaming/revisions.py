"""Tables that take one revision per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from affinis.operators.latest import latest_per_key


class RevisionTable:
    """Parquet folder with one partition per micro-batch.

    A batch writes only its own partition and overwrites it when replayed, so a
    failed and repeated batch changes nothing and no batch rewrites the table.
    Reading takes the newest revision of each key.

    With ``key`` the rows of a batch are also split into folders by key bucket,
    so that reading a few keys opens only their buckets.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | None = None, buckets: int = 64):
        self.spark = spark
        self.path = path
        self.schema = schema
        self.key = key
        self.buckets = buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        path = f"{self.path}/batch_id={batch_id}"
        if self.key is None:
            rows.write.mode("overwrite").parquet(path)
        else:
            # Rebalancing joins small pieces and splits a bucket with a busy key.
            placed = rows.select("*", self._bucket()).hint("rebalance", "bucket")
            placed.write.mode("overwrite").partitionBy("bucket").parquet(path)

    def batch(self, batch_id: int) -> DataFrame:
        return self.all().where(F.col("batch_id") == batch_id).drop("batch_id")

    def _stored(self) -> DataFrame:
        placed = "" if self.key is None else ", bucket int"
        return self.spark.read.schema(f"{self.schema}, batch_id long{placed}").parquet(self.path)

    def all(self) -> DataFrame:
        """Every stored row with its ``batch_id``."""
        return self._stored().drop("bucket")

    def of_keys(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """All rows of the given keys up to a batch; other buckets are not read."""
        rows = self._stored().where(F.col("batch_id") <= batch_id)
        if self.key is not None:
            # At most one number per bucket.
            touched = [r["bucket"] for r in keys.select(self._bucket()).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(touched)).drop("bucket")
        name = self.key or keys.columns[0]
        return rows.drop("batch_id").join(keys.select(name).distinct(), name, "left_semi")

    def upto(self, batch_id: int) -> DataFrame:
        return self.all().where(F.col("batch_id") <= batch_id)

    def latest(self, key: str) -> DataFrame:
        """The newest row of each key."""
        return latest_per_key(self.all(), key, ["batch_id"]).drop("batch_id")

    def latest_lists(self, key: str) -> DataFrame:
        """All rows of the newest revision of each key."""
        rows = self.all()
        newest = rows.groupBy(key).agg(F.max("batch_id").alias("batch_id"))
        return rows.join(newest, [key, "batch_id"], "left_semi").drop("batch_id")

    def compact(self, key: str, path: str) -> "RevisionTable":
        """A copy holding only the newest revision of each key, as batch 0."""
        copy = RevisionTable(self.spark, path, self.schema)
        copy.write(self.latest_lists(key), 0)
        return copy
