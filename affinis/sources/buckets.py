"""Tables split by a hash of their key, in which reads and changes touch only the buckets of the keys asked for.

A change reads the touched buckets, applies the documents' upserts, patches and deletes, and overwrites just these partitions
(Spark's dynamic partition overwrite). Rows are sorted by key within each file, so that the row groups' bounds and bloom
filters of the key skip most of an opened bucket too.

At scale: the number of buckets is the only thing collected to the driver; ``buckets`` sets how small the part is that one
change touches, and should leave buckets of at least some row groups. A bucket that has grown beyond one file's size is split into
several files by the rebalancing write. New rows are stored in the shared folder before a partition is replaced,
so no task reads what is being overwritten.

Defined results: null keys are a key like others (one bucket); changes follow ``sources.index``: unknown ids of patches and deletes are
ignored, a repeated id without a version fails the job before anything is written; a batch without rows changes nothing; a bucket whose last row is
deleted stays as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from affinis.session import settled
from affinis.sources import index

_GONE = "_gone"
# Sources one task makes rows of; the rows, several times as large, are sorted in its memory.
SOURCE_BYTES = 32 * 1024 * 1024
# Bytes of a source for each different value of the sort column, for the size of filters.
_KEY_BYTES = 16


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "id", buckets: int = 64, sort: str | None = None):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self.sort = sort or key

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        schema = StructType([*self.schema.fields]).add(_GONE, BooleanType()).add("bucket", IntegerType())
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().where(~F.col(_GONE)).select(*self.schema.names)

    def touched(self, keys: DataFrame) -> list[int]:
        """Numbers of the buckets that hold these keys."""
        return sorted(r["bucket"] for r in keys.select(self.key).select(self._bucket().alias("bucket")).distinct().toLocalIterator())

    def part(self, buckets: list[int]) -> DataFrame:
        return self._stored().where(F.col("bucket").isin(buckets) & ~F.col(_GONE)).select(*self.schema.names)

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys; other buckets are not opened."""
        return self.part(self.touched(keys)).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def replace(self, buckets: list[int], rows: DataFrame) -> None:
        """These buckets hold ``rows`` from now on, which must all belong to them."""
        if not buckets:
            return
        placed = settled(rows.select(*self.schema.names, F.lit(False).alias(_GONE), self._bucket().alias("bucket")))
        self._write(placed.unionByName(self._marks(buckets)).hint("rebalance", "bucket"), placed.count() // len(buckets))

    def _marks(self, buckets: list[int]) -> DataFrame:
        """One mark a bucket, so that one left without rows is overwritten too."""
        return self.spark.range(1).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(True).alias(_GONE),
            F.explode(F.array(*map(F.lit, buckets))).alias("bucket"))

    def _write(self, placed: DataFrame, keys: int) -> None:
        # Filters of about the size that a bucket's keys need; by default each would take a megabyte.
        (placed.sortWithinPartitions("bucket", self.sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket")
            .option(f"parquet.bloom.filter.enabled#{self.sort}", "true")
            .option(f"parquet.bloom.filter.expected.ndv#{self.sort}", str(max(1, keys))).parquet(self.path))

    def create(self, rows: DataFrame) -> None:
        self.replace(list(range(self.buckets)), rows)

    def create_from(self, sources: DataFrame, made: Callable[[DataFrame], DataFrame], size: Column) -> None:
        """A new table of the rows that ``made`` makes of each row of ``sources``, which has the key and isn't read from this table.

        Sources travel to their buckets, not the rows made of them, which may be many times as large; nothing else is stored or
        moved. ``size`` is a source's bytes: a task makes the rows of about ``SOURCE_BYTES`` of a bucket, and writes one file.
        """
        total = sources.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
        files = max(1, -(-total // (self.buckets * SOURCE_BYTES)))
        # Another hash than that of the buckets, or most parts would stay empty.
        dealt = sources.withColumn("_part", self._bucket() * files + F.pmod(F.hash(*sources.columns), F.lit(files)))
        dealt = dealt.repartitionById(self.buckets * files, "_part").drop("_part")
        rows = made(dealt).select(*self.schema.names, F.lit(False).alias(_GONE), self._bucket().alias("bucket"))
        self._write(rows.unionByName(self._marks(list(range(self.buckets)))), total // (self.buckets * files * _KEY_BYTES))

    def change(
        self, upserts: DataFrame | None = None, patches: DataFrame | None = None, deletes: DataFrame | None = None, version: str | None = None,
    ) -> list[int]:
        """One batch of changes: whole documents, then fields, then deletions. Returns the buckets it touched."""
        given = [settled(df) if df is not None else None for df in (upserts, patches, deletes)]
        keys = [df.select(self.key) for df in given if df is not None]
        if not keys:
            return []
        every = keys[0]
        for more in keys[1:]:
            every = every.unionAll(more)
        buckets = self.touched(every)
        rows = self.part(buckets)
        upserts, patches, deletes = given
        if upserts is not None:
            rows = index.upsert(rows, upserts, self.key, version)
        if patches is not None:
            rows = index.patch(rows, patches, self.key, version)
        if deletes is not None:
            rows = index.delete(rows, deletes, self.key)
        self.replace(buckets, rows)
        return buckets
