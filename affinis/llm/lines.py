"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` keeps what lines have been seen as runs: tables of (key, owner) hashed into the same buckets and
sorted by key, so that a merge join reads them without a shuffle or sort of their own. A batch of documents
counts its own keys first, is merge-anti-joined with every run, and adds the keys that are new as a run of
level 0. When a level holds ``FANOUT`` runs they are compacted into one run of the next, so a key meets few
runs however many batches there were. Batches must come in the order of ids: then the owner of a key, the
smallest id that holds it, never changes once written. ``drops`` makes a batch for every ``BATCH_BYTES`` of text, and at
least one more than fill a level, so that runs are compacted at any size.

Keys are MD5 hashes of stripped, lower-cased lines. Only hashes, ids and places are shuffled; a line that a
third of all documents share is summed before the shuffle, and its drops are found by an anti-join on
(key, document), which spreads it. Whole texts move once, to meet their drops.

Defined results: ids are of any type that can be ordered. Null and empty texts are one empty line. Rows of one id are one document, and so are rows
without id, which come last. Repeated rows are treated alike. An empty table gives an empty one. Other columns
pass through ``dedup`` untouched, whatever their names; ``line_counts`` does not read them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from affinis.llm.store import fresh, named, rename, settle

MIN_LENGTH = 10
FANOUT = 4
BATCH_BYTES = 1 << 38
EDGE_SAMPLE = 200
SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower."""
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _positions(docs: DataFrame) -> DataFrame:
    """(key, doc, text_hash, place) of every line long enough, of documents (doc, text)."""
    at = docs.select("doc", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.posexplode(text_lines(F.col("text"))).alias("place", "line"))
    at = at.withColumn("line", line_key(F.col("line"))).where(F.length("line") >= MIN_LENGTH)
    return at.select(F.unhex(F.md5("line")).alias("key"), "doc", "text_hash", "place")


class LineRuns:
    """Runs of seen keys in the shared folder, kept by one job."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.compacted: list[str] = []

    def _add(self, keys: DataFrame, level: int) -> DataFrame:
        """One bucketed, sorted run of (key, doc); rows already lie by key, so each task writes its bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        keys.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").option(
            "path", fresh(self.spark, name)).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return self.spark.table(name)

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of ``_positions`` rows; returns those to drop."""
        keys = lines.groupBy("key").agg(F.min("doc").alias("doc"))
        for name in (n for level in self.levels for n in level):
            keys = keys.join(self.spark.table(name).hint("merge"), "key", "left_anti")
        mine = self._add(keys, 0).withColumnRenamed("key", "its_key").withColumnRenamed("doc", "owner")
        self._compact()
        return lines.join(mine, (F.col("key") == F.col("its_key")) & F.col("doc").eqNullSafe(F.col("owner")), "left_anti")

    def _compact(self) -> None:
        """The runs of a level stay on disk until the job's tables go: batches already planned read them."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= FANOUT:
                runs = [self.spark.table(n) for n in self.levels[level]]
                merged = runs[0]
                for run in runs[1:]:
                    merged = merged.unionByName(run)
                self.compacted += self.levels[level]
                self.levels[level] = []
                self._add(merged, level + 1)
            level += 1

    def close(self) -> None:
        """Take all runs out of the catalogue, once nothing that reads them is left to run."""
        for name in (*self.compacted, *(n for level in self.levels for n in level)):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self.compacted = [[]], []


def _edges(docs: DataFrame, batches: int | None) -> list:
    """Ids that part the documents into ``batches`` ranges of about equal numbers, from those with the least hashes:
    ``EDGE_SAMPLE`` a batch reach the driver. They set the sizes of batches and nothing else.

    Without a number, there is a batch for every ``BATCH_BYTES``, and at least ``FANOUT`` + 1.
    """
    if batches is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        batches = max(FANOUT + 1, -(-size // BATCH_BYTES))
    least = docs.where(F.col("doc").isNotNull()).select("doc", F.xxhash64("doc").alias("h")).orderBy("h").limit(EDGE_SAMPLE * batches)
    ids = [r["doc"] for r in least.orderBy("doc").collect()]
    return [ids[len(ids) * i // batches] for i in range(1, batches)] if ids else [None] * (batches - 1)


def drops(docs: DataFrame, batches: int | None = None) -> DataFrame:
    """(doc, text_hash, places): the places of lines to drop, one row per distinct document text that has any.

    ``docs`` has columns doc and text. One scan stores the hashed lines; the batches are ranges of ids.
    """
    edges = _edges(docs, batches)
    batch = F.coalesce(sum(((F.col("doc") > F.lit(e)).cast("int") for e in edges), F.lit(0)), F.lit(len(edges)))
    lines = settle(_positions(docs).withColumn("batch", batch), "lines")
    runs, found = LineRuns(docs.sparkSession), []
    try:
        for b in range(len(edges) + 1):
            found.append(settle(runs.add(lines.where(F.col("batch") == b).drop("batch")).select("doc", "text_hash", "place"), "line-drops"))
    finally:
        runs.close()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("doc", "text_hash").agg(F.collect_set("place").alias("places"))


def _marked(docs: DataFrame, id_col: str, text_col: str, batches: int | None) -> tuple[DataFrame, Column, Column]:
    """``docs`` with one more column; its expressions for all lines and for the kept ones."""
    doc, text = named(id_col), named(text_col)
    out = drops(docs.select(doc.alias("doc"), text.alias("text")), batches)
    names: dict[str, str] = {}
    for c in ("doc", "text_hash", "places"):
        names[c] = rename([*docs.columns, *names.values()], f"_drop_{c}")
    out = out.select(*(F.col(c).alias(n) for c, n in names.items()))
    same = doc.eqNullSafe(F.col(names["doc"])) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(names["text_hash"]))
    joined = docs.join(out, same, "left").drop(names["doc"], names["text_hash"])
    lines, places = text_lines(text), F.col(names["places"])
    # A set difference of numbers is hashed, so long texts cost no more per line than short ones.
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places), lambda i: F.get(lines, i))
    return joined, lines, F.when(places.isNull(), lines).otherwise(kept)


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped and the kept text."""
    joined, lines, kept = _marked(docs.select(named(id_col), named(text_col)), id_col, text_col, batches)
    held = joined.select(named(id_col).alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    return held.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None) -> DataFrame:
    """``docs`` with the kept lines as text. A null text stays null; no row goes."""
    joined, _, kept = _marked(docs, id_col, text_col, batches)
    text = F.when(named(text_col).isNotNull(), F.array_join(kept, "\n"))
    return joined.select(*(text.alias(c) if c == text_col else named(c) for c in docs.columns))
