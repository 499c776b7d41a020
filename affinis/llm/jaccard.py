"""Near duplicates: a Jaccard join of word shingles with Bayesian candidate pruning.

Texts of the same words (A-Z lower, white space aside) are one class; one text stands for it. Classes that agree
in a band of MinHash values are candidates. In a bucket of candidates MinHash values are compared a few at a
time: a pair is dropped as soon as the posterior probability that its similarity reaches the threshold (uniform
prior, binomial matches) is below ``TOLERANCE``. What is left is verified exactly on the sets of shingles.

With 32 bands of 4 values a pair at 0.8 is missed with probability 5e-8, one at 0.9 with 1e-15; pruning adds the
tolerance per comparison. Similarity is exact for all that are verified.

At scale: no pair is ever a row. A bucket is worked on in blocks of ``BLOCK`` members, one pair of blocks at a
time, and gives back one row per member: its number of links and a link towards the smallest member it is
connected to. A pair that meets in several bands counts in the first. Signatures (256 bytes) travel first; texts
only go to buckets where a pair survived the pruning. Group sizes are known before rows are dealt, so no task
gets a whole large bucket. Rounds of stars join the links into groups.

Defined results: documents without words (null, empty) are never linked and each is its own class. Shorter texts
than a shingle have one shingle, all their words. Repeated rows are copies. Ids may be null or repeat: rows are
told apart by a number given when the table is stored. An empty table gives an empty one. Other columns are
carried by ``keep`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from affinis.llm import words as W
from affinis.llm.components import components
from affinis.llm.store import named, rename, settle

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
TOLERANCE = 1e-9
STEP = 16
BLOCK = 512
_U = np.uint64

_MULTIPLIERS = W.mix(np.arange(1, BANDS * ROWS + 1, dtype=_U)) | _U(1)
_MASKS = W.mix(np.arange(10_001, 10_001 + BANDS * ROWS, dtype=_U))


def shingles(w: W.Words, h: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and how many each text has."""
    n = np.diff(w.doc)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.cumsum(counts)
    out = np.empty(ends[-1] if len(ends) else 0, _U)
    long = np.repeat(n >= size, counts)
    if len(h) >= size:
        out[long] = W.grams(h, size)[W.inside(w.doc, size, len(h))]
    for i in np.flatnonzero((n > 0) & (n < size)):
        out[ends[i] - 1] = W.grams(h[w.of(i)], n[i])[0] ^ _U(n[i])
    return out, counts


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of MinHash values per text, 16 bits each, four to a number; rows without shingles are 0."""
    some = np.flatnonzero(counts)
    out = np.zeros((len(counts), BANDS * ROWS), np.uint16)
    if len(some):
        first = (np.cumsum(counts) - counts)[some]
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat((values ^ _MASKS[k]) * _MULTIPLIERS[k], first)
            out[some, k] = (W.mix(least) & _U(0xFFFF)).astype(np.uint16)
    return out.view(np.int64)


def needed_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By number of values compared: the fewest matches with posterior P(similarity >= threshold) >= tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(log - log.max())
            if density[grid >= threshold].sum() >= tolerance * density.sum():
                out[n] = m
                break
    return out


def survivors(a: np.ndarray, others: np.ndarray, band: int, needed: dict[int, int]) -> np.ndarray:
    """Indices of ``others`` (rows of signatures) that ``a`` first meets in ``band`` and that are not pruned."""
    alive = np.flatnonzero((others[:, band] == a[band]) & ~(others[:, :band] == a[:band]).any(axis=1))
    x, y = a.view(np.uint16), others.view(np.uint16)
    matches = np.zeros(len(alive), np.int64)
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        if not len(alive):
            break
        matches += (y[alive, n - STEP: n] == x[n - STEP: n]).sum(axis=1)
        keep = matches >= needed[n]
        alive, matches = alive[keep], matches[keep]
    return alive


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in W.chunks(batch.column("text")):
            w = W.split(data, offsets, lower=True)
            h = W.hashes(w)
            signed = signatures(*shingles(w, h))
            n = len(offsets) - 1
            some = np.diff(w.doc) > 0
            key = [hashlib.md5(h[w.of(i)].tobytes()).digest() if some[i] else None for i in range(n)]
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(signed.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("rid").slice(first, n), pa.array(key, pa.binary()), sig], ["rid", "key", "sig"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Groups of rows that follow each other with equal keys, as columns; a group may span batches."""
    held: list[pa.RecordBatch] = []

    def columns() -> dict[str, list]:
        t = pa.Table.from_batches(held)
        return {c: t.column(c) for c in t.column_names}

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(marks[:, a])
            if now != last and held:
                yield columns()
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield columns()


_GROUP = ["band", "bucket", "bi", "bj"]


def _matrix(column) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).reshape(-1, BANDS)


def _candidates(sig: np.ndarray, block: np.ndarray, band: int, bi: int, bj: int, needed) -> Iterator[tuple[int, np.ndarray]]:
    """For each member of the first block, the members it stays a candidate with."""
    if bi == bj:
        for i in range(len(sig) - 1):
            yield i, i + 1 + survivors(sig[i], sig[i + 1:], band, needed)
    else:
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        other = np.ascontiguousarray(sig[right])
        for i in left:
            yield i, right[survivors(sig[i], other, band, needed)]


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a bucket that still have a candidate, once each."""
    needed = needed_matches()
    names = ["rid", *_GROUP, "block"]
    out: list[tuple] = []
    for g in _runs(batches, _GROUP):
        sig, block = _matrix(g["sig"]), g["block"].to_numpy()
        band, bucket, bi, bj = (g[k][0].as_py() for k in _GROUP)
        hit = np.zeros(len(sig), bool)
        for i, with_ in _candidates(sig, block, band, bi, bj, needed):
            if len(with_):
                hit[i] = True
                hit[with_] = True
        rid = g["rid"].to_numpy()
        out.extend((int(rid[i]), band, bucket, bi, bj, int(block[i])) for i in np.flatnonzero(hit))
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a block, by products of slices of the incidence matrix."""
    sizes = [len(s) for s in sets]
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = seen[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [k, k + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - k] = 1
        out += part @ part.T
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = needed_matches(threshold)
        for g in _runs(batches, _GROUP):
            sig, block, rid = _matrix(g["sig"]), g["block"].to_numpy(), g["rid"].to_numpy()
            band, _, bi, bj = (g[k][0].as_py() for k in _GROUP)
            sets: list[np.ndarray] = []
            for piece in g["text"].chunks:
                for _, data, offsets in W.chunks(piece):
                    w = W.split(data, offsets, lower=True)
                    values, counts = shingles(w, W.hashes(w))
                    sets.extend(np.unique(v) for v in np.split(values, np.cumsum(counts)[:-1]))
            pairs = [(i, j) for i, j in _candidates(sig, block, band, bi, bj, needed) if len(j)]
            many = sum(len(j) for _, j in pairs) > 4 * len(sets)
            common = _intersections(sets) if many else None
            size = np.array([len(s) for s in sets])
            links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for i, js in pairs:
                both = common[i, js] if many else np.array([len(np.intersect1d(sets[i], sets[j], True)) for j in js])
                # J >= t, in whole numbers where t is a fraction such as 4/5
                near = js[both >= threshold * (size[i] + size[js] - both) - 1e-6]
                links[i] += len(near)
                links[near] += 1
                for j in near:
                    a, b = top(i), top(int(j))
                    if a != b:
                        if rid[b] < rid[a]:
                            a, b = b, a
                        root[b] = a
            linked = np.flatnonzero(links)
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[linked]), pa.array(rid[[top(int(i)) for i in linked]]), pa.array(links[linked])], ["rid", "root", "links"])
    return run


def _dealt(members: DataFrame) -> DataFrame:
    """Rows to their pairs of blocks, dealt and sorted so that a pair of blocks lies together."""
    keys = [F.col(k) for k in _GROUP]
    return members.repartition(*keys).sortWithinPartitions(*keys)


def classes(docs: DataFrame, text_col: str, rid: str, threshold: float = THRESHOLD) -> DataFrame:
    """For a stored table whose rows have a number ``rid``: rid, the class's and the group's smallest rid, links.

    Rows without words are absent.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(rid).alias("rid"), F.col(text_col).alias("text"))
    signed = settle(texts.mapInArrow(_sign, "rid long, key binary, sig array<long>").where("key is not null"), "signatures")
    # Stored, so that the join below is between two shuffles of tables and a class of very many copies can be split.
    firsts = settle(signed.groupBy("key").agg(F.min("rid").alias("class_rid")), "classes")
    members = settle(signed.select("rid", "key").join(firsts, "key").select("rid", "class_rid"), "members")
    alone = settle(signed.join(members.where("rid = class_rid").select("rid"), "rid").select("rid", "sig"), "class-signatures")

    banded = alone.select("rid", F.posexplode("sig").alias("band", "bucket"))
    sizes = banded.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    sizes = settle(sizes, "buckets")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = banded.join(sizes, ["band", "bucket"]).withColumn("block", F.pmod(F.xxhash64("rid"), blocks).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select(
        "rid", F.col("band").cast("long").alias("band"), "bucket", F.least("block", "other").cast("long").alias("bi"),
        F.greatest("block", "other").cast("long").alias("bj"), F.col("block").cast("long").alias("block"))
    members_ddl = "rid long, band long, bucket long, bi long, bj long, block long"
    met = settle(met, "bucket-members")
    kept = settle(_dealt(met.join(alone, "rid")).mapInArrow(_prune, members_ddl), "candidates")
    full = kept.join(alone, "rid").join(texts, "rid")
    found = settle(_dealt(full).mapInArrow(_verify(threshold), "rid long, root long, links long"), "links")

    groups = components(found.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("rid").agg(F.sum("links").alias("n_links"))
    facts = counts.join(groups.withColumnRenamed("node", "rid"), "rid", "full_outer").withColumnRenamed("rid", "class_rid")
    return members.join(facts, "class_rid", "left").select(
        "rid", "class_rid", F.coalesce("root", "class_rid").alias("group_rid"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    rid = rename(docs.columns, "_rid")
    return settle(docs.withColumn(rid, F.monotonically_increasing_id()), name), rid


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id; class_id, the smallest id of its group of near duplicates; copy_of, the
    smallest id of the documents with the same words; n_links, the number of other texts at the threshold."""
    rows, rid = _numbered(docs.select(id_col, text_col), "near-documents")
    found = classes(rows, text_col, rid, threshold)
    ids = rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("doc_id"))
    found = settle(ids.join(found, "rid", "left").select(
        "rid", "doc_id", F.coalesce("class_rid", "rid").alias("class_rid"), F.coalesce("group_rid", "rid").alias("group_rid"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "near-rows")
    copy_of = found.groupBy("class_rid").agg(F.min("doc_id").alias("copy_of"), F.first("group_rid").alias("group_rid"), F.first("n_links").alias("n_links"))
    copy_of = settle(copy_of, "near-classes")
    class_id = copy_of.groupBy("group_rid").agg(F.min("copy_of").alias("class_id"))
    facts = copy_of.join(class_id, "group_rid").select("class_rid", "class_id", "copy_of", "n_links")
    return found.select("doc_id", "class_rid").join(facts, "class_rid").select("doc_id", "class_id", "copy_of", "n_links")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id (ids first, then rows without), with the
    columns of ``docs``; rows without words all stay."""
    rows, rid = _numbered(docs, "near-documents")
    found = classes(rows, text_col, rid, threshold)
    ids = rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"))
    best = found.join(ids, "rid").groupBy("group_rid").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("rid"))).alias("best"))
    lost = settle(found.join(best, "group_rid").where(F.col("rid") != F.col("best.rid")).select(F.col("rid").alias(rid)), "near-lost")
    return rows.join(lost, rid, "left_anti").select(*(named(c) for c in docs.columns))
