"""Ranked lexical search: an inverted index over all documents, searched by a hybrid of term- and document-at-a-time.

``build_index`` deals the documents into shards, in each of which documents are numbered by ascending id, and stores
a posting list for every term of a shard: document numbers, frequencies, and for each block of ``BLOCK`` postings the
highest frequency and the least document length, which bound the score that any document of the block gets.

``search`` takes queries in blocks. In each shard a query's short lists are summed at once into accumulators
(term-at-a-time). The accumulators then act as one more list, bounded by their highest sum, beside the long lists in a
document-at-a-time pass over ascending windows of documents: lists whose bounds together can't lift a document over
the present k-th score offer no candidates any more, they are only probed by search for what other lists offer, the
strongest first, and candidates whose bounds fall short are dropped before the next probe. Windows whose block bounds
fall short are skipped. All scores are exact whole numbers; the bounds only save work.

At scale: the texts are read once and not shuffled; a shard holds ``SHARD_TOKENS`` tokens or one document and at most
``SHARD_DOCS`` documents. Only the lists of the queries' terms are read and dealt by shard, a task holds one shard's at
a time. A block of queries with at most about ``QUERY_TERMS`` terms is broadcast. A shard returns k rows a query, so the last
step ranks k rows a query and shard.

Score: a term's weight w is floor(1000 * ln((2 N + 2) / (2 df + 1))), a document's m is 10 + (90 n N) div L, and its
score is the sum of w * ((10^9 tf) div (1000 tf + 8 m)); N, L: documents with terms, and their terms with repeats.

Defined results: null and empty texts have no terms, are in no list and not in N; a query without terms, or whose terms
no document holds, gets no rows; of a query's repeated terms one counts; repeated documents rank each, repeated queries
each get their own rows; equal scores go by ascending id, null ids last; empty tables give empty ones; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from affinis.llm import words as W
from affinis.llm.store import settle

TOP = 10
SHARD_TOKENS = 1 << 21
SHARD_DOCS = 1 << 16
BLOCK = 128
SHORT = 256
WINDOW = 1024
QUERY_TERMS = 1_000_000
_U = np.uint64


def _contiguous(w: W.Words) -> pa.Array:
    """The words as strings."""
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    data = w.data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(w.start), pa.py_buffer(offsets), pa.py_buffer(data))


# The index

class _Shard:
    """Documents of one shard as they come: word hashes of each, and a string for each hash."""

    def __init__(self):
        self.ids: list = []
        self.sizes: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.names: list[tuple[np.ndarray, pa.Array]] = []
        self.tokens = self.docs = 0

    def add(self, ids: pa.Array, w: W.Words) -> None:
        h = W.hashes(w)
        distinct, first = np.unique(h, return_index=True)
        self.ids.append(ids)
        self.sizes.append(np.diff(w.doc))
        self.hashes.append(h)
        self.names.append((distinct, _contiguous(w).take(pa.array(first))))
        self.tokens += len(h)
        self.docs += len(ids)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(self.ids)
        size = np.concatenate(self.sizes)
        # Documents by ascending id, null last; those without terms go.
        by_id = pa.compute.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()
        by_id = by_id[size[by_id] > 0]
        place = np.zeros(len(size), np.int64)
        place[by_id] = np.arange(len(by_id))
        h, doc = np.concatenate(self.hashes), np.repeat(place, size)
        n_tokens = len(h)
        if not len(by_id):
            return
        ids, size = ids.take(pa.array(by_id)), size[by_id]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        tf, h, doc = np.diff(np.append(at, len(h))), h[at], doc[at]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        ends = np.append(starts[1:], len(h))
        # Blocks of each list.
        n_blocks = -(-(ends - starts) // BLOCK)
        block_of = np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        block_at = np.repeat(starts, n_blocks) + (np.arange(n_blocks.sum()) - block_of) * BLOCK
        most, least = np.maximum.reduceat(tf, block_at), np.minimum.reduceat(size[doc], block_at)
        known, first = np.unique(np.concatenate([x for x, _ in self.names]), return_index=True)
        names = pa.concat_arrays([x for _, x in self.names]).take(pa.array(first[np.searchsorted(known, h[starts])]))

        def lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
            width = np.dtype(kind).itemsize
            offsets = np.concatenate([[0], ends * width]).astype(np.int32)
            return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype(kind))])

        every = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([
            pa.array([shard]), pa.array([None], pa.string()), pa.array([len(ids)]), pa.array([n_tokens]), pa.array([size.astype(np.uint32).tobytes()], pa.binary()),
            *[pa.array([b""], pa.binary())] * 3, every], _COLUMNS)
        for s in range(0, len(starts), 100_000):
            e = min(s + 100_000, len(starts))
            p, b = slice(starts[s], ends[e - 1]), slice(int(n_blocks[:s].sum()), int(n_blocks[:e].sum()))
            b_ends = np.cumsum(n_blocks[s:e])
            none = pa.ListArray.from_arrays(pa.array([None] * (e - s) + [0], pa.int32()), ids.slice(0, 0))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(e - s, shard)), names.slice(s, e - s), pa.array(ends[s:e] - starts[s:e]), pa.array(np.add.reduceat(tf[p], starts[s:e] - starts[s])),
                lists(doc[p], ends[s:e] - starts[s], np.uint16), lists(tf[p], ends[s:e] - starts[s], np.uint32),
                lists(most[b], b_ends, np.uint32), lists(least[b], b_ends, np.uint32), none], _COLUMNS)


_COLUMNS = ["shard", "term", "n", "words", "docs", "tfs", "most", "least", "ids"]


def _index(shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        parts = (batch.slice(i, SHARD_DOCS) for batch in batches for i in range(0, batch.num_rows, SHARD_DOCS))
        for batch in parts:
            for first, data, offsets in W.chunks(batch.column("text")):
                w = W.split(data, offsets, W.NOT_ALNUM, lower=True)
                n = len(offsets) - 1
                if shard.docs and (shard.tokens + len(w.start) > shard_tokens or shard.docs + n > SHARD_DOCS):
                    yield from shard.rows(number)
                    number, shard = number + 1, _Shard()
                shard.add(batch.column("id").slice(first, n), w)
        if shard.docs:
            yield from shard.rows(number)
    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The stored index: a row per shard and term (n documents), and one per shard without a term that holds ids and lengths."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"shard long, term string, n long, words long, docs binary, tfs binary, most binary, least binary, ids array<{kind}>"
    return settle(rows.mapInArrow(_index(shard_tokens), schema), "lexical-index")


# The search

class Query(NamedTuple):
    number: int
    terms: np.ndarray  # numbers of its terms


class Postings(NamedTuple):
    """One term's list in a shard, with its weight in the bounds and scores."""

    weight: int
    docs: np.ndarray
    tf: np.ndarray
    bounds: np.ndarray  # of blocks, with the weight
    bound: int


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def normed(length: np.ndarray, n: int, total: int) -> np.ndarray:
    return 10 + 90 * length.astype(np.int64) * n // max(total, 1)


def _short(lists: list[Postings], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Accumulators: documents of all these lists, ascending, and their summed scores."""
    docs = np.concatenate([p.docs for p in lists])
    score = np.concatenate([p.weight * impact(p.tf, m[p.docs]) for p in lists])
    found, at = np.unique(docs, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, at, score)
    return found, sums


def top(lists: list[Postings], m: np.ndarray, k: int, short: int = SHORT, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a shard and their scores, best first; of equal ones those of smaller number."""
    few = [p for p in lists if len(p.docs) <= short]
    long = sorted((p for p in lists if len(p.docs) > short), key=lambda p: p.bound)
    acc, sums = _short(few, m) if few else (np.empty(0, np.int64), np.empty(0, np.int64))
    best_doc, best, least = np.empty(0, np.int64), np.empty(0, np.int64), 0
    acc_bound = int(sums.max(initial=0))
    # Bounds of the long lists up to each, the weakest first.
    up_to = np.concatenate([[0], np.cumsum([p.bound for p in long])]).astype(np.int64)
    cut = [0] * len(long)  # where each list's next window begins
    acc_cut = 0
    for first in range(0, len(m) if long else min(len(m), 1), window if long else max(len(m), 1)):
        last = first + window if long else len(m)
        acc_end = int(np.searchsorted(acc, last))
        a_docs, a_sums = acc[acc_cut:acc_end], sums[acc_cut:acc_end]
        acc_cut = acc_end
        spans, local = [], []
        for i, p in enumerate(long):
            end = int(np.searchsorted(p.docs, last))
            spans.append((cut[i], end))
            local.append(int(p.bounds[cut[i] // BLOCK: -(-end // BLOCK)].max()) if end > cut[i] else 0)
            cut[i] = end
        if int(a_sums.max(initial=0)) + sum(local) <= least:
            continue
        # The weakest lists, whose bounds together fall short, offer no candidates; with the accumulators among them, nor do those.
        idle = int(np.searchsorted(up_to, least, "right")) - 1
        offers = [p.docs[s:e] for p, (s, e) in zip(long[idle:], spans[idle:])]
        if up_to[idle] + acc_bound > least:
            offers.append(a_docs[a_sums + up_to[idle] > least])
        found = np.unique(np.concatenate(offers).astype(np.int64)) if offers else np.empty(0, np.int64)
        if not len(found):
            continue
        score = np.zeros(len(found), np.int64)
        _add(score, found, a_docs, a_sums)
        rest = sum(local)
        # The strongest list first; after each, candidates that can't get over the k-th go.
        for i in reversed(range(len(long))):
            keep = score + rest > least
            if not keep.all():
                found, score = found[keep], score[keep]
            if not len(found):
                break
            p, (s, e) = long[i], spans[i]
            rest -= local[i]
            if e == s:
                continue
            at = np.minimum(np.searchsorted(p.docs[s:e], found), e - s - 1) + s
            same = np.flatnonzero(p.docs[at] == found)
            score[same] += p.weight * impact(p.tf[at[same]], m[found[same]])
        keep = score > least
        if keep.any():
            best_doc, best = np.concatenate([best_doc, found[keep]]), np.concatenate([best, score[keep]])
            order = np.lexsort((best_doc, -best))[:k]
            best_doc, best = best_doc[order], best[order]
            if len(best) == k:
                least = int(best[-1])
    return best_doc, best


def _add(score: np.ndarray, found: np.ndarray, docs: np.ndarray, values: np.ndarray) -> None:
    """Adds the values of those of ``docs`` that are among ``found``."""
    if not len(docs):
        return
    at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
    same = docs[at] == found
    score[same] += values[at[same]]


def _search(shared, k: int):
    """Shards one after the other: the row with lengths first, then the lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n, total = shared.value
        now, ids, m, lists = None, None, None, {}

        def ranked() -> Iterator[pa.RecordBatch]:
            for q in queries:
                mine = [lists[t] for t in q.terms if t in lists]
                if mine:
                    docs, score = top(mine, m, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(docs), q.number)), ids.take(pa.array(docs)), pa.array(score)], ["query", "doc", "score"])

        for batch in batches:
            shards, terms, weights = (batch.column(c).to_pylist() for c in ("shard", "number", "weight"))
            docs, tfs, most, least = (batch.column(c) for c in ("docs", "tfs", "most", "least"))
            for i, shard in enumerate(shards):
                if shard != now:
                    if lists:
                        yield from ranked()
                    now, lists = shard, {}
                if terms[i] is None:
                    m = normed(np.frombuffer(docs[i].as_buffer(), np.uint32), n, total)
                    ids = batch.column("ids")[i].values
                    continue
                bounds = weights[i] * impact(np.frombuffer(most[i].as_buffer(), np.uint32), normed(np.frombuffer(least[i].as_buffer(), np.uint32), n, total))
                lists[terms[i]] = Postings(
                    weights[i], np.frombuffer(docs[i].as_buffer(), np.uint16), np.frombuffer(tfs[i].as_buffer(), np.uint32), bounds, int(bounds.max()))
        if lists:
            yield from ranked()
    return run


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, item, term): each row of the queries with a number, and its distinct terms."""
    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    return rows.select("query", "item", F.explode(F.array_distinct(found)).alias("term"))


def search(
    index: DataFrame, queries: DataFrame, k: int = TOP, item_col: str = "item_id", text_col: str = "text", block_terms: int = QUERY_TERMS,
) -> DataFrame:
    """The k highest-scoring documents of every query: its id (under its own name), rank, doc_id and score."""
    spark = index.sparkSession
    pairs = settle(query_terms(queries, item_col, text_col), "query-terms")
    kind, item_kind = index.schema["ids"].dataType.elementType.simpleString(), queries.schema[item_col].dataType.simpleString()
    heads = index.where(F.col("term").isNull())
    n, total = heads.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    df = index.where(F.col("term").isNotNull()).join(pairs.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    terms = settle(df.select("term", F.monotonically_increasing_id().alias("number"), weight.alias("weight")), "query-weights")
    used = settle(pairs.join(terms, "term").select("query", "number"), "query-pairs")
    blocks = -(-used.count() // block_terms)
    found = []
    for block in range(blocks):
        mine = used.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        table = mine.orderBy("query", "number").toArrow()
        query, number = table.column("query").to_numpy(), table.column("number").to_numpy()
        cut = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else []
        shared = spark.sparkContext.broadcast((
            [Query(int(query[s]), number[s:e]) for s, e in zip(cut, np.append(cut[1:], len(query)))], n, total))
        wanted = terms.join(mine, "number", "left_semi") if blocks > 1 else terms
        lists = index.where(F.col("term").isNotNull()).join(wanted, "term").select("shard", "number", "weight", "docs", "tfs", "most", "least", "ids")
        nothing = F.lit(None).cast("long")
        rows = lists.unionByName(heads.select("shard", nothing.alias("number"), nothing.alias("weight"), "docs", "tfs", "most", "least", "ids"))
        rows = rows.repartition("shard").sortWithinPartitions("shard", F.col("number").asc_nulls_first())
        found.append(settle(rows.mapInArrow(_search(shared, k), f"query long, doc {kind}, score long"), "query-hits"))
    if not found:
        found = [spark.createDataFrame([], f"query long, doc {kind}, score long")]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionAll(more)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    items = pairs.groupBy("query").agg(F.first("item").alias("item"))
    return ranked.join(items, "query").select(F.col("item").alias(item_col), "rank", F.col("doc").alias("doc_id"), "score")
