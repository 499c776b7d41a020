"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A duplicate is a window of ``WINDOW`` words that starts at two places, in one document or two. Every window has
an anchor, the leftmost of its ``GRAM``-word grams with the smallest hash, so equal windows have equal anchors
at equal places. Neighbouring windows of one anchor form a piece of at most ``SPAN`` windows. The index keeps
pieces by anchor: the reference block of an anchor holds the different pieces around it. A piece whose anchor
occurs once has no duplicate. Where all pieces of an anchor are equal, or a piece occurs twice, all its windows
are duplicates. Any other piece is factored against every piece of its block: from the anchor each factor runs
left and right as far as the words agree, and the windows that lie within a factor of sufficient length, checked
up to the factor's boundaries, become duplicate spans.

At scale: about two words in 25 are anchors, and only their hashes are shuffled. A passage that very many
documents share has one piece inside and one per document at its edges; a block of more than ``BLOCK`` pieces
is not factored in one task: its pieces are cut into windows, whose 128-bit hashes are counted with partial
sums. Both ways give the same spans. Texts move twice, to cut the pieces that must be compared and to lose
their words; no group of documents ever meets in a task.

Defined results: null and empty texts have no words and keep the empty text; documents shorter than a window
lose nothing; repeated rows are duplicates of each other; an empty table gives an empty one. Ids may be null or
repeat: rows are told apart by a number given when the table is stored. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from affinis.llm import words as W
from affinis.llm.store import settle

WINDOW = 35
GRAM = 12
SPAN = WINDOW - GRAM + 1
BLOCK = 64
_U = np.uint64
_OTHER = 0xA24BAED4963EE407
_FULL = -1


def _leftmost(values: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest of ``width`` values from each place on is; the leftmost of equal ones."""
    have, place, size = values, np.arange(len(values)), 1
    out, out_place, done = None, None, 0
    while True:
        if width & size:
            if out is None:
                out, out_place = have[: len(values) - width + 1], place[: len(values) - width + 1]
            else:
                right, right_place = have[done: done + len(out)], place[done: done + len(out)]
                take = right < out
                out, out_place = np.where(take, right, out), np.where(take, right_place, out_place)
            done += size
        if size * 2 > width:
            return out_place
        take = have[size:] < have[:-size]
        place = np.where(take, place[size:], place[:-size])
        have = np.where(take, have[size:], have[:-size])
        size *= 2


def pieces_of(w: W.Words, h: np.ndarray):
    """Of a chunk of texts: first window, number of windows, anchor place, anchor hash and content hash of each piece."""
    none = np.empty(0, np.int64)
    if len(h) < WINDOW:
        return none, none, none, none.view(_U), none.view(_U)
    fits = W.inside(w.doc, WINDOW, len(h))
    grams = W.grams(h, GRAM)
    anchor = _leftmost(grams, SPAN)[: len(fits)]
    begins = fits.copy()
    begins[1:] &= ~fits[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(begins)
    ends = fits.copy()
    ends[:-1] &= ~fits[1:] | begins[1:]
    count = np.flatnonzero(ends) - start + 1
    whole = W.grams(h, WINDOW, _OTHER)
    at = anchor[start]
    content = W.mix(whole[start] * _U(3) + W.mix(whole[start + count - 1] + (at - start).astype(_U)) + count.astype(_U))
    return start, count, at, grams[at], content


def _texts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for first, data, offsets in W.chunks(batch.column("text")):
            w = W.split(data, offsets)
            yield batch.slice(first, len(offsets) - 1), w, W.hashes(w)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, w, h in _texts(batches):
        start, count, at, anchor, content = pieces_of(w, h)
        if len(start):
            doc = np.searchsorted(w.doc, start, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [rows.column("rid").take(pa.array(doc)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                 pa.array((start - w.doc[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array((at - start).astype(np.int32))],
                ["rid", "anchor", "content", "start", "n", "at"])


_CUT = "anchor long, content long, at int, n int, words binary, place int, high long, low long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the pieces asked for; of pieces in large blocks, a row per window instead."""
    names = [x.split()[0] for x in _CUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
    for rows, w, h in _texts(batches):
        low, high = (W.grams(h, WINDOW, base).view(np.int64) for base in (_OTHER, 0x9FB21C651E98DF25))
        out = []
        for i, wanted in enumerate(rows.column("wanted").to_pylist()):
            for x in wanted:
                a = int(w.doc[i]) + x["start"]
                if x["large"]:
                    out.extend((x["anchor"], x["content"], None, None, None, k, int(high[a + k]), int(low[a + k])) for k in range(x["n"]))
                else:
                    out.append((x["anchor"], x["content"], x["at"], x["n"], h[a: a + x["n"] + WINDOW - 1].tobytes(), None, None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def factor(pieces: list[np.ndarray], at: list[int], n: list[int]) -> list[int]:
    """For each piece of a block, as bits, the windows that lie within a factor against another piece."""
    width = SPAN - 1  # words left of the anchor, and right of it
    table = np.empty((len(pieces), 2 * width + GRAM), np.int64)
    there = np.zeros(table.shape, bool)
    for row, (words, a) in enumerate(zip(pieces, at)):
        table[row, width - a: width - a + len(words)] = words
        there[row, width - a: width - a + len(words)] = True
    out = []
    for i in range(len(pieces)):
        agree = (table == table[i]) & there & there[i]
        agree[i] = False
        ok = agree[:, width: width + GRAM].all(axis=1)
        left = np.minimum.accumulate(agree[:, :width][:, ::-1], axis=1).sum(axis=1)
        right = np.minimum.accumulate(agree[:, width + GRAM:], axis=1).sum(axis=1)
        bits = 0
        for a, b in {(int(a), int(b)) for a, b in zip(left[ok], right[ok])}:
            if a + GRAM + b >= WINDOW:
                for k in range(max(0, at[i] - a), min(n[i] - 1, at[i] + GRAM + b - WINDOW) + 1):
                    bits |= 1 << k
        out.append(bits)
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: each block is factored once its last piece is read."""
    held: list[tuple] = []
    out: list[tuple] = []

    def block() -> None:
        bits = factor([np.frombuffer(x[4], np.int64) for x in held], [x[2] for x in held], [x[3] for x in held])
        out.extend((x[0], x[1], b) for x, b in zip(held, bits) if b)

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("anchor", "content", "at", "n", "words"))):
            if held and held[0][0] != row[0]:
                block()
                held = []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor", "content", "bits"])
            out = []
    if held:
        block()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor", "content", "bits"])


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in W.chunks(batch.column("text")):
            rows = batch.slice(first, len(offsets) - 1)
            w = W.split(data, offsets)
            texts, gone = [], []
            for i, spans in enumerate(rows.column("spans").to_pylist()):
                part = w.of(i)
                start, end = w.start[part], w.end[part]
                keep = np.ones(len(start), bool)
                for x in spans or ():
                    if x["bits"] == _FULL:
                        keep[x["start"]: x["start"] + x["n"] + WINDOW - 1] = False
                    else:
                        for k in range(x["n"]):
                            if x["bits"] >> k & 1:
                                keep[x["start"] + k: x["start"] + k + WINDOW] = False
                text = data[offsets[i]: offsets[i + 1]].tobytes()
                at = offsets[i]
                texts.append(b" ".join(text[a - at: b - at] for a, b in zip(start[keep].tolist(), end[keep].tolist())).decode())
                gone.append(int((~keep).sum()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(w.doc)), pa.array(gone, pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "n_removed", "text"])


def duplicate_spans(rows: DataFrame) -> DataFrame:
    """For a stored table (rid, text): rid, first window, number of windows and bits of the duplicate ones."""
    index = settle(rows.select("rid", "text").mapInArrow(_index, "rid long, anchor long, content long, start int, n int, at int"), "pieces")
    repeated = index.groupBy("anchor").agg(F.count("*").alias("total"), F.min("content").alias("least"), F.max("content").alias("most"))
    repeated = settle(repeated.where("total > 1").select("anchor", (F.col("least") == F.col("most")).alias("equal")), "anchors")
    met = settle(index.join(repeated, "anchor"), "repeated-pieces")

    contents = met.where("not equal").groupBy("anchor", "content").agg(
        F.count("*").alias("times"), F.min(F.struct("rid", "start", "n", "at")).alias("one"))
    contents = settle(contents, "contents")
    large = settle(contents.groupBy("anchor").count().where(F.col("count") > BLOCK).select("anchor", F.lit(True).alias("large")), "large-blocks")
    asked = contents.join(large, "anchor", "left").select(
        F.col("one.rid").alias("rid"), F.struct(
            "anchor", "content", F.col("one.start").alias("start"), F.col("one.n").alias("n"), F.col("one.at").alias("at"),
            F.coalesce("large", F.lit(False)).alias("large")).alias("x"))
    asked = asked.groupBy("rid").agg(F.collect_list("x").alias("wanted"))
    cut = settle(rows.select("rid", "text").join(asked, "rid").select("text", "wanted").mapInArrow(_cut, _CUT), "cut-pieces")

    small = cut.where("words is not null").repartition("anchor").sortWithinPartitions("anchor", "content")
    factored = small.select("anchor", "content", "at", "n", "words").mapInArrow(_parse, "anchor long, content long, bits long")
    windows = cut.where("words is null").select("anchor", "content", "place", "high", "low")
    twice = settle(windows.groupBy("high", "low").agg(F.count("*").alias("c")).where("c > 1").select("high", "low"), "windows")
    counted = windows.join(twice, ["high", "low"]).groupBy("anchor", "content").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place"))).alias("bits"))
    often = contents.where("times > 1").select("anchor", "content", F.lit(_FULL).cast("long").alias("bits"))
    verdict = often.unionByName(factored).unionByName(counted).groupBy("anchor", "content").agg(F.bit_or("bits").alias("bits"))
    verdict = settle(verdict, "verdicts")

    equal = met.where("equal").select("rid", "start", "n", F.lit(_FULL).cast("long").alias("bits"))
    return equal.unionByName(met.where("not equal").join(verdict, ["anchor", "content"]).select("rid", "start", "n", "bits"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the kept words as ``text``."""
    rows = settle(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                              F.coalesce(F.col(text_col), F.lit("")).alias("text")), "substring-documents")
    spans = duplicate_spans(rows).groupBy("rid").agg(F.collect_list(F.struct("start", "n", "bits")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(
        _drop, f"doc_id {kind}, n_words long, n_removed long, text string")
