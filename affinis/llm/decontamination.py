"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Items and documents are brought to the same form: A-Z lower, words joined by single spaces. Each item gives
its windows of ``WINDOW`` words (a shorter item is one window); the automaton holds every distinct window with
a space at both ends, so that it matches whole words only. A document is scanned once; matches are mapped from
the normalised text to its words and from there to places in the original.

The windows are what is broadcast. Their number and length are measured first; beyond ``MAX_CHARACTERS`` they
are dealt over several automata, each below the bound, and the documents are scanned once for each.

Defined results: a text or item without words (null, empty) matches nothing. Items without id still mark
words but are not listed. Repeated items and rows change nothing for others. Other columns are not read by
``scan`` and pass through ``clean`` untouched, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from affinis.llm import words as W

WINDOW = 10
#: Characters of all windows in one automaton, some 50 bytes of memory each.
MAX_CHARACTERS = 4_000_000

_FOLD = bytes(
    x + 32 if 0x41 <= x <= 0x5A else 0x20 if x in W.NOT_ALNUM else x for x in range(256))
_automata: dict[str, ahocorasick.Automaton] = {}


def normal(text: str) -> list[str]:
    """The words of a text, A-Z lower."""
    return text.encode().translate(_FOLD).decode().split(" ")


def item_windows(text: str, window: int = WINDOW) -> list[str]:
    found = [w for w in normal(text) if w]
    return [" ".join(found[i: i + window]) for i in range(max(1, len(found) - window + 1))] if found else []


def _windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(window, ids): every distinct window of the items and the items it is of."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(w, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                     for w in set(item_windows(t or "", window))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in pairs], pa.string()), pa.array([i for _, i in pairs], pa.string())], ["window", "item"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "window string, item string").groupBy("window").agg(F.collect_set("item").alias("ids"))


def _automaton(patterns) -> ahocorasick.Automaton:
    """Built once per worker from the broadcast windows; the worker keeps the last one."""
    key, found = patterns.value
    if key not in _automata:
        _automata.clear()
        machine = ahocorasick.Automaton()
        for window, ids in found:
            machine.add_word(f" {window} ", (len(window) + 2, ids))
        if found:
            machine.make_automaton()
        _automata[key] = machine
    return _automata[key]


def _match(machine: ahocorasick.Automaton, text: str) -> tuple[int, list[tuple[int, int, list[str]]]]:
    """Number of words; matches as first word, end word and items."""
    found = [w for w in normal(text) if w]
    line = " " + " ".join(found) + " "
    hits = [(end - size + 1, end, ids) for end, (size, ids) in machine.iter(line)]
    if not hits:
        return len(found), []
    gaps = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 0x20)
    starts, ends = (np.searchsorted(gaps, [h[k] for h in hits]) for k in (0, 1))
    return len(found), [(int(s), int(e), h[2]) for s, e, h in zip(starts, ends, hits)]


def _word_places(text: str) -> list[tuple[int, int]]:
    """Where each word of the original begins and ends, in characters."""
    data = np.frombuffer(text.encode(), np.uint8)
    w = W.split(data, np.array([0, len(data)]), W.NOT_ALNUM, lower=True)
    place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return list(zip(place[w.start].tolist(), place[w.end].tolist()))


_HITS = "n_words long, spans array<struct<first:long,last:long,start:long,stop:long>>, items array<string>"


def _scanner(patterns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            machine = _automaton(patterns)
            counts, spans, items = [], [], []
            for text in batch.column("text").to_pylist():
                n, hits = _match(machine, text) if len(machine) else (len([w for w in normal(text) if w]), [])
                merged: list[list[int]] = []
                for s, e in sorted((s, e) for s, e, _ in hits):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                places = _word_places(text) if merged else []
                counts.append(n)
                spans.append([{"first": s, "last": e - 1, "start": places[s][0], "stop": places[e - 1][1]} for s, e in merged])
                items.append(sorted({i for _, _, ids in hits for i in ids}))
            kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "stop")]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(counts, pa.int64()),
                 pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))],
                [*batch.schema.names[:-1], "n_words", "spans", "items"])
    return run


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
             max_characters: int = MAX_CHARACTERS) -> list:
    """Broadcast pattern lists, each below the bound; one for benchmarks of usual size, none for an empty one."""
    found = _windows(items, id_col, text_col, window).persist()
    size = found.agg(F.sum(F.length("window") + 2)).first()[0] or 0
    shards = -(-size // max_characters)
    out = []
    for k in range(shards):
        rows = found.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == k).collect()
        out.append(items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r["window"], r["ids"]) for r in rows])))
    found.unpersist()
    return out or [items.sparkSession.sparkContext.broadcast(("", []))]


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """One row per document: its id, ``n_words``, ``spans`` of hit words (first and last word, and start and stop
    in characters of the original) and the ``items`` hit, sorted."""
    kind = docs.schema[id_col].dataType.simpleString()
    current = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = automata(items, window=window, max_characters=max_characters)
    if len(shards) == 1:
        out = current.mapInArrow(_scanner(shards[0]), f"id {kind}, {_HITS}")
    else:  # the hits so far travel with the row from one automaton to the next
        out = _several(current, kind, shards)
    return out.withColumnRenamed("id", id_col)


def _several(current: DataFrame, kind: str, shards: list) -> DataFrame:
    hits = "array<struct<first:long,last:long,start:long,stop:long>>"
    current = current.select("id", "text", F.lit(0).cast("long").alias("n"), F.array().cast(hits).alias("s"), F.array().cast("array<string>").alias("i"))
    for shard in shards:
        step = current.select("id", F.col("n").alias("n0"), "s", "i", F.col("text").alias("held"), "text")
        step = step.mapInArrow(_scanner(shard), f"id {kind}, n0 long, s {hits}, i array<string>, held string, {_HITS}")
        current = step.select("id", F.col("held").alias("text"), F.col("n_words").alias("n"),
                              F.concat("s", "spans").alias("s"), F.array_union("i", "items").alias("i"))
    # Spans of different automata may overlap: merge them in order.
    merged = F.aggregate(
        F.sort_array("s"), F.array().cast(hits),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["last"] + 1 >= x["first"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last"),
                F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["stop"], x["stop"]).alias("stop"))),
        )).otherwise(F.array_append(acc, x)))
    return current.select("id", F.col("n").alias("n_words"), merged.alias("spans"), F.sort_array("i").alias("items"))


def _keeper(patterns, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            machine = _automaton(patterns)
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            yield batch.filter(pa.array([not len(machine) or not _match(machine, t or "")[1] for t in texts], pa.bool_()))
    return run


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window, with all its columns."""
    names = docs.columns
    # By place, since names may hold what the API reads as a path.
    out = docs.toDF(*(f"c{i}" for i in range(len(names))))
    for shard in automata(items, window=window):
        out = out.mapInArrow(_keeper(shard, f"c{names.index(text_col)}"), out.schema)
    return out.toDF(*names)
