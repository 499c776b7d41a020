"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked id pairs by minimal perfect hashing.

Both tokenizers encode a space and the text. Byte offsets where tokens of both end cut the tokens into groups; the
two tokens that end there are linked. Counts of linked id pairs are gathered over all documents in a first pass:
every task writes its own sums by pair, the distinct pairs get a minimal perfect hash (levels of bit vectors with
ranks), each task's sums become a dense vector of counts indexed by the hash, and the vectors are added up in a tree,
slice by slice. The second pass aligns the documents again and looks each link up; a looked-up slot holds its pair,
so a pair that was never counted is seen to be none and counts 0.

At scale: two scans of the texts and no shuffle of them. Of two linked tokens the shorter one's bytes end the longer
one's, so the vocabularies bound the distinct pairs (``most_pairs``: some hundred thousands for vocabularies of
50,000): this bounds the hash, the counts, what reaches the driver and what is broadcast, whatever the corpus. A task
hands on at most as many sums as it has distinct pairs, and a tree node adds ``FAN`` slices of ``SLICE`` numbers.

Texts are encoded by their pieces: runs of spaces and line feeds with the word behind them. Both tokenizers part there
(the vocabularies are looked through, else texts are encoded whole), so each distinct piece is encoded once a worker
and remembered, up to ``REMEMBER`` bytes; texts with any other white space are encoded whole.

Defined results: null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens
and count for nothing; repeated rows are aligned and counted each; null ids are kept; an empty table gives an empty
one; other columns are not read.
"""

from __future__ import annotations

import json
import re
import uuid
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from affinis.llm import words as W
from affinis.llm.store import settle

GAMMA = 2.0
SLICE = 1 << 13
FAN = 32
REMEMBER = 256 << 20
_TOGETHER = 1 << 17
_TEXTS = 4 << 20
_U = np.uint64
SPACE = "\u2581"
PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space, and what some take for it, other than the space and the line feed.
OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


# Vocabularies

def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A tokenizer of the library for ``.json`` files whose entries stand for bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.it = Tokenizer.from_file(path)
        self.it.encode_special_tokens = True
        self.it.no_truncation()
        self.it.no_padding()
        of = byte_alphabet()
        vocabulary = self.it.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, number in vocabulary.items():
            self.bytes[number] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec.get("pre_tokenizer") or {}
        # The pattern of this kind of step never takes white space behind anything else.
        self.parts = bool(step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space")
                          and not spec.get("normalizer") and not spec.get("post_processor"))

    def spaced(self, text: str) -> list[int]:
        """Ids of a space and the text."""
        return self.it.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids


class Pieces:
    """A tokenizer of the library for ``.model`` files, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.it = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.it.id_to_piece(i) for i in range(self.it.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.it.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.parts = not any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in names)

    def spaced(self, text: str) -> list[int]:
        return self.it.encode(text, num_threads=1)


def load(path: str):
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of entries there are of which one ends with the other: no other pair can be linked."""
    def ends(long: list[bytes], short: list[bytes], proper: int) -> int:
        count: dict[bytes, int] = {}
        for x in short:
            count[x] = count.get(x, 0) + 1
        return sum(count.get(x[k:], 0) for x in long for k in range(proper, len(x)))
    return ends(a, b, 0) + ends(b, a, 1)


# Minimal perfect hashing

class PerfectHash(NamedTuple):
    """Numbers 0 to n - 1 for n keys: bit vectors of falling size; a key's number is the rank of its bit."""

    sizes: np.ndarray
    bits: np.ndarray  # of all levels, in words of 64
    ranks: np.ndarray  # set bits before each word
    first: np.ndarray  # word at which each level begins


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = _U((level + 1) * W._BASE & ((1 << 64) - 1))
    return W.mix(keys.view(_U) ^ seed) % _U(size)


def perfect_hash(keys: np.ndarray) -> PerfectHash:
    """Of distinct 64-bit keys. Keys that meet no other at a level are placed there; the rest goes on."""
    sizes, words, first, rest = [], [], [0], keys
    while len(rest):
        size = max(64, int(len(rest) * GAMMA) + 63 & ~63)
        slot = _slot(rest, len(sizes), size)
        alone = np.bincount(slot.astype(np.int64), minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(_U))
        sizes.append(size)
        first.append(first[-1] + len(words[-1]))
        rest = rest[~alone[slot]]
    bits = np.concatenate(words) if words else np.empty(0, _U)
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    return PerfectHash(np.array(sizes, np.int64), bits, ranks, np.array(first, np.int64))


def number(h: PerfectHash, keys: np.ndarray) -> np.ndarray:
    """The number of each key; some number, or -1, for what is no key."""
    out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    for level, size in enumerate(h.sizes):
        slot = _slot(keys[left], level, int(size)).astype(np.int64)
        word, bit = h.first[level] + (slot >> 6), (slot & 63).astype(_U)
        here = (h.bits[word] >> bit & _U(1)).astype(bool)
        below = h.bits[word[here]] & ((_U(1) << bit[here]) - _U(1))
        out[left[here]] = h.ranks[word[here]] + np.bitwise_count(below)
        left = left[~here]
        if not len(left):
            break
    return out


class Counts(NamedTuple):
    """Counts of pairs by their number, with the pair that each number stands for."""

    hash: PerfectHash
    key: np.ndarray
    count: np.ndarray
    best: np.ndarray  # is the count the highest of its second id?

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = number(self.hash, keys)
        same = (at >= 0) & (self.key[at] == keys)
        return np.where(same, self.count[at], 0), same & self.best[at]


# Alignment

class Aligned(NamedTuple):
    """Pieces aligned one by one. ``link`` holds id pairs; piece i has those from ``at[i]`` to ``at[i + 1]``."""

    n_a: np.ndarray
    n_b: np.ndarray
    link: np.ndarray
    at: np.ndarray
    groups: list[str]  # of each piece; empty where not asked for

    def __getitem__(self, i: slice) -> Aligned:  # type: ignore[override]
        at = self.at[i.start: None if i.stop is None else i.stop + 1]
        return Aligned(self.n_a[i], self.n_b[i], self.link[at[0]: at[-1]], at - at[0], self.groups[i])


class Aligner:
    def __init__(self, path_a: str, path_b: str, spelled: bool = True):
        self.a, self.b, self.spelled = load(path_a), load(path_b), spelled
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.name_a, self.name_b = (list(map(str, range(len(t.bytes)))) for t in (self.a, self.b))
        self.parts = self.a.parts and self.b.parts

    def pieces(self, text: str) -> list[str] | None:
        """Pieces of a space and the text that both tokenizers encode alone as they do together; None: not known to be so.

        A piece that begins with no white space stands for itself behind a space.
        """
        if not self.parts or OTHER_SPACE.search(text):
            return None
        # Where no two of them meet, each space parts, and each line feed too once a space stands before it.
        spaced = " " + text.replace("\n", " \n")
        if "  " not in spaced and "\n " not in spaced and spaced[-1] not in " \n":
            return spaced[1:].split(" ")
        return PIECES.findall(" " + text)

    def whole(self, text: str) -> Aligned | None:
        """A space and the text as one piece; None where a tokenizer doesn't give it back."""
        return self._align(self.a.spaced(text), self.b.spaced(text), np.array([len(text.encode()) + 1]), (" " + text).encode())

    def each(self, pieces: list[str]) -> Iterator[tuple[list[str], Aligned | None]]:
        """The pieces in runs with their alignments, encoded many at a time; None with a piece that a tokenizer doesn't give back."""
        run, size = [], 0
        for piece in pieces:
            piece = piece if piece[0] in " \n" else " " + piece
            # White space alone is the end of a text; what follows would change it.
            if (size > _TOGETHER or piece.isspace()) and run:
                yield from self._together(run)
                run, size = [], 0
            run.append(piece)
            size += len(piece)
            if piece.isspace():
                yield from self._together(run)
                run, size = [], 0
        if run:
            yield from self._together(run)

    def _together(self, run: list[str]) -> Iterator[tuple[list[str], Aligned | None]]:
        joined = "".join(run)
        # A word in front, so that a piece without a space in front gets none.
        ends = np.cumsum([2, *(map(len, run) if joined.isascii() else (len(p.encode()) for p in run))])
        found = self._align(self.a.spaced("x" + joined), self.b.spaced("x" + joined), ends, (" x" + joined).encode())
        if found is not None or len(run) == 1:
            yield run, found and found[1:]
            return
        half = len(run) // 2
        yield from self._together(run[:half])
        yield from self._together(run[half:])

    def _align(self, ids_a: list[int], ids_b: list[int], ends: np.ndarray, data: bytes) -> Aligned | None:
        """Tokens of pieces that end at ``ends``. None if their bytes aren't the data or one crosses an end."""
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        if not len(a) or not len(b) or end_a[-1] != len(data) or end_b[-1] != len(data):
            return None
        if b"".join(map(self.a.bytes.__getitem__, ids_a)) != data or b"".join(map(self.b.bytes.__getitem__, ids_b)) != data:
            return None
        common, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        last = np.minimum(np.searchsorted(common, ends), len(common) - 1)
        if (common[last] != ends).any():
            return None
        at = np.concatenate([[0], last + 1])
        n_a, n_b = (np.diff(np.concatenate([[-1], x[last]])) for x in (at_a, at_b))
        return Aligned(n_a, n_b, a[at_a] << 32 | b[at_b], at, self._spell(ids_a, ids_b, at_a, at_b, at) if self.spelled else [])

    def _spell(self, ids_a: list[int], ids_b: list[int], at_a: np.ndarray, at_b: np.ndarray, at: np.ndarray) -> list[str]:
        name_a, name_b = self.name_a, self.name_b
        groups, i, j = [], 0, 0
        for x, y in zip((at_a + 1).tolist(), (at_b + 1).tolist()):
            left = name_a[ids_a[i]] if x == i + 1 else ",".join([name_a[k] for k in ids_a[i:x]])
            groups.append(left + "|" + (name_b[ids_b[j]] if y == j + 1 else ",".join([name_b[k] for k in ids_b[j:y]])))
            i, j = x, y
        cut = at.tolist()
        return [";".join(groups[s:e]) for s, e in zip(cut, cut[1:])]


class _Index(dict):
    """Numbers of pieces; a new one gets the next number and waits to be aligned."""

    def __init__(self):
        self.waiting: list[str] = []
        self.size = 0

    def __missing__(self, piece: str) -> int:
        self.waiting.append(piece)
        self[piece] = self.size
        self.size += 1
        return self.size - 1


class _Memory:
    """Aligned pieces by number. Lives as long as its worker; what it holds is bounded."""

    def __init__(self, aligner: Aligner, counts: Counts | None = None):
        self.aligner, self.counts = aligner, counts
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.broken: set[int] = set()
        self.held = self.size = 0
        self.numbers = {name: array("q") for name in ("n_a", "n_b", "n_links", "n_best", "count_sum")}
        self.link = array("q")
        self.groups: list[str] = []

    def add(self, found: Aligned) -> int:
        """The number of the first of these pieces."""
        size = np.diff(found.at)
        put = {"n_a": found.n_a, "n_b": found.n_b, "n_links": size}
        if self.counts is None:
            self.link.frombytes(found.link.tobytes())
            self.held += 8 * len(found.link)
        elif len(found.link):
            count, best = self.counts.find(found.link)
            # Every aligned piece has a link: its end.
            put |= {"count_sum": np.add.reduceat(count, found.at[:-1]), "n_best": np.add.reduceat(best.astype(np.int64), found.at[:-1])}
        else:
            put |= {"count_sum": size, "n_best": size}
        if self.counts is not None:
            self.groups += found.groups
            self.held += sum(map(len, found.groups)) + 60 * len(found.groups)
        for name, values in put.items():
            self.numbers[name].frombytes(values.astype(np.int64).tobytes())
        self.size += len(size)
        return self.size - len(size)

    def learn(self) -> None:
        """Aligns the pieces that wait, in the order of their numbers."""
        waiting, self.index.waiting = self.index.waiting, []
        for run, found in self.aligner.each(waiting):
            self.held += sum(map(len, run)) + 200 * len(run)
            if found is None:
                self.broken.add(self.size)
                found = Aligned(np.zeros(1), np.zeros(1), np.empty(0, np.int64), np.zeros(2, np.int64), [""])
            self.add(found)

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text, the numbers of its pieces, in order; none where it has no tokens."""
        pieces = [self.aligner.pieces(text) if text else [] for text in texts]
        find = self.index.__getitem__
        out = [np.empty(0, np.int64) if p is None else np.fromiter(map(find, p), np.int64, len(p)) for p in pieces]
        self.learn()
        for i, found in enumerate(pieces):
            if found is None:
                out[i] = self._whole(texts[i])
            elif self.broken and not self.broken.isdisjoint(out[i].tolist()):
                out[i] = np.empty(0, np.int64)
        return out

    def _whole(self, text: str) -> np.ndarray:
        found = self.aligner.whole(text)
        if found is None:
            return np.empty(0, np.int64)
        self.index.size += 1
        return np.array([self.add(found)])


_memory: dict[str, _Memory] = {}


def _remembered(path_a: str, path_b: str, name: str, counts: Counts | None) -> _Memory:
    """This worker's memory for one pass of one job; that of another is let go."""
    key = f"{path_a} {path_b} {name}"
    if key not in _memory:
        _memory.clear()
        _memory[key] = _Memory(Aligner(path_a, path_b, counts is not None), counts)
    return _memory[key]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows of at most about ``_TEXTS`` bytes of text at a time."""
    for batch in batches:
        for first, _, offsets in W.chunks(batch.column("text"), _TEXTS):
            yield batch.slice(first, len(offsets) - 1)


def _count_links(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _remembered(path_a, path_b, "counting", None)
        total: list[tuple[np.ndarray, np.ndarray]] = []
        times = np.zeros(memory.size, np.int64)

        def put() -> None:
            """Sums by pair so far."""
            weights = np.repeat(times, np.frombuffer(memory.numbers["n_links"], np.int64))
            used = weights > 0
            total.append((np.frombuffer(memory.link, np.int64)[used], weights[used]))
            key, at = np.unique(np.concatenate([k for k, _ in total]), return_inverse=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, at, np.concatenate([n for _, n in total]))
            total[:] = [(key, sums)]

        for batch in _slices(batches):
            now = np.bincount(np.concatenate(memory.of(batch.column("text").to_pylist())), minlength=memory.size)
            now[: len(times)] += times
            times = now
            if memory.held > REMEMBER:
                put()
                memory.clear()
                times = np.zeros(0, np.int64)
        put()
        yield pa.RecordBatch.from_arrays(list(map(pa.array, total[0])), ["key", "n"])
    return run


def _vectors(shared):
    """One task's sums as a dense vector, in slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, keys = shared.value
        vector = np.zeros(len(keys), np.int64)
        for batch in batches:
            key = batch.column("key").to_numpy()
            at = number(h, key)
            if not (keys[at] == key).all():
                raise ValueError("a pair that is not among the distinct pairs")
            np.add.at(vector, at, batch.column("n").to_numpy())
        part = [vector[s: s + SLICE] for s in range(0, len(vector), SLICE)]
        used = [i for i, x in enumerate(part) if x.any()]
        lane = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([
            pa.array(used, pa.int64()), pa.array([lane] * len(used), pa.int64()), pa.array([part[i].tobytes() for i in used], pa.binary())],
            ["slice", "lane", "counts"])
    return run


def _add_up(table: pa.Table) -> pa.Table:
    first = table.slice(0, 1)
    total = np.sum([np.frombuffer(x.as_py(), np.int64) for x in table.column("counts")], axis=0)
    return pa.table({"slice": first.column("slice"), "lane": first.column("lane"), "counts": pa.array([total.tobytes()], pa.binary())})


def pair_counts(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> Counts:
    """Counts of all linked id pairs of the texts: first pass, hash, and the tree of sums."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    sums = settle(texts.mapInArrow(_count_links(path_a, path_b), "key long, n long"), "pair-sums")
    keys = sums.select("key").distinct().toArrow().column("key").to_numpy()
    h = perfect_hash(keys)
    ordered = np.empty(len(keys), np.int64)
    ordered[number(h, keys)] = keys
    shared = spark.sparkContext.broadcast((h, ordered))
    parts = settle(sums.mapInArrow(_vectors(shared), "slice long, lane long, counts binary"), "pair-vectors")
    lanes = (parts.agg(F.max("lane")).first()[0] or 0) + 1
    while lanes > 1:
        lanes = -(-lanes // FAN)
        parts = parts.withColumn("lane", F.expr(f"lane div {FAN}")).groupBy("slice", "lane").applyInArrow(_add_up, parts.schema)
        parts = settle(parts, "pair-vectors")
    count = np.zeros(len(keys), np.int64)
    for row in parts.toArrow().to_pylist():
        part = np.frombuffer(row["counts"], np.int64)
        count[row["slice"] * SLICE:][: len(part)] = part
    shared.unpersist()
    other = ordered & 0xFFFFFFFF
    most = np.zeros(int(other.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, other, count)
    return Counts(h, ordered, count, count == most[other])


def _align(shared, path_a: str, path_b: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _remembered(path_a, path_b, name, shared.value)
        for batch in _slices(batches):
            rows = memory.of(batch.column("text").to_pylist())
            flat = np.concatenate(rows)
            ends = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int64)
            columns = {}
            for column, values in memory.numbers.items():
                sums = np.concatenate([[0], np.cumsum(np.frombuffer(values, np.int64)[flat])])
                columns[column] = pa.array(np.diff(sums[ends]))
            groups = pa.array([";".join(map(memory.groups.__getitem__, row.tolist())) for row in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), columns["n_a"], columns["n_b"], columns["n_links"], columns["n_links"], columns["n_best"], columns["count_sum"], groups],
                ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
            if memory.held > REMEMBER:
                memory.clear()
    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", counts: Counts | None = None) -> DataFrame:
    """One row per document: its id (under its own name), n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``:
    decimal ids, those of one side joined by ``,``, the sides by ``|``, groups by ``;``.

    ``counts`` are those of ``docs`` where none are given.
    """
    counts = counts or pair_counts(docs, path_a, path_b, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return rows.mapInArrow(_align(shared, path_a, path_b, uuid.uuid4().hex), schema).withColumnRenamed("id", id_col)
