"""Language identification by prediction by partial matching over bytes, with frozen statistics.

Each language gets a tree of byte contexts of up to ``ORDER`` bytes with the counts of the bytes that follow. The length of
the code for a byte is exact: in the longest context that the language knows, the byte costs -log2(n / (N + D)) where it
was seen n times among N bytes, D of them different; else the escape costs -log2(D / (N + D)) and the context one byte
shorter is asked; contexts never seen are passed at no cost; behind the empty context each byte costs 8 bits. No statistics
change while texts are coded. A text is coded in every language; the shortest code names its language, and the score is
that language's share of 2^-length over all languages.

Texts are read as words (split at ASCII white space, A-Z lower-cased) with a space in front of each, and contexts don't
reach over that space: a word then costs the same wherever it stands, so each is coded once a worker and remembered
(at most ``REMEMBER`` words).

Statistics come from a sample of the labelled rows: for each language whole documents drawn by a hash of text and language
at a rate that makes about ``SAMPLE_BYTES`` (all of them where the language has less). Of all counted nodes those with the
highest counts are kept, ``MOST_NODES`` at most, which bounds what the driver reads and what is broadcast. Everything else covers all rows
and whole texts.

At scale: one scan adds up bytes by language (a row a language is shuffled by each task) and stores the sums, whose measured size then lets
Spark join them without moving a text; one counts the sample, summed in each task, and one scan codes
every text in the task that reads it, without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything where no language was
learned; rows without a language teach nothing; equal codes go to the first language by name; repeated rows get the same
result; null ids are kept; an empty table gives an empty one; columns of the input stay, but for ``lang_pred`` and ``score``.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from affinis.llm import words as W
from affinis.llm.store import named, settle

ORDER = 4
SAMPLE_BYTES = 4 << 20
MOST_NODES = 2_000_000
REMEMBER = 400_000
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
_PLACES = 1 << 17
_TEXTS = 4 << 20
_U = np.uint64


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def is_held_out(of: Column) -> Column:
    return F.coalesce(of == HELD_OUT, F.lit(False))


# Bytes and their contexts

def words(text: bytes) -> list[bytes]:
    return text.lower().split()


def flat(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with a space in front of each, and where each begins."""
    data = np.frombuffer(b"".join(chain.from_iterable((b" ", w) for w in distinct)), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(w) + 1 for w in distinct])]).astype(np.int64)


def depths(starts: np.ndarray) -> np.ndarray:
    """How many bytes of its word, the space included, stand before each byte."""
    return np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))


def keys(data: np.ndarray, order: int, first: int, last: int) -> np.ndarray:
    """Each byte from ``first`` to ``last`` with the ``order`` bytes before it, packed, under the order."""
    out = np.zeros(last - first, _U)
    for back in range(order, -1, -1):
        begin = max(first - back, 0)
        part = data[begin: last - back].astype(_U)
        out[last - first - len(part):] |= part << _U(8 * back)
    return out | _U(order) << _U(56)


def _count(order: int):
    """Nodes of the trees of one task: language, packed context and byte, number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                seen = Counter(chain.from_iterable(words(t) for t, x in zip(texts, langs) if x == lang))
                if not seen:
                    continue
                data, starts = flat(list(seen))
                depth, times = depths(starts), np.repeat(np.array(list(seen.values()), np.int64), np.diff(starts))
                for k in range(order + 1):
                    use = (depth >= k) & (depth > 0)
                    key, at = np.unique(keys(data, k, 0, len(data))[use], return_inverse=True)
                    n = np.zeros(len(key), np.int64)
                    np.add.at(n, at, times[use])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "key", "n"])
    return run


# The model

class Level(NamedTuple):
    """Contexts of one order. A row a node or context, a column a language."""

    key: np.ndarray  # sorted
    cost: np.ndarray  # NaN where the language hasn't seen the byte there
    context: np.ndarray  # sorted
    escape: np.ndarray  # 0 where the language hasn't seen the context


class Model(NamedTuple):
    languages: list[str]
    levels: list[Level]  # by order


def build(languages: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray, order: int) -> Model:
    """The trees of all languages from their nodes' counts."""
    levels = []
    for k in range(order + 1):
        of = (key >> _U(56)) == _U(k)
        node, at = np.unique(key[of], return_inverse=True)
        count = np.zeros((len(node), len(languages)))
        count[at, lang[of]] = n[of]
        context, of_context = np.unique(node >> _U(8), return_inverse=True)
        total, kinds = np.zeros((len(context), len(languages))), np.zeros((len(context), len(languages)))
        np.add.at(total, of_context, count)
        np.add.at(kinds, of_context, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = -np.log2(count / (total + kinds)[of_context])
            escape = -np.log2(kinds / (total + kinds))
        levels.append(Level(node, np.where(count > 0, cost, np.nan), context, np.where(total > 0, escape, 0.0)))
    return Model(languages, levels)


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value is in a sorted table, or -1."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def code_lengths(model: Model, distinct: list[bytes]) -> np.ndarray:
    """Bits of each word's bytes behind the space, a column a language."""
    data, starts = flat(distinct)
    depth = depths(starts)
    out = np.zeros((len(distinct), len(model.languages)))
    owner = np.repeat(np.arange(len(distinct)), np.diff(starts))
    for first in range(0, len(data), _PLACES):
        last = min(first + _PLACES, len(data))
        here = depth[first:last]
        bits = np.zeros((last - first, len(model.languages)))
        asked = np.repeat((here > 0)[:, None], len(model.languages), axis=1)
        for k in range(len(model.levels) - 1, -1, -1):
            level = model.levels[k]
            rows = np.flatnonzero((here >= k) & asked.any(axis=1))
            packed = keys(data, k, first, last)[rows]
            at, context = _find(level.key, packed), _find(level.context, packed >> _U(8))
            cost = np.where((at >= 0)[:, None], level.cost[at] if len(level.key) else np.nan, np.nan)
            escape = np.where((context >= 0)[:, None], level.escape[context] if len(level.context) else 0.0, 0.0)
            seen = ~np.isnan(cost)
            bits[rows] += np.where(asked[rows], np.where(seen, cost, escape), 0.0)
            asked[rows] &= ~seen
        bits += 8.0 * asked
        place = owner[first:last]
        begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        out[place[begin]] += np.add.reduceat(bits, begin)
    return out


def learn(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER, sample_bytes: int = SAMPLE_BYTES, most_nodes: int = MOST_NODES,
) -> Model:
    """The trees of all languages of these rows, which must all be meant for learning."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    size = F.octet_length("text")
    sizes = settle(rows.groupBy("lang").agg(F.sum(size).alias("bytes")).select("lang", (F.lit(float(sample_bytes)) / F.greatest("bytes", F.lit(1))).alias("rate")), "language-sizes")
    drawn = F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 30)) < F.col("rate") * (1 << 30)
    # A document as long as the sample would be all of it.
    sample = rows.join(sizes, "lang").where((drawn & (size <= sample_bytes)) | (F.col("rate") >= 1))
    sample = sample.select("lang", F.col("text").cast("binary").alias("text"))
    nodes = settle(sample.mapInArrow(_count(order), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")), "language-nodes")
    least = _least(nodes, most_nodes)
    table = nodes.where(F.col("n") >= least).orderBy("lang", "key").limit(most_nodes).toArrow()
    lang = np.array(table.column("lang").to_pylist(), object)
    languages = sorted(set(lang))
    number = {x: i for i, x in enumerate(languages)}
    return build(languages, np.array([number[x] for x in lang], np.int64), table.column("key").to_numpy().view(_U), table.column("n").to_numpy(), order)


def _least(nodes: DataFrame, most: int) -> int:
    """The least count at which no more than ``most`` nodes are left; counts of 1000 and above count as 1000."""
    capped = nodes.groupBy(F.least("n", F.lit(1000)).alias("n")).count().orderBy(F.col("n").desc()).limit(1000).toArrow().to_pylist()
    total, least = 0, 1
    for row in capped:
        total += row["count"]
        if total > most:
            return row["n"] + 1
    return least


# Prediction

class _Memory:
    """Words with their code lengths. Lives as long as its worker."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.bits = array("d")

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        new = list(set().union(*texts).difference(self.index))
        for s in range(0, len(new), 1 << 14):
            part = new[s: s + (1 << 14)]
            self.index.update(zip(part, range(len(self.index), len(self.index) + len(part))))
            self.bits.frombytes(code_lengths(self.model, part).tobytes())
        bits = np.frombuffer(self.bits, np.float64).reshape(-1, len(self.model.languages))
        find = self.index.__getitem__
        return np.array([bits[list(map(find, t))].sum(axis=0) if t else np.zeros(bits.shape[1]) for t in texts])


_memory: dict[str, _Memory] = {}


def _predict(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _memory:
            _memory.clear()
            _memory[name] = _Memory(shared.value)
        memory = _memory[name]
        languages = memory.model.languages
        for batch in batches:
            for first, _, offsets in W.chunks(batch.column("text"), _TEXTS):
                rows = batch.slice(first, len(offsets) - 1)
                texts = rows.column("text").cast(pa.binary()).to_pylist()
                asked = rows.column("asked").to_numpy(zero_copy_only=False)
                bits = memory.of([words(t) if a and t else [] for t, a in zip(texts, asked)])
                best = np.argmin(bits, axis=1)
                score = 1 / np.exp2(bits[np.arange(len(best)), best][:, None] - bits).sum(axis=1)
                pred = [languages[b] if a else UNKNOWN for b, a in zip(best, asked)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row"), pa.array(pred, pa.string()), pa.array(np.where(asked, score, 0.0))], ["row", "lang_pred", "score"])
                if len(memory.index) > REMEMBER:
                    memory.clear()
    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without their text, with ``lang_pred`` and ``score``."""
    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", text_col.lower())]
    letter = F.regexp_like(named(text_col), F.lit(r"\p{L}"))
    if not model.languages:
        return docs.select(*map(named, keep), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    # The columns that stay travel as one, whatever their names.
    rows = docs.select(F.struct(*map(named, keep)).alias("row"), named(text_col).alias("text"), F.coalesce(letter, F.lit(False)).alias("asked"))
    schema = StructType([rows.schema["row"]]).add("lang_pred", StringType()).add("score", DoubleType())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared, uuid.uuid4().hex), schema).select("row.*", "lang_pred", "score")
