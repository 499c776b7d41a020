"""Token counts with overlap resynchronisation for huge texts.

Texts up to ``CHUNK`` characters are counted whole. Longer ones are encoded in chunks that overlap, with
offsets, so that no encoding is larger than a chunk. Two neighbours are spliced at a boundary proven stable: a
place in the overlap, at white space in the text, that is a token boundary in both encodings and around which
``CONTEXT`` tokens agree on both sides in offsets and ids. Where the overlap offers none, the next chunk is
encoded again with the overlap twice as wide, and at last the two chunks as one. Counting needs no shuffle.

Tokens of ordinary texts: a tokenizer whose pre-tokens never hold white space (``splits_at_space`` reads this
from its file) counts the same for a text as for its white-space pieces, so each distinct piece is encoded once
per worker and remembered, a bounded number of them.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted alike; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CHUNK = 1 << 15
OVERLAP = 1 << 10
CONTEXT = 8
REMEMBER = 400_000
_TOGETHER = 1000
LIMIT = 2048

_tokenizers: dict[str, object] = {}
_counts: dict[str, dict[bytes, int]] = {}


def load(path: str):
    """The file's tokenizer, once per worker. ``.json`` for tokenizers, ``.model`` for sentencepiece."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _tokenizers[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            it = Tokenizer.from_file(path)
            it.no_truncation()
            it.no_padding()
            _tokenizers[path] = it
    return _tokenizers[path]


def splits_at_space(path: str) -> bool:
    """Can no pre-token and no added token of this file hold or be changed by ASCII white space?

    True for a split by a pattern of classes that all leave out white space, with the rest removed.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = steps[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    spaceless = all(
        p in ("[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+") or p.replace("'", "").isalpha() for p in pattern.split("|"))
    plain = all(
        not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"])
        for t in spec.get("added_tokens", []))
    known = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace"}
    norm = spec.get("normalizer") or {"normalizers": []}
    kinds = norm.get("normalizers", [norm])
    local = all(n["type"] in known and (n["type"] != "Replace" or n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ") for n in kinds)
    alone = all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in steps[1:])
    return bool(first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and pattern
                and spaceless and plain and local and alone and not spec.get("post_processor"))


def _count_pieces(pieces: list[bytes], tokenizer) -> list[int]:
    """Tokens of each piece. One encoding of many pieces costs far less than many of one; offsets part them."""
    out: list[int] = []
    for k in range(0, len(pieces), _TOGETHER):
        texts = [p.decode() for p in pieces[k: k + _TOGETHER]]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        offsets = np.array(tokenizer.encode(" ".join(texts), add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        owner = np.searchsorted(starts, offsets[:, 0], "right") - 1
        out.extend(np.bincount(owner, minlength=len(texts)).tolist())
    return out


def count_whole(texts: list[str], path: str, pieces: bool) -> list[int]:
    """Tokens of each text, encoded whole or by remembered white-space pieces."""
    tokenizer = load(path)
    if path.endswith(".model"):
        return [len(x) for x in tokenizer.encode(texts, num_threads=1)]
    if not pieces:
        return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    known, out = _counts.setdefault(path, {}), []
    for text in texts:
        parts = text.encode().split()
        new = list(set(parts).difference(known))
        if new:
            if len(known) > REMEMBER:
                known.clear()
                new = list(set(parts))
            known.update(zip(new, _count_pieces(new, tokenizer)))
        out.append(sum(map(known.__getitem__, parts)))
    return out


def encode(text: str, path: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Ids and character offsets."""
    tokenizer = load(path)
    if path.endswith(".model"):
        pieces = tokenizer.encode(text, return_type="proto").pieces
        # Its offsets count bytes.
        place = np.cumsum((np.frombuffer(text.encode() + b" ", np.uint8) & 0xC0) != 0x80) - 1
        return [x.id for x in pieces], [(int(place[x.begin]), int(place[x.end])) for x in pieces]
    e = tokenizer.encode(text, add_special_tokens=False)
    return e.ids, e.offsets


def stable_boundary(left, right, shift: int, text: str, at: int) -> tuple[int, int] | None:
    """Where both encodings may be spliced: number of tokens of ``left`` kept, of ``right`` left out.

    ``text`` is the overlap, which starts at ``at`` in the left chunk; ``shift`` is where the right chunk starts
    in the left one. ``None`` where no boundary is proven.
    """
    (ids_a, off_a), (ids_b, off_b) = left, right
    places = {s + shift: j for j, (s, _) in reversed(list(enumerate(off_b)))}
    best = None
    for i in range(CONTEXT, len(ids_a) - CONTEXT):
        s = off_a[i][0]
        j = places.get(s)
        if j is None or j < CONTEXT or j + CONTEXT > len(ids_b) or s <= at or not (
                text[s - 1 - at: s - at].isspace() or text[s - at: s - at + 1].isspace()):
            continue
        span_a, span_b = range(i - CONTEXT, i + CONTEXT), range(j - CONTEXT, j + CONTEXT)
        if all(ids_a[x] == ids_b[y] and off_a[x][0] == off_b[y][0] + shift and off_a[x][1] == off_b[y][1] + shift
               for x, y in zip(span_a, span_b)):
            best = (i, j)
            if s - at >= len(text) // 2:
                break
    return best


def count_spliced(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a huge text from overlapping chunks, spliced one after the other."""
    total, start, size = 0, 0, chunk
    left = encode(text[:chunk], path)
    skip = 0  # tokens of the left chunk that belong to what came before
    while start + size < len(text):
        wide = overlap
        while True:
            begin = start + size - wide
            found = None
            if begin > start:
                right = encode(text[begin: begin + chunk + wide], path)
                found = stable_boundary(left, right, begin - start, text[begin: start + size], begin - start)
                if found and found[0] < skip:
                    found = None
            if found or begin <= start:
                break
            wide *= 2
        if found:
            total += found[0] - skip
            start, size, left, skip = begin, min(chunk + wide, len(text) - begin), right, found[1]
        else:  # no proven boundary: the chunk doubles and is encoded as one
            size = min(2 * size, len(text) - start)
            left = encode(text[start: start + size], path)
    return total + len(left[0]) - skip


def _counter(path: str, pieces: bool, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            short = count_whole([t for t in texts if len(t) <= chunk], path, pieces)
            it = iter(short)
            tokens = [next(it) if len(t) <= chunk else count_spliced(t, path, chunk) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: its id (under its own name), n_bytes and n_tokens."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = docs.schema[id_col].dataType.simpleString()
    counted = rows.mapInArrow(_counter(path, splits_at_space(path), chunk), f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumnRenamed("id", id_col)
