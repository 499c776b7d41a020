"""Words of many texts at once: byte classes, word bounds and 64-bit word hashes with numpy.

All word rules of this package only name ASCII separators, so UTF-8 bytes decide them and no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Words are runs of anything but space and \x09-\x0D.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Words are runs of a-z, 0-9 and non-ASCII, once A-Z are lower.
NOT_ALNUM = bytes(x for x in range(0x80) if not (0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A))

CHUNK_BYTES = 1 << 21
_HASH_BYTES = 1 << 20
_LONG_WORD = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_UP: np.ndarray = _powers(_BASE, 2)
_DOWN: np.ndarray = _powers(_INVERSE, 2)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(_BASE, n), _powers(_INVERSE, n)
    return _UP, _DOWN


class Words(NamedTuple):
    data: np.ndarray  # bytes, lower-cased where asked
    start: np.ndarray  # of each word, in bytes
    end: np.ndarray
    doc: np.ndarray  # words of text i: doc[i] to doc[i + 1]

    def of(self, i: int) -> slice:
        return slice(self.doc[i], self.doc[i + 1])

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.doc) - 1), np.diff(self.doc))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of whole texts of about ``limit`` bytes: first row, bytes, offsets. Null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if len(texts) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, kind)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(texts))
        yield first, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def split(data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACES, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    word = inside[data]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    begins[first] = word[first]
    ends[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = word[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    out = np.empty(len(w.start), _U)
    i = 0
    while i < len(w.start):
        at = w.start[i]
        j = max(i + 1, int(np.searchsorted(w.end, at + _HASH_BYTES, "right")))
        stop = w.end[j - 1]
        if stop - at <= _HASH_BYTES:
            up, down = _tables(_HASH_BYTES + 1)
            sums = np.zeros(stop - at + 1, _U)
            np.cumsum(_BYTES[w.data[at:stop]] * up[: stop - at], out=sums[1:])
            s, e = w.start[i:j] - at, w.end[i:j] - at
            out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    long = np.flatnonzero(w.end - w.start > _LONG_WORD)
    if len(long):
        from hashlib import blake2b

        for k in long:
            out[k] = int.from_bytes(blake2b(w.data[w.start[k]: w.end[k]].tobytes(), digest_size=8).digest(), "little")
    return mix(out)


def grams(h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of the ``n`` values from each place on; shorter by n - 1. Doubles the length at each step."""
    if len(h) < n:
        return np.empty(0, _U)
    have, length, at, out = h, 1, 0, None
    power = base
    rest = n
    while rest:
        if rest & 1:
            part = have[at: at + len(h) - n + 1]
            out = part if out is None else out * _U(pow(base, length, 1 << 64)) + part
            at += length
        rest >>= 1
        if rest:
            have = have[:-length] * _U(power) + have[length:]
            length *= 2
            power = power * power % (1 << 64)
    return mix(out)


def inside(doc: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each place a gram of ``n`` may start at: does it end within its text?"""
    size = max(0, total - n + 1)
    ok = np.ones(size + 1, np.int8)
    for back in range(1, n):
        cut = doc[1:-1] - back
        ok[cut[(cut >= 0) & (cut < size)]] = 0
    return ok[:size].astype(bool)
