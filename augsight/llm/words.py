"""Words and word hashes of whole Arrow batches, in numpy.

A text column of an Arrow batch is one byte buffer.  Word boundaries are
found on the bytes of all texts at once, and each word gets a 64-bit hash
from prefix sums of a polynomial, so the cost is a few array operations per
byte and no Python object per word.  Bytes from 0x80 on belong to characters
beyond ASCII, so a class of ASCII bytes plus "all others" is exact on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
#: Words are hashed in blocks of about so many bytes.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Words ``[^\x20\x09-\x0D]+`` as they are, and the same with A-Z lower-cased.
AS_IS = (_NOT_SPACE, np.arange(256, dtype=np.uint8))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
FOLDED = (_NOT_SPACE, _FOLD)
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z lower-cased.
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True
ALNUM_FOLDED = (_ALNUM, _FOLD)


@dataclass
class Words:
    """Words of consecutive texts: of word i, text ``doc[i]``, bytes ``start[i]:end[i]`` of ``data``, ``hash[i]``.

    ``first[d]:first[d + 1]`` are the words of text d.
    """

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    bounds: np.ndarray

    def text(self, i: int, j: int, sep: bytes = b" ") -> bytes:
        """Words i to j - 1 joined."""
        raw = self.data
        return sep.join(raw[s:e].tobytes() for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist()))

    def grams(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of ``n`` words inside one text."""
        if len(self.hash) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        m = len(self.hash) - n + 1
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1:])
        factor = np.uint64((int(_GRAM) + seed * 0x5851F42D4C957F2E) % (1 << 64))  # odd for every seed
        acc = self.hash[:m].copy()
        for j in range(1, n):
            acc *= factor
            acc += self.hash[j:j + m]
        return at, mix(acc)[at]


    def range_hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the word sequences ``lo[i]:hi[i]``."""
        up, down = _powers(len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[:len(self.hash)], out=sums[1:])
        return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))

    def joined(self, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts with their (``kept``) words joined by one space, and the texts' bounds in them."""
        start, end, doc = (self.start, self.end, self.doc) if kept is None else (self.start[kept], self.end[kept], self.doc[kept])
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[start] += 1
        edge[end] -= 1
        keep = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        out = self.data.copy()
        gap = end[:-1][doc[:-1] == doc[1:]]  # the byte after a word that another follows
        keep[gap] = True
        out[gap] = 32
        total = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=total[1:])
        return out[keep], total[self.bounds]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with their text bytes and the texts' offsets; a null text has no bytes."""
    for batch in batches:
        column = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
        if not len(column):
            continue
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE_BYTES, "right")) - 1)
            own = bounds[lo:hi + 1] - bounds[lo]
            yield batch.slice(lo, hi - lo), data[bounds[lo]:bounds[hi]], own
            lo = hi
        pa.default_memory_pool().release_unused()


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def split_words(data: np.ndarray, bounds: np.ndarray, kind: tuple[np.ndarray, np.ndarray]) -> Words:
    """The words of texts ``data[bounds[d]:bounds[d + 1]]``."""
    is_word, fold = kind
    inside = is_word[data]
    edge = bounds[:-1][np.diff(bounds) > 0]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    begins[edge] = inside[edge]
    last = bounds[1:][np.diff(bounds) > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(bounds, start, "right") - 1
    hashes = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + BLOCK_BYTES, "right")))
        a, b = int(start[lo]), int(end[hi - 1])
        up, down = _powers(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_VALUE[fold[data[a:b]]] * up[:b - a], out=sums[1:])
        hashes[lo:hi] = (sums[end[lo:hi] - a] - sums[start[lo:hi] - a]) * down[start[lo:hi] - a]
        lo = hi
    hashes ^= (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    first = np.searchsorted(doc, np.arange(len(bounds)))
    return Words(data, doc, start, end, mix(hashes), first, bounds)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
