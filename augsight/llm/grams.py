"""Named words and phrases of Arrow batches, and sums by name inside a task.

A word's name is its 64-bit hash, keyed with the language of its text, so one
spelling in two languages has two names; a phrase is named from the names of
its words.  Texts are cut out only for names that are sent on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from augsight.llm.words import Words, mix, signed, split_words

#: Names that wait in a task before they are summed and sent on, and rows of a batch that is sent.
WAITING, ROWS = 1 << 21, 1 << 16
#: New names that are sorted in at once.
NEW = 1 << 17
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)


def salt(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little")


class Codes:
    """Small numbers for the values of a column (languages, sources), in the order in which a task meets them."""

    def __init__(self):
        self.of: dict = {}

    def __call__(self, values: list) -> np.ndarray:
        return np.array([self.of.setdefault(v, len(self.of)) for v in values], np.int64)

    def values(self) -> list:
        return list(self.of)


def named_words(data: np.ndarray, bounds: np.ndarray, kind, salts: np.ndarray) -> Words:
    """The words of the texts, named with each text's salt."""
    words = split_words(data, bounds, kind)
    words.hash = mix(words.hash ^ salts[words.doc])
    return words


def next_name(name: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Name of the phrase that ``word`` makes of the phrase ``name``."""
    return mix(name * _NEXT + word)


class Spelled:
    """The words of a slice behind one another, each followed by a space, to cut phrases from."""

    def __init__(self, words: Words, fold: np.ndarray):
        length = words.end - words.start
        self.length, self.start = length, np.concatenate([[0], np.cumsum(length + 1)])
        at = np.arange(self.start[-1]) + np.repeat(words.start - self.start[:-1], length + 1)
        self.data = fold[words.data[np.minimum(at, len(words.data) - 1)]] if len(length) else np.empty(0, np.uint8)
        self.data[self.start[1:] - 1] = 32

    def phrases(self, first: np.ndarray, n: int) -> pa.Array:
        """The phrases of ``n`` words that begin with the words ``first``."""
        begin, end = self.start[first], self.start[first + n] - 1
        offsets = np.concatenate([[0], np.cumsum(end - begin)])
        flat = self.data[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], end - begin)]
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])


class Sums:
    """Counts by key.  Keys wait until there are ``WAITING``, are summed then, and are ready once half as many differ."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray | None] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Keys with their counts, or keys that count once each."""
        if len(keys):
            self.keys.append(keys)
            self.counts.append(counts)
            self.waiting += len(keys)

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted keys and their sums."""
        if not self.keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, counts = np.concatenate(self.keys), self.counts
        sizes = [len(k) for k in self.keys]
        self.__init__()
        if all(c is None for c in counts):
            keys.sort()
            first = _firsts(keys)
            return keys[first], np.diff(np.append(first, len(keys)))
        order = np.argsort(keys)
        keys, first = keys[order], _firsts(keys[order])
        every = np.concatenate([np.ones(n, np.int64) if c is None else c for n, c in zip(sizes, counts)])
        return keys[first], np.add.reduceat(every[order], first)

    def ready(self) -> bool:
        if self.waiting < WAITING:
            return False
        self.add(*self.rest())
        return self.waiting >= WAITING // 2


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value of a sorted array begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)


class SpelledSums:
    """Counts by name with the language and the spelling of each name, which is cut out only where a name is new."""

    def __init__(self):
        self.names, self.counts, self.langs = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.spelled = pa.array([], pa.large_string())
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        self.waiting = 0

    def add(self, names: np.ndarray, counts: np.ndarray, langs: np.ndarray, spell) -> None:
        """Distinct sorted names; ``spell`` gives the spellings of some of them by place."""
        at = np.searchsorted(self.names, names)
        known = self.names[np.minimum(at, len(self.names) - 1)] == names if len(self.names) else np.zeros(len(names), bool)
        self.counts[at[known]] += counts[known]
        new = np.flatnonzero(~known)
        if len(new):
            self.parts.append((names[new], counts[new], langs[new].astype(np.int32), spell(new)))
            self.waiting += len(new)
        if self.waiting >= NEW:
            self._settle()

    def _settle(self) -> None:
        """Sort the new names in."""
        parts = [(self.names, self.counts, self.langs, self.spelled), *self.parts]
        names, counts, langs = (np.concatenate(x) for x in list(zip(*parts))[:3])
        spelled = pa.concat_arrays([p[3] for p in parts])
        order = np.argsort(names, kind="stable")
        names = names[order]
        first = _firsts(names)
        self.names, self.langs = names[first], langs[order[first]]
        self.counts = np.add.reduceat(counts[order], first) if len(first) else counts
        self.spelled = spelled.take(pa.array(order[first]))
        self.parts, self.waiting = [], 0

    def ready(self) -> bool:
        return len(self.names) >= WAITING // 2

    def rest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        self._settle()
        out = self.names, self.counts, self.langs, self.spelled
        self.__init__()
        return out


def unique_counts(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, a place of each, and how often each occurs."""
    order = np.argsort(names)
    ordered = names[order]
    first = _firsts(ordered)
    return ordered[first], order[first], np.diff(np.append(first, len(names)))


def rows(columns: dict[str, np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
    """The columns as batches of bounded size; uint64 names become Spark's longs, spellings Spark's strings."""
    arrays = {k: v if isinstance(v, pa.Array) else pa.array(signed(v) if v.dtype == np.uint64 else v) for k, v in columns.items()}
    n = len(next(iter(arrays.values())))
    for lo in range(0, n, ROWS):
        part = {k: v.slice(lo, ROWS) for k, v in arrays.items()}
        yield pa.RecordBatch.from_arrays([v.cast(pa.string()) if v.type == pa.large_string() else v for v in part.values()], list(part))
