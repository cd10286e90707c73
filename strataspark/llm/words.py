"""Vectorised words and shingles of Arrow string columns, for use inside tasks.

Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased, nothing else
is changed. A word is a 64-bit hash of its bytes, so equal words have equal hashes everywhere.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
STEP = _STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_ALL = _BYTE.copy()  # also for spaces
_BYTE[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _STEP) -> np.ndarray:
    """base**0 ... base**(n-1), modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: For models: words are runs of ASCII letters, digits and bytes of other characters.
LETTERS_ONLY = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])


class Words:
    """Hashes of the words of some texts: text i has ``hashes[first[i]:first[i + 1]]``.

    ``start`` and ``end`` are byte offsets of each word in ``data``, ``text_at`` those of the texts.
    ``space`` says which bytes separate words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE):
        self.data, self.text_at, n = data, offsets, len(data)
        if not n:
            self.hashes = np.zeros(0, np.uint64)
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        space = space[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins = ~space
        begins[1:] &= space[:-1] | edge[1:n]
        ends = ~space
        ends[:-1] &= space[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        if not len(self.start):
            self.hashes = np.zeros(0, np.uint64)
            return
        at = np.cumsum(begins) - 1
        within = np.arange(n) - self.start[np.maximum(at, 0)]
        within[: self.start[0]] = 0
        longest = int(within.max()) + 1
        value = (_BYTE_LOWER if lower else _BYTE)[data] * powers(longest)[within]
        value[space] = 0
        self._value, self._within = value, within
        self.hashes = mix(np.add.reduceat(value, self.start) + (self.end - self.start).astype(np.uint64))

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of each word; of shorter words, of the whole."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return mix(np.add.reduceat(np.where(self._within < size, self._value, np.uint64(0)), self.start) ^ np.uint64(size))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(column: pa.Array, lower: bool = True, space: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    """(from, to, Words) for consecutive texts of about CHUNK_BYTES together, so that the arrays
    beside a batch stay small; a longer text is a chunk of its own, whole."""
    data, offsets = string_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower, space)
        i = j


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, with the offsets of each text's run.

    A text with fewer words (but one at least) has one shingle, its whole sequence of words.
    """
    h, first = words.hashes, words.first
    count = np.diff(first)
    made = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(at[-1], np.uint64)
    if not len(out):
        return out, at
    k = len(h) - size + 1
    if k > 0:
        run = np.zeros(k, np.uint64)
        for j in range(size):
            run = run * _STEP + h[j : j + k]
        full = np.flatnonzero(count >= size)
        keep = np.zeros(len(h) + 1, np.int64)
        np.add.at(keep, first[full], 1)
        np.add.at(keep, first[full] + made[full], -1)
        into = np.zeros(len(out) + 1, np.int64)
        np.add.at(into, at[full], 1)
        np.add.at(into, at[full] + made[full], -1)
        out[np.cumsum(into[:-1]) > 0] = mix(run[np.cumsum(keep[:k]) > 0] + np.uint64(size))
    short = np.flatnonzero((count > 0) & (count < size))
    for i in short:
        whole = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in h[first[i] : first[i + 1]]:
                whole = whole * _STEP + x
            out[at[i]] = mix(np.array([whole + np.uint64(count[i])]))[0]
    return out, at
