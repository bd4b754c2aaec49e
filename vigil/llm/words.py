"""Words and their hashes for whole columns of text.

A word is ``[^\\x20\\x09-\\x0D]+``.  Texts are scanned as UTF-8 bytes in slices of a
few dozen kilobytes, so a task's memory is bounded by one slice (or by one
document, where that is longer) and all work on a slice is vectorised.

Hashes are polynomials modulo 2**64 over a random byte table, finished with an
avalanche step.  A prefix sum gives the hash of any range, so windows of any
number of words cost the same.  Equal hashes are taken as equal content.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 16  # temporary arrays of eight times this stay in the cache
MASK = (1 << 64) - 1
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Avalanche step on unsigned 64-bit values (a bijection for each seed)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 7)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b):
        out = np.empty(size, np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done:done + step] = out[:step] * np.uint64(pow(b, done, 1 << 64))
            done += step
        return out
    return run(base), run(pow(base, -1, 1 << 64))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse for exponents 0..n (sizes are rounded up so that few are kept)."""
    return _powers(base, max(1 << 12, 1 << int(n).bit_length()))


class Ranges:
    """Hashes of ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int):
        self.pow, self.inv = powers(base, len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.pow[:len(values)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inv[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


class Slice:
    """Some consecutive documents: bytes, words and hashes.

    ``rows`` are the documents' row numbers in the batch; document ``d`` has bytes
    ``edges[d]:edges[d+1]`` and words ``word_edges[d]:word_edges[d+1]``.
    """

    def __init__(self, rows: range, data: np.ndarray, edges: np.ndarray, lower: bool):
        self.rows, self.edges = rows, edges
        self.data = np.take(LOWER, data) if lower else data
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = np.take(IS_SPACE, data)
        change = space[1:] != space[:-1]
        inner = edges[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begin = change & ~space[1:]
        end = change & space[1:]
        both = inner[~space[inner] & ~space[inner + 1]]  # a word runs across a document's edge: it is two
        begin[both] = True
        end[both] = True
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end)
        self.word_edges = np.searchsorted(self.starts, edges)
        self._bytes = None

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_edges)

    def hash_bytes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._bytes is None:
            self._bytes = Ranges(np.take(BYTE_VALUES, self.data), BYTE_BASE)
        return self._bytes(starts, ends)

    def word_hashes(self) -> np.ndarray:
        return self.hash_bytes(self.starts, self.ends)

    def windows(self, size: int, hashes: np.ndarray | None = None, whole_if_short: bool = False):
        """Hash, document number and first word of every window of ``size`` words inside a document.

        With ``whole_if_short`` a document of fewer words (but one at least) has one window: all its words.
        """
        hashes = self.word_hashes() if hashes is None else hashes
        n = self.n_words
        each = np.maximum(n - size + 1, (n > 0) if whole_if_short else 0)
        doc = np.repeat(np.arange(len(n)), each)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each) + self.word_edges[doc]
        last = np.minimum(first + size, self.word_edges[doc + 1])
        return Ranges(hashes, WORD_BASE)(first, last), doc, first


def slices(texts: pa.Array, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts (null: empty) in slices of about ``most`` bytes, every document whole."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield Slice(range(lo, hi), data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], lower)
        lo = hi


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an integer column (0 for null) and the mask of those that are there."""
    there = np.asarray(column.is_valid())
    return np.asarray(pc.fill_null(column, 0).cast(pa.int64())), there


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: row d has ``values[edges[d]:edges[d+1]]``."""
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values, kind))
