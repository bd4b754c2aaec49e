"""Benchmark items inside documents, by SimHash over item-sized windows.

Words are lower-cased (A-Z); shingles are five words (all words of a shorter item) and weigh the bytes of their words.
For each item size, every window of that many words which shares a shingle with an item of the size gets a 128-bit
SimHash; a window that shares none has similarity 0 with all of them.  The items' fingerprints are indexed by their 16
bytes: two fingerprints at most ``radius`` bits apart have a byte in which they differ by ``radius // 16`` bits at
most, so the items listed under the 16 byte values (with all neighbours that near) are all within the radius.  Each is
then checked by Hamming distance and confirmed by the exact weighted similarity of the two bags of shingles,
``2 * common / (window + item)``; at 0.8 a pair is on average 26 bits apart, so the default radius of 40 is three
standard deviations away, and a passage is met by several windows.

The items are sent to executors in blocks of ``block`` items at most, one pass over the texts for each block, so what
is broadcast doesn't grow with the benchmark.  Documents are never shuffled and each is judged alone.

Cases: null or blank texts and items match nothing; a document shorter than an item is one window; repeated items and
repeated documents are reported each; of equally similar windows the first counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.shared import tidy
from vigil.llm.words import Slice, mix, slices

SHINGLE, BYTES, RADIUS, BLOCK = 5, 16, 40, 20_000
HITS = "array<struct<item_id:long,similarity:double,word:int,n_words:int,distance:int>>"
FILTER_BITS = 18


def shingles_of(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, weight, document and first word of the shingles of ``size`` words."""
    hashes, doc, first = part.windows(size)
    lengths = np.zeros(len(part.starts) + 1, np.int64)
    np.cumsum(part.ends - part.starts, out=lengths[1:])
    return hashes, lengths[first + size] - lengths[first], doc, first


def bit_votes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of 128 signed weights for each shingle."""
    raw = np.stack([mix(hashes, 31), mix(hashes, 32)], axis=1).view(np.uint8).reshape(len(hashes), BYTES)
    return (np.unpackbits(raw, axis=1).astype(np.int32) * 2 - 1) * weights[:, None].astype(np.int32)


def fingerprints(votes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash (16 bytes) of ``size`` shingles from each start."""
    sums = np.concatenate([np.zeros((1, BYTES * 8), np.int64), np.cumsum(votes, axis=0, dtype=np.int64)])
    return np.packbits(sums[starts + size] - sums[starts] > 0, axis=1)


def bag(hashes: np.ndarray, weights: np.ndarray) -> dict[int, tuple[int, int]]:
    out: dict[int, tuple[int, int]] = {}
    for h, w in zip(hashes.tolist(), weights.tolist()):
        out[h] = (out[h][0] + 1, w) if h in out else (1, w)
    return out


def bag_similarity(a: dict, b: dict) -> float:
    common = sum(w * min(n, b[h][0]) for h, (n, w) in a.items() if h in b)
    return 2 * common / sum(n * w for x in (a, b) for n, w in x.values())


class Items:
    """A block of benchmark items: shingles, fingerprints and the byte index."""

    def __init__(self, ids: list[int], texts: list[str], radius: int):
        self.radius = radius
        self.sizes: dict[int, list[int]] = {}
        self.by_shingle: dict[int, set[int]] = {}  # shingle -> item sizes it occurs in
        self.ids, self.bags, prints = [], [], []
        row = 0
        for part in slices(pa.array(texts, pa.string()), lower=True):
            for k in range(len(part.rows)):
                n = int(part.n_words[k])
                if not n:
                    continue
                words = slice(part.word_edges[k], part.word_edges[k + 1])
                one = Slice(range(1), part.data[part.starts[words][0]:part.ends[words][-1]],
                            np.array([0, part.ends[words][-1] - part.starts[words][0]]), False)
                hashes, weights, _, _ = shingles_of(one, min(n, SHINGLE))
                self.ids.append(ids[part.rows[k]])
                self.bags.append(bag(hashes, weights))
                prints.append(fingerprints(bit_votes(hashes, weights), np.zeros(1, np.int64), len(hashes))[0])
                self.sizes.setdefault(n, []).append(row)
                for h in hashes.tolist():
                    self.by_shingle.setdefault(h, set()).add(n)
                row += 1
        self.prints = np.array(prints, np.uint8).reshape(-1, BYTES)
        self.keys = np.sort(np.array(list(self.by_shingle), np.uint64))
        self.quick = np.zeros(1 << FILTER_BITS, bool)
        self.quick[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        near = [sum(1 << b for b in bits) for n in range(radius // BYTES + 1) for bits in itertools.combinations(range(8), n)]
        self.index: dict[int, np.ndarray] = {}  # item size -> (byte place, byte value) -> items, as bits
        for size, rows in self.sizes.items():
            listed = np.zeros((BYTES, 256, len(rows)), bool)
            for k, r in enumerate(rows):
                for flip in near:
                    listed[np.arange(BYTES), self.prints[r] ^ flip, k] = True
            self.index[size] = np.packbits(listed, axis=2)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Places whose shingle some item has."""
        at = np.flatnonzero(np.take(self.quick, (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)))
        if not len(at):
            return at
        return at[self.keys[np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)] == hashes[at]]

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, item and distance of all fingerprints of items of the size within the radius."""
        listed = np.bitwise_or.reduce(self.index[size][np.arange(BYTES)[None, :], prints], axis=1)
        window, k = np.nonzero(np.unpackbits(listed, axis=1, count=len(self.sizes[size])))
        item = np.array(self.sizes[size])[k]
        apart = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1)
        good = apart <= self.radius
        return window[good], item[good], apart[good]

    def search(self, hashes, weights, shingle: int, n_words: int, least: float) -> dict[int, tuple]:
        """One document's best window for each item that reaches ``least``; hashes and weights of all its shingles."""
        found: dict[int, tuple] = {}
        starts: dict[int, list[np.ndarray]] = {}
        for p in self.known(hashes).tolist():
            for size in self.by_shingle[int(hashes[p])]:
                if min(size, SHINGLE) == shingle:
                    whole = min(size, n_words)
                    starts.setdefault(size, []).append(np.arange(max(0, p - (whole - shingle)), min(p, n_words - whole) + 1))
        for size, some in starts.items():
            begin = np.unique(np.concatenate(some))
            n = min(size, n_words) - shingle + 1
            low, high = int(begin[0]), int(begin[-1]) + n
            votes = bit_votes(hashes[low:high], weights[low:high])
            window, item, apart = self.candidates(size, fingerprints(votes, begin - low, n))
            last, own = -1, {}
            for w, i, d in zip(window.tolist(), item.tolist(), apart.tolist()):
                at = int(begin[w])
                if at != last:
                    last, own = at, bag(hashes[at:at + n], weights[at:at + n])
                similar = bag_similarity(own, self.bags[i])
                if similar >= least and (i not in found or (-similar, at) < (-found[i][0], found[i][1])):
                    found[i] = (similar, at, min(size, n_words), d)
        return found


@lru_cache(maxsize=4)
def _items(ids: tuple, texts: tuple, radius: int) -> Items:
    return Items(list(ids), list(texts), radius)


def _search(items: Items, texts: pa.Array, least: float) -> pa.Array:
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for part in slices(texts, lower=True):
        for shingle in sorted({min(n, SHINGLE) for n in items.sizes}):
            hashes, weights, doc, first = shingles_of(part, shingle)
            hit = np.unique(doc[items.known(hashes)])
            for d in hit.tolist():
                a, b = np.searchsorted(doc, [d, d + 1])
                found = items.search(hashes[a:b], weights[a:b], shingle, int(part.n_words[d]), least)
                out[part.rows[d]] += [{"item_id": items.ids[i], "similarity": s, "word": at, "n_words": n, "distance": dist}
                                      for i, (s, at, n, dist) in sorted(found.items())]
        # a text of fewer words than a shingle has no shingle of that size: it can't hold the item
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("word", pa.int32()),
                               ("n_words", pa.int32()), ("distance", pa.int32())]))
    return pa.array(out, kind)


def _searcher(sent, radius: int, least: float):
    @F.arrow_udf(HITS)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(lambda some: (_search(_items(*sent.value, radius), texts, least) for texts in some))(batches)
    return search


def benchmark_hits(text: Column, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", *,
                   least: float = 0.8, radius: int = RADIUS, block: int = BLOCK) -> Column:
    """Array column of the items found in ``text``: item_id, similarity, first word, words, bits apart."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n_blocks = -(-rows.count() // block) or 1
    parts = []
    for k in range(n_blocks):
        got = rows.where(F.pmod(F.xxhash64("text", "id"), F.lit(n_blocks)) == k).orderBy("id", "text").collect()
        sent = spark.sparkContext.broadcast((tuple(r[0] for r in got), tuple(r[1] for r in got)))
        parts.append(_searcher(sent, radius, least)(text.cast("string")))
    return parts[0] if n_blocks == 1 else F.concat(*parts)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document and benchmark item found in it."""
    hits = docs.select(F.col(id_col), benchmark_hits(F.col(text_col), benchmark, **options).alias("hits"))
    return hits.where(F.size("hits") > 0).select(F.col(id_col), F.inline("hits"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    return docs.where(F.size(benchmark_hits(F.col(text_col), benchmark, **options)) == 0)
