"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The columns of the matrix are blocks of the shards, with sizes fixed in advance; its rows are the input partitions,
with their row counts.  Entry (p, b), how many rows of partition p go to block b, has the law it has under a uniformly
random permutation of all rows.  No one holds the matrix: a task finds its own row by walking down a binary tree over
the partitions, splitting the block totals at each node by a multivariate hypergeometric draw that is seeded by the
node, so all tasks agree and a rerun after a lost executor draws the same.  The task deals its rows out by a local
permutation; after the exchange a second permutation inside each block gives the slots.

The input is scanned twice (counts, then rows) and must give the same partitions both times, as a table scan with
narrow steps does; pass ``stable=False`` for other frames and they are written first.

Cases: null text and null ids are rows like any other; fewer rows than shards leave some shards empty; equal rows are
dealt out independently; a column of the input called shard or slot is replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.shared import written
from vigil.llm.words import longs, mix, signed

SHARDS, SEED, BLOCK_ROWS = 40, 20_240_601, 1 << 16
NUMPY_MOST = 10**9 - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn; beyond numpy's range by inverting the distribution around its mean."""
    if good + bad <= NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(good, n)
    share = good / (good + bad)
    reach = 14 * (n * share * (1 - share)) ** 0.5 + 14
    k = np.arange(max(low, int(n * share - reach)), min(high, int(n * share + reach)) + 1, dtype=np.float64)
    steps = np.log((good - k[:-1]) / (k[1:])) + np.log((n - k[:-1]) / (bad - n + k[1:]))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(np.searchsorted(chance, rng.random() * chance[-1], "right"), len(k) - 1)])


def split(rng: np.random.Generator, totals: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows, drawn from all, come from each block."""
    out, left = np.zeros(len(totals), np.int64), int(totals.sum())
    for k, size in enumerate(totals.tolist()):
        left -= size
        out[k] = hypergeometric(rng, size, left, n)
        n -= int(out[k])
        if not n:
            break
    return out


def matrix_row(rows_of: np.ndarray, blocks: np.ndarray, partition: int, seed: int) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(rows_of)])
    low, high, totals = 0, len(rows_of), blocks
    while high - low > 1:
        middle = (low + high) // 2
        left = split(np.random.default_rng([seed, 1, low, high]), totals, int(before[middle] - before[low]))
        if partition < middle:
            high, totals = middle, left
        else:
            low, totals = middle, totals - left
    return totals


def even(n: int, parts: int) -> np.ndarray:
    return n // parts + (np.arange(parts) < n % parts)


@lru_cache(maxsize=4)
def _dealt(partition: int, rows_of: tuple, blocks: tuple, seed: int) -> np.ndarray:
    """The block of each row of a partition."""
    counts = matrix_row(np.array(rows_of, np.int64), np.array(blocks, np.int64), partition, seed)
    return np.random.default_rng([seed, 2, partition]).permutation(np.repeat(np.arange(len(blocks), dtype=np.int32), counts))


def shuffled(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS,
             stable: bool = True) -> DataFrame:
    """The rows of ``docs`` with ``shard`` (sizes at most one apart) and ``slot`` (0 up, without gaps, in each shard)."""
    if not stable:
        docs = written(docs, "unshuffled")
    counted = {r["p"]: r["n"] for r in docs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    rows_of = np.array([counted.get(p, 0) for p in range(max(counted, default=0) + 1)], np.int64)
    sizes = even(int(rows_of.sum()), shards)
    per_shard = max(1, -(-int(sizes.max()) // block_rows))
    blocks = np.concatenate([even(int(n), per_shard) for n in sizes])
    sent = docs.sparkSession.sparkContext.broadcast((tuple(rows_of.tolist()), tuple(blocks.tolist())))

    @F.arrow_udf("struct<block:int,key:long>")
    def deal(places: pa.Array) -> pa.Array:
        at, _ = longs(places)
        partition, row = at >> 33, at & ((1 << 33) - 1)
        block = np.zeros(len(at), np.int32)
        for p in np.unique(partition).tolist():
            own = partition == p
            block[own] = _dealt(p, *sent.value, seed)[row[own]]  # a partition that grew since it was counted fails here
        return pa.StructArray.from_arrays([pa.array(block), pa.array(signed(mix(at.view(np.uint64), seed)))], names=["block", "key"])

    place = docs.drop("shard", "slot").withColumn("__place", F.monotonically_increasing_id()).withColumn("__deal", deal("__place"))
    order = Window.partitionBy("__block").orderBy("__key", "__place")
    block, size = F.col("__block"), F.lit(int(sizes.min())) + (F.floor(F.col("__block") / per_shard) < int((sizes > sizes.min()).sum())).cast("long")
    inner = block % per_shard
    first = inner * F.floor(size / per_shard) + F.least(inner.cast("long"), size % per_shard)
    return (place.withColumn("__block", F.col("__deal.block")).withColumn("__key", F.col("__deal.key"))
            .withColumn("__n", F.row_number().over(order))
            .withColumn("shard", F.floor(block / per_shard).cast("int")).withColumn("slot", (first + F.col("__n") - 1).cast("long"))
            .drop("__place", "__deal", "__block", "__key", "__n"))
