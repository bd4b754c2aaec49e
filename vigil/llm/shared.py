"""Tables between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.words import longs, mix
from vigil.session import ensure_checkpoint_dir


ROWS_PER_BATCH, TEXTS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 200
BYTES_PER_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's number of rows and bytes that go to a Python worker at once: texts and sets are long, and
    both the executor and the worker hold a batch whole.  Frames are lazy, so the settings stay (README names them)."""
    if int(spark.conf.get(ROWS_PER_BATCH)) > TEXTS_PER_BATCH:
        spark.conf.set(ROWS_PER_BATCH, str(TEXTS_PER_BATCH))
    if int(spark.conf.get(BYTES_PER_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BYTES_PER_BATCH, f"{BATCH_BYTES}b")


def release() -> None:
    """Give a worker's free memory back to the system: workers outlive their tasks, and idle ones keep what they had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(work):
    """A function over batches that gives memory back when its task ends."""
    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()
    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table under ``spark.checkpoint.dir``: computed once, no lineage, survives lost executors."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, ``id`` long and ``text`` string, whatever else the frame has."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BLOOM_BITS, BLOOM_HASHES = 25, 3


def _bloom_places(ids: np.ndarray) -> list[np.ndarray]:
    return [(mix(ids.view(np.uint64), 201 + k) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64) for k in range(BLOOM_HASHES)]


def may_contain(ids: DataFrame, column: str, probe: str) -> Column:
    """A condition on the long column ``probe`` that holds for every id of ``ids[column]`` and for few others.

    A Bloom filter of 2**25 bits (4 MB, whatever the number of ids): built by tasks, merged by an aggregate, broadcast.
    It thins a large side before an exact join; with very many ids it only thins less.
    """
    def places(batches):
        for batch in batches:
            at = np.concatenate(_bloom_places(longs(batch.column(0))[0]))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(np.int64(1) << (at & 63))], names=["word", "bits"])

    words = (ids.select(F.col(column).cast("long")).mapInArrow(places, "word int, bits long")
             .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
    table = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    table[np.asarray(words.column(0))] = np.asarray(words.column(1))
    sent = ids.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def known(values: pa.Array) -> pa.Array:
        found, there = longs(values)
        good = there.copy()
        for at in _bloom_places(found):
            good &= (sent.value[at >> 6] >> (at & 63)) & 1 == 1
        return pa.array(good)
    return known(F.col(probe))
