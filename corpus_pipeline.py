"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)``, where ``docs`` is what the stage before kept, and returns a frame; all but
the last return the columns of ``documents``.  Between stages the frame is written as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.decontaminate import without_benchmark
from vigil.llm.line_dedup import without_repeats
from vigil.llm.near_dedup import near_duplicates
from vigil.llm.packing import packed
from vigil.llm.quality import judge
from vigil.llm.shared import bounded_batches, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity band, whose limits fit the labels."""
    bounded_batches(spark)
    return judge(docs, labels=table(spark, sf_dir, "labels")).where("quality.kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line runs that occurred before; a document all of whose lines did goes."""
    bounded_batches(spark)
    cut = without_repeats(docs).where("not (line_dedup.n_removed > 0 and line_dedup.n_removed = line_dedup.n_lines)")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest doc_id; rows without an id stay.

    A row is its id and its text: rows of one id with different texts are documents of their own, equal rows one.
    """
    rows = near_duplicates(docs).where("doc_id is not null")
    first = rows.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("r.*")
    kept = first.union(rows.where("group is null").select("doc_id", "text_hash")).toDF("__id", "__hash")
    held = (docs.withColumn("__h", F.xxhash64("text")).join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("__h") == F.col("__hash")), "left_semi")
            .dropDuplicates(["doc_id", "__h"]))
    return held.select(docs.columns).union(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each token piece with its place in a sequence and a checksum of its ids."""
    return packed(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
