"""The registered queries: each applies one operator of this package to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.chat import formatted, read_back
from vigil.llm.collocations import collocations
from vigil.llm.decontaminate import contaminated
from vigil.llm.filter_audit import audit
from vigil.llm.html_text import extracted
from vigil.llm.license_scan import licensed
from vigil.llm.line_dedup import without_repeats
from vigil.llm.near_dedup import near_duplicates
from vigil.llm.oracle import SQL
from vigil.llm.packing import packed
from vigil.llm.quality import measured
from vigil.llm.sharding import shuffled
from vigil.llm.shared import table
from vigil.llm.substring_dedup import without_repeats as without_repeated_windows
from vigil.llm.url_filter import judged


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=(85, 100))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_windows(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensed(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "line_dedup.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).withColumn("n_chars", F.length("text").cast("long"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = formatted(rows.unionByName(extra)).withColumn("read", read_back(F.col("formatted"), F.col("ends"), F.col("loss")))
    turns = F.concat_ws("", F.transform(F.arrays_zip("read.roles", "read.texts"), lambda t: F.concat(t["roles"], F.lit("\n"), t["texts"], F.lit("\n"))))
    return out.select("conv_id", F.size("read.texts").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                      F.length("read.learned").cast("long").alias("loss_chars"), F.sha2("read.learned", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"), F.size("ids").cast("long").alias("n_tokens"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*[
        F.struct(*[F.lit(v).alias(c) for c, v in zip(("host", "path", "verdict"), rule)]) for rule in URL_RULES])))
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "url_filter.*")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_quality, op3_sharding, op4_substring_dedup, op5_license_scan, op6_packing, op7_decontaminate, op8_line_dedup, op9_html_text, op10_chat,
                                      op11_url_filter, op12_filter_audit, op13_collocations)}
ORACLE_SQL: dict[str, str] = SQL
