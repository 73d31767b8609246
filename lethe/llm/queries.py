"""Registered queries of this package: each derives the columns it returns from its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm import decontamination, language_id, license_scan, line_dedup, mixing, ngram_join, quality, substring_dedup, toxicity, warc
from lethe.llm._store import read


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_contamination(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"]).drop("items")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), least_equal=1)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.read(warc.write(read(spark, sf_dir, "pages")), payloads=False)
    return captures.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).drop("places")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.find_components(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def _fold(by: int) -> Column:
    """Remainder of the id's CRC-32; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % by


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(_fold(3) == 1, F.lit(False)))
    model = language_id.fit(docs, train=_fold(3) != 1)
    return language_id.predict(docs, model, keep=["doc_id", "held_out"])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep=["doc_id"]).drop("copies")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(_fold(5) == 0, F.lit(False)))
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), train=_fold(5) != 0)
    return toxicity.score(docs, model, keep=["doc_id", "held_out"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
