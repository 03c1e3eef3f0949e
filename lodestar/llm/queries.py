"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import oracle, quality
from lodestar.llm.ann import nearest
from lodestar.llm.chat import perspectives
from lodestar.llm.common import text_or_empty
from lodestar.llm.decontaminate import decontaminate
from lodestar.llm.html_extract import extract_pages
from lodestar.llm.licenses import scan_licenses
from lodestar.llm.merkle import digest, manifest
from lodestar.llm.packing import pack_documents
from lodestar.llm.resampling import resample
from lodestar.llm.sharding import histogram_shards
from lodestar.llm.simhash import hex_fingerprint, near_duplicates
from lodestar.llm.suffixes import without_repeats
from lodestar.llm.warc import roundtrip
from lodestar.sources.shared import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in ("documents", "pages") else table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return histogram_shards(docs, 8).select(
        "doc_id",
        "size",
        F.crc32(text_or_empty("text")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.with_scores(docs, model).select(
        "doc_id", (~quality.training_row("doc_id")).alias("held_out"), "score", quality.accepted(F.col("score")).cast("int").alias("predicted")
    )


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(_table(spark, sf_dir, "conversations"))


def op7_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = roundtrip(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op8_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("ck1", "ck2")


def op11_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = manifest(_table(spark, sf_dir, "documents"), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", digest(F.col("siblings")).alias("proof_sha256"), "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_license_scan,
        op2_pattern_packing,
        op3_histogram_shards,
        op4_html_extract,
        op5_quality_classifier,
        op6_perspectives,
        op7_warc_roundtrip,
        op8_vp_tree,
        op9_simhash,
        op10_decontaminate,
        op11_suffix_levels,
        op12_importance_resampling,
        op13_merkle_manifest,
    )
    return {f.__name__: f for f in every}



def oracle_sql() -> dict[str, str]:
    """Tokenizers, compression, densities, XXH64 and splitters have no SQL: tests hold those queries against brute force."""
    return oracle.oracle_sql()
