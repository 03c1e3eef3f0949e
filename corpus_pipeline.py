"""The corpus pipeline: quality, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import quality
from lodestar.llm.common import bounded, content_key, fresh, stored, text_or_empty
from lodestar.llm.decontaminate import decontaminate
from lodestar.llm.packing import pack_documents
from lodestar.llm.simhash import superseded

#: Rows to take out are broadcast only if they are no more than this (some 100 bytes each).
LISTED = 200_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among them.

    Null and empty texts score the share of good labels, so they stay unless
    most labels are bad; repeated rows get the same score, and null ids are
    scored but never learnt from. Columns of any name and type stay.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "quality")
    return quality.with_scores(docs, model, score_col=score).where(quality.accepted(F.col(score))).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, nulls last, then the smallest content key.

    Rows are told apart by id and text, so texts without an id are dropped as
    copies like any other, and different texts that share an id all count. Of
    rows that repeat both, the one whose columns, as JSON, have the smallest
    hash stays. Columns of any name and type stay as they are.
    """
    keyed, k1, k2 = _keyed(docs)
    i, j1, j2, digest, row = fresh(keyed, "id", "k1", "k2", "digest", "row")
    listed = superseded(docs.select("doc_id", "text")).select(F.col("doc_id").alias(i), F.col("ck1").alias(j1), F.col("ck2").alias(j2), "once")
    listed = stored(listed, "superseded")

    def at(rows: DataFrame) -> Column:
        return keyed["doc_id"].eqNullSafe(rows[i]) & (keyed[k1] == rows[j1]) & (keyed[k2] == rows[j2])

    # few rows are listed: texts are moved only if they are too many to broadcast, and grouped only where rows repeat
    taken, repeated = listed.drop("once"), listed.where("once").drop("once")
    others = keyed.join(bounded(taken, most=LISTED), at(taken), "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return others
    again = keyed.join(bounded(repeated, most=LISTED), at(repeated), "left_semi")
    again = again.withColumn(digest, F.xxhash64(F.to_json(F.struct(*docs.columns))))
    once = again.groupBy("doc_id", k1, k2).agg(F.min_by(F.struct(*docs.columns), digest).alias(row))
    return others.unionByName(once.select(f"{row}.*"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    The decision goes by the text, whatever the id: null and repeated ids and
    repeated rows are kept or dropped with their text. Null and empty texts
    hold no passage and stay. Columns of any name and type stay as they are.
    """
    found = decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    keyed, k1, k2 = _keyed(docs)
    dirty = found.where("contaminated").select(F.col("ck1").alias(k1), F.col("ck2").alias(k2)).distinct()
    dirty = stored(dirty, "dirty")  # a stored side lets a join on a hot text be split
    return keyed.join(bounded(dirty), [k1, k2], "left_anti").select(docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with the content key of its texts, and the names of its two columns, which no column of ``docs`` has."""
    names = fresh(docs, "ck1", "ck2")
    return docs.withColumns(dict(zip(names, content_key(text_or_empty("text"))))), *names


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, in pieces of at most 2,048 tokens with their places in sequences; null texts hold the end id alone, repeated rows are packed each."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("decontaminate", keep_clean), ("pack", pack)]

#: No SQL expresses compression or fingerprints over hashes; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
