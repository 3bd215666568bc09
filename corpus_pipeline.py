"""The corpus pipeline: toxicity, near duplicates, benchmark contamination, PII, SentencePiece ids.

Each stage reads what the one before it kept and wrote; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaweave.llm import decontam, neardup, pii, spm, toxicity
from deltaweave.llm.common import materialise, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, score_col="__score", flag_col="__toxic")
    return scored.where("__toxic = 0").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the smallest doc_id."""
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates stand for PII; n_chars follows the text."""
    out = pii.surrogates(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the ids of the whole text."""
    out = spm.encode(docs)
    return out.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").alias("n_tokens"))


STAGES = [("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("sentencepiece", sentencepiece_stage)]

#: Boosted trees, signatures, edit distances and SentencePiece are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
