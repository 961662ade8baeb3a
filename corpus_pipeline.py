"""A training-text pipeline of five stages, each working on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoforge.llm import decontam, packing, quality, secrets, setjoin
from cartoforge.llm.common import BATCH_ROWS, spare, table, written


def small_batches(spark: SparkSession) -> None:
    """Whole texts and tokens reach Python in the small batches that written() has, also where a stage's caller writes its rows."""
    for name, most in BATCH_ROWS.items():
        if not 0 < int(spark.conf.get(name)) <= int(most):
            spark.conf.set(name, most)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the positive-unlabelled classifier accepts.

    Null and empty texts are judged as empty ones; repeated rows stay or go together; columns of any name are kept as they are.
    Without positive labels nothing is accepted. An empty table stays empty.
    """
    names = spare(docs, "score", "predicted")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    small_batches(spark)
    return quality.score(docs, model, (names[0], names[1])).where(F.col(names[1]) == 1).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8).

    Rows that repeat a doc_id are one document: they stay or go together, also where their texts differ and one is a copy.
    Rows without doc_id, and texts without words, always stay.
    """
    others = setjoin.near_groups(docs, width=5, num=80, den=100).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark; null and empty texts stay, repeated rows go together."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live-looking secrets; every document stays, null and empty texts as they are."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens; a null or empty text is its end alone, repeated rows are packed each."""
    small_batches(spark)
    return packing.pack(docs).withColumn("ids", F.base64("ids"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", jaccard_join),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("packing", pack),
]

#: The stages' models, hashes and tokens are beyond SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
