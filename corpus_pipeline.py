"""The corpus pipeline: documents pass five stages, each written and read again as the next one's input.

    python corpus_pipeline.py SF_DIR OUT

Null ids, empty texts and repeated rows are defined by the operators: a document without
an id is never dropped as a duplicate or a leak, an empty text is kept by every filter.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, importance, minhash, mixing, secret_scan
from quire.session import stage_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the importance resampling draws."""
    return importance.keep_drawn(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of every near-duplicate group."""
    copies = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return _columns(docs.join(stage_table(copies, "copies"), "doc_id", "left_anti"), docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_leaked(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind in brackets; no document goes."""
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: (doc_id, size, source_size, target, taken)."""
    return mixing.mix_report(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
]
#: SQL cannot say the stages' hashing, training and drawing; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


if __name__ == "__main__":
    session = SparkSession.builder.appName("corpus pipeline").getOrCreate()
    run(session, sys.argv[1]).write.parquet(sys.argv[2])
