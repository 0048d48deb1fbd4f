"""The corpus pipeline: quality rules, near duplicates, benchmark passages, secrets, mixture.

Each stage gets the documents that its predecessor kept, and all but the last return
the columns of ``documents``. Stage 2 takes shingles of five words and a similarity of
0.8 or more; stage 4 keeps every document and replaces secrets in its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantfold.llm import decontaminate, near_join, quality_rules, secret_scan, source_mixing
from quantfold.llm.common import table
from quantfold.tables import Stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; thresholds follow from the documents given."""
    return quality_rules.filter_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the smallest id."""
    return near_join.one_per_group(docs, near_join.Rule(width=5, num=80, den=100))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document that it takes at all."""
    return source_mixing.mix_sources(docs).filter("copies > 0")


STAGES = [
    ("quality rules", good_quality),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
]

#: The secret scan measures compressed bytes, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written as Parquet and read again."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = stage.plain(f"stage{k}", step(spark, docs, sf_dir))
    return docs
