"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, mixing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept. The last
one adds the columns of the mixture; the others return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarterline.llm.common import shared_path, table
from quarterline.llm.decontaminate import decontaminate
from quarterline.llm.mixture import mix
from quarterline.llm.ngram_join import keep_one
from quarterline.llm.pii import redact
from quarterline.llm.quality import filter_quality

#: The near-duplicate stage: five-word shingles, Jaccard similarity of 0.8 or more.
WIDTH, THRESHOLD = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the adaptive quality rules."""
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    return keep_one(docs, width=WIDTH, threshold=THRESHOLD)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, ``n_chars`` counted anew."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards square-root source weights, in global random order."""
    mixed, names = mix(docs)
    return mixed.withColumnsRenamed({v: k for k, v in names.items()})


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing sources", mixing),
]

#: Edit-distance search and the span classifier have no SQL form; the tests hold brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
