"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, pieces.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of ``documents``; only the
last returns piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm import decontaminate, near_dup, pieces, pii, quality
from confluo.llm.common import cut, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of at least 0.3)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dup.dedup(docs)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows don't contaminate, without the windows below that share; n_chars counts the new text."""
    out = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars counts the new text."""
    out = pii.pseudonymise(docs, pii.session_key(spark)).drop("n_candidates", "n_replaced")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, and whether the ids decode to the text."""
    out = pieces.encode(docs, pieces.model_path())
    return out.select("doc_id", "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "lossless")


STAGES = [
    ("quality", good_quality),
    ("near_dup", one_of_each),
    ("decontaminate", not_leaked),
    ("pii", pseudonymous),
    ("pieces", in_pieces),
]
ORACLE_SQL = None  # a fitted classifier and sampled pieces can't be stated in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
