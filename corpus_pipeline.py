"""A corpus from raw documents to packed sequences: five stages over the operators of ``segqa.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segqa.llm import line_dedup, packing, quality, secret_scan, simhash
from segqa.llm.queries import CAPACITY, vocabulary
from segqa.plans.scale import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; n_chars follows the text."""
    return _with_length(docs, line_dedup.drop_duplicate_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.keep_first(docs, "doc_id", "text")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their live credentials replaced; n_chars follows the text."""
    return _with_length(docs, secret_scan.redact_live(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of ``CAPACITY`` tokens."""
    return packing.pack(packing.token_pieces(docs, vocabulary(), CAPACITY), "length", CAPACITY)


def _with_length(before: DataFrame, after: DataFrame) -> DataFrame:
    if "n_chars" not in before.columns:
        return after
    kind = dict(before.dtypes)["n_chars"]
    return after.withColumn("n_chars", F.length("text").cast(kind))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("simhash_near_dedup", near_dedup),
    ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing),
]

# Alignment, the shingle hash and merges in rank order are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
