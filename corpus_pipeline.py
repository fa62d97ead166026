"""The corpus pipeline: documents go through the stages below in turn, each written and read again.

Every stage takes all rows that its predecessor kept. All but the last return the columns of documents; the last returns
one row per piece of a document: in which sequence it stands, and where.

All stages: an empty table gives an empty one. Texts are worked on whole, however long. Extra columns are kept under their names,
whatever those are; the last stage leaves them out. Null sources are a source of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cubespark.llm.common import stash, table
from cubespark.llm.mixing import apply_mix
from cubespark.llm.near_dedup import drop_near_duplicates
from cubespark.llm.packing import pack
from cubespark.llm.quality_rules import keep_good
from cubespark.llm.secret_scan import redact_secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go; null and empty texts are among them. Rows are judged one by one,
    so repeated rows stay or go together. A score that equals the threshold is kept."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one document stays: that of the smallest doc_id, null last, and
    at a tie of the smallest text hash. Rows that repeat id and text are one document. Texts without words stay."""
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, in every row by itself; a null text stays null. n_chars follows."""
    return redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it: not at all, or up to three times. Rows that repeat id, source and size share
    one decision. Documents without words are not taken."""
    return apply_mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are cut into pieces and packed into sequences of several lengths; one without words has a row in no sequence. Each copy
    is packed by itself."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: the stages hash, draw and pack. tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
