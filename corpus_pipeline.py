"""The corpus pipeline: quality classifier, exact dedup, MinHash near-dedup,
benchmark decontamination, SentencePiece encoding.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame.  ``run`` writes each stage's result as Parquet under
the shared checkpoint folder and reads it back as the next stage's ``docs``, so
a lost executor costs a stage's tasks and never its predecessors.  All stages
but the last return the columns of ``documents``; the last replaces the text by
its ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coachload.llm import decontaminate, exact, minhash, pieces, quality
from coachload.llm.base import stored, table
from coachload.llm.q_documents import PIECE_MODEL


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores 0.3 or more."""
    return quality.keep_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space."""
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: five-word shingles, similarity 0.8."""
    return minhash.drop_near_copies(docs, percent=80, width=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids in place of their texts."""
    return pieces.encode(docs, PIECE_MODEL)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", encoding_stage),
]

# The classifier, the near-dedup signatures and the pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
