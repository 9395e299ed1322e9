"""Cleaning pipeline over ``documents``: five stages, each a written table.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage
before kept; all but the last return the columns of ``documents``.

Defined results: null and empty texts fail the quality rules (too few words)
and go in the first stage; rows with a null id are judged by their text alone
and are never removed as copies; of rows equal in id and text one stays; other
columns are carried as they are, whatever their names, but for the last
stage, whose results replace columns of their names; empty tables give an empty
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.decontamination import decontaminate
from churnlens.llm.frames import documents, written
from churnlens.llm.jaccard_join import one_per_class
from churnlens.llm.pieces import encode_pieces
from churnlens.llm.quality_rules import quality_rules
from churnlens.llm.substring_dedup import substring_dedup


def _with_own_columns(docs: DataFrame, operator, keep: str | None = None) -> DataFrame:
    """The documents' own columns after an operator that changes the text, and
    whose results may share names with them."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("document"))
    out = operator(packed)
    out = out.where(keep) if keep else out
    return out.select(*[F.col("text") if c == "text" else F.col("document")[c].alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule are cut; documents that are rejected go."""
    return _with_own_columns(docs, quality_rules, "kept")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return one_per_class(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document also holds are cut out."""
    return _with_own_columns(docs, substring_dedup)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids of every text and its sampled segmentations."""
    return encode_pieces(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", encoding_stage),
]

#: Near-duplicate classes and the model's encoding are not expressible in SQL;
#: ``tests/llm/test_llm_pipeline.py`` compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over all rows that the one before kept."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
