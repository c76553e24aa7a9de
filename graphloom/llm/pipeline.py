"""The corpus pipeline: quality rules, near-dedup, decontamination, sanitising, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, packing, pii, quality, simhash
from graphloom.llm.common import staged, table
from graphloom.llm.tokens import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; cutoffs come from the labels of this stage's documents."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component, the document of the smallest id stays."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced in the texts; all documents stay."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in sequences of 2048 tokens."""
    return packing.pack_digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("pii sanitising", sanitise), ("best-fit packing", pack)]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what one stage keeps is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
