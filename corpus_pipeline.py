"""A corpus pipeline of five stages, each the next one's input by Parquet.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
a stage's table is dropped when the next one is written.

Defined cases, in every stage: a null text counts as empty and its row stays
unless a rule takes it; a row with a null doc_id is never a copy or a leak and
stays; very long texts are worked on whole; rows that repeat a doc_id go or stay
together, but for toxicity, which judges each row's text; of equal documents the
smallest doc_id stays, and of a line that repeats the first in the smallest
doc_id; further columns are passed on up to packing, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from studylake.llm import decontamination, line_dedup, near_copies, packing, toxicity
from studylake.llm.common import drop, read_table, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer calls toxic go; it learns from the given labels."""
    scorer = toxicity.fit_scorer(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, scorer)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more stay in the first of them only."""
    return line_dedup.drop_repeated_lines(docs, min_docs=10, keep="first").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of near copies (five-word shingles, similarity 0.8) stays."""
    return near_copies.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontamination.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest, packed: one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeats),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]
#: Fingerprints, learned scores and token ids are beyond SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
