"""A corpus from raw documents to a weighted mix: each stage is one operator, written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from replyloom.llm.common import ready, table
from replyloom.llm.op1_decontaminate import drop_contaminated
from replyloom.llm.op2_lines import remove_repeated_lines
from replyloom.llm.op3_toxicity import drop_toxic, fit
from replyloom.llm.op4_chosen_path import one_of_each
from replyloom.llm.op8_mixing import mix
from replyloom.session import stash


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models reject go."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents that have no other."""
    ready(spark)
    return remove_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; sets of five-word shingles, similarity 0.8."""
    ready(spark)
    return one_of_each(docs, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: ``doc_id, source, size, target, taken``; documents that it takes nothing of go."""
    ready(spark)
    return mix(docs).filter("taken > 0").select("doc_id", "source", "size", "target", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

#: The stages fit a model and follow chains of links, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
