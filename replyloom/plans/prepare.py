"""From the message table to checked threads, conversations and pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.functions.tables import union_all, unpivot
from replyloom.operators.cleaning import cleaning_report, preprocess
from replyloom.operators.closure import thread_closure
from replyloom.operators.pairs import support_pairs
from replyloom.operators.profile import dataset_profile, empty_by_column, require_author
from replyloom.operators.quality import quality_gate
from replyloom.operators.threads import (
    convs_with_author,
    conversation_totals,
    reconstruct_threads,
    reconstruction_stats,
)
from replyloom.session import stash


@dataclass
class Prepared:
    """Tables of one run. ``collected`` is the closure before cleaning, ``rebuilt`` all its threads."""

    source: DataFrame
    author: str
    collected: DataFrame
    cleaned: DataFrame
    rebuilt: DataFrame
    threads: DataFrame
    conversations: DataFrame
    pairs: DataFrame
    checks: DataFrame


def prepare(messages: DataFrame, author: str, mode: str = "directed") -> Prepared:
    """Closure, cleaning, rebuilding, account filter, pairs and checks - in this order.

    Cleaning comes before rebuilding, so the replies to a message that was emptied become partial roots. Three
    tables are written on the way, each read several times later: the collected messages (narrowed to the
    account's threads), the cleaned ones, and the rebuilt threads.
    """
    require_author(messages, author)
    collected = stash(thread_closure(messages, author, mode), "collected")
    cleaned = stash(preprocess(collected), "cleaned")
    rebuilt = stash(reconstruct_threads(cleaned), "rebuilt")
    threads = convs_with_author(rebuilt, author)
    conversations = conversation_totals(threads)
    pairs = support_pairs(threads, author)
    checks = quality_gate(threads, conversations, pairs, author)
    return Prepared(messages, author, collected, cleaned, rebuilt, threads, conversations, pairs, checks)


def stage_status(report: DataFrame) -> DataFrame:
    """``(stage, status)`` with OK or WARN, from the report's own numbers."""
    section, name, some = F.col("section"), F.col("name"), F.col("value") > 0
    flags = report.agg(
        F.max((section == "empty") & some).alias("validate_schema"),
        F.max((section == "rebuild") & (name == "cyclic_tweets_skipped") & some).alias("reconstruct"),
        F.max((section == "violations") & some).alias("validate_outputs"),
    )
    return unpivot(flags, "boolean").select(
        F.col("name").alias("stage"), F.when(F.col("value"), "WARN").otherwise("OK").alias("status")
    )


def run_report(run: Prepared) -> DataFrame:
    """All counters of a run as ``(section, name, value)``."""

    def section(name: str, table: DataFrame) -> DataFrame:
        return table.select(F.lit(name).alias("section"), "name", F.col("value").cast("long").alias("value"))

    def rows(name: str, table: DataFrame) -> DataFrame:
        return section("outputs", table.agg(F.count(F.lit(1)).alias("value")).withColumn("name", F.lit(name)))

    empties = empty_by_column(run.source, include_links=False).withColumnsRenamed(
        {"column_name": "name", "empty_values": "value"}
    )
    return union_all(
        section("scan", dataset_profile(run.source)),
        section("empty", empties),
        section("cleaning", cleaning_report(run.collected)),
        section("rebuild", reconstruction_stats(run.cleaned, run.rebuilt)),
        rows("messages", run.threads),
        rows("conversations", run.conversations),
        rows("pairs", run.pairs),
        section("violations", run.checks.withColumn("value", F.col("violations"))),
    )
