"""The ledger of a run: what went in, under which settings, what each of the seven stages did, and what was found wrong.

The outputs are written first; sizes of tables are then row counts of written files, which Parquet keeps in its footers, so
the ledger reads no data for them and a retried task cannot count twice.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.constants import FOLDS, SEED
from replyloom.functions.tables import union_all
from replyloom.operators.closure import dangling_refs
from replyloom.operators.quality import quality_gate
from replyloom.operators.threads import conversations_summary
from replyloom.plans.prepare import Prepared, run_report
from replyloom.sources.sinks import write_conversations, write_messages, write_pairs

#: Stages in order, each with the section and name of the number that warns if it is not 0 ('' for any of the section).
STAGES = (
    ("load", None),
    ("validate_schema", ("empty", "")),
    ("clean", None),
    ("reconstruct", ("rebuild", "cyclic_tweets_skipped")),
    ("filter_author", None),
    ("extract_pairs", None),
    ("validate_outputs", ("violations", "")),
)


def write_outputs(run: Prepared, folder: str) -> Prepared:
    """The run with its messages, conversations and pairs written below ``folder`` and read back, and the checks taken on these."""
    spark = run.source.sparkSession
    write_messages(run.threads, f"{folder}/messages")
    threads = spark.read.parquet(f"{folder}/messages")
    write_conversations(conversations_summary(threads), f"{folder}/conversations")
    write_pairs(run.pairs, f"{folder}/pairs")
    conversations, pairs = (spark.read.parquet(f"{folder}/{name}") for name in ("conversations", "pairs"))
    return replace(run, threads=threads, conversations=conversations, pairs=pairs, checks=quality_gate(threads, conversations, pairs, run.author))


def missing_references(collected: DataFrame, source: DataFrame) -> DataFrame:
    """Distinct ids that collected messages refer to and the source does not hold."""
    return dangling_refs(collected).join(source.select("tweet_id"), "tweet_id", "left_anti")


def ledger(run: Prepared, mode: str = "directed", seed: int = SEED, folds: int = FOLDS) -> DataFrame:
    """``(section, name, value)`` of a run whose outputs are written: sections input, settings, closure, scan, empty, cleaning, rebuild, outputs, violations and stages.

    Section ``stages`` holds the rows that each stage passed on (for checks, the checks that passed), in the order of :data:`STAGES`.
    """
    spark = run.source.sparkSession
    count = lambda df: df.agg(F.count(F.lit(1)).alias("value"))
    row = lambda section, name, df: df.select(F.lit(section).alias("section"), F.lit(name).alias("name"), F.col("value").cast("long").alias("value"))
    own = run.collected.filter(F.col("author_id") == run.author)
    settings = [("settings", "random_seed", seed), ("settings", "folds", folds), ("settings", "closure_both_ways", int(mode == "component")), ("settings", "strip_leading_mention", 1)]
    files = run.source.inputFiles()
    given = [*settings, ("input", "files", len(files))]
    return union_all(
        run_report(run),
        spark.createDataFrame(given, "section string, name string, value long"),
        row("input", "rows", count(run.source)),
        row("closure", "author_rows", count(own)),
        row("closure", "collected_rows", count(run.collected)),
        row("closure", "dangling_references", count(missing_references(run.collected, run.source))),
        row("stages", "load", count(run.collected)),
        row("stages", "validate_schema", count(run.source)),
        row("stages", "clean", count(run.cleaned)),
        row("stages", "reconstruct", count(run.rebuilt)),
        row("stages", "filter_author", count(run.threads)),
        row("stages", "extract_pairs", count(run.pairs)),
        row("stages", "validate_outputs", run.checks.agg(F.count_if("passed").alias("value"))),
    )


def stages(entries: DataFrame) -> DataFrame:
    """``(stage_no, stage, status, rows)`` of the seven stages, from the numbers of :func:`ledger`."""
    section, name, value = F.col("section"), F.col("name"), F.col("value")
    told = []
    for no, (stage, rule) in enumerate(STAGES, 1):
        warns = F.lit(False) if rule is None else (section == rule[0]) & F.lit(rule[1]).isin("", name) & (value > 0)
        told.append(F.struct(F.lit(no).alias("stage_no"), F.lit(stage).alias("stage"), warns.alias("warns"), F.when((section == "stages") & (name == stage), value).alias("rows")))
    said = entries.select(F.inline(F.array(*told)))
    return said.groupBy("stage_no", "stage").agg(F.when(F.max("warns"), "WARN").otherwise("OK").alias("status"), F.max("rows").alias("rows"))


def write_ledger(entries: DataFrame, path: str) -> None:
    """The ledger as JSON lines; it has a fixed number of rows."""
    entries.coalesce(1).write.json(path)
