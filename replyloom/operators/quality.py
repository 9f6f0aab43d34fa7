"""Structural checks. Each yields ``(name, passed, violations, detail)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.constants import LABELS
from replyloom.functions.tables import union_all, unpivot
from replyloom.operators.profile import inbound_distribution


def _check(name: str, violations: DataFrame, detail: str) -> DataFrame:
    """``violations`` has one row and one column: their number."""
    n = F.coalesce(F.col(violations.columns[0]), F.lit(0)).cast("long")
    return violations.select(
        F.lit(name).alias("name"), (n == 0).alias("passed"), n.alias("violations"), F.lit(detail).alias("detail")
    )


def _rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def _where(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("n"))


def _repeated(df: DataFrame, key: str) -> DataFrame:
    return _rows(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))


def ref_integrity(pairs: DataFrame, threads: DataFrame, conversations: DataFrame) -> DataFrame:
    """References of pairs that lead nowhere, as ``(kind, id)``."""
    ids = threads.select(F.col("tweet_id").alias("id"))
    convs = conversations.select(F.col("conversation_id").alias("id"))
    return union_all(
        *[
            pairs.select(F.lit(kind).alias("kind"), F.col(column).alias("id")).join(known, "id", "left_anti")
            for kind, column, known in (
                ("customer_message", "customer_tweet_id", ids),
                ("support_response", "response_tweet_id", ids),
                ("conversation", "conversation_id", convs),
            )
        ]
    ).select("kind", "id")


def _mentions(threads: DataFrame, conversations: DataFrame, pairs: DataFrame, author: str) -> DataFrame:
    """Every id that the three tables hold or name, one row a mention: ``(kind, id)`` and what the row says of it."""
    said = ("message", "own", "conversation", "asked", "answered", "placed", "empty", "homeless")

    def row(kind: str, id: str, **flags: Column | int) -> Column:
        values = [F.lit(0) if f not in flags else F.lit(flags[f]) if isinstance(flags[f], int) else F.coalesce(flags[f], F.lit(False)).cast("int") for f in said]
        return F.struct(F.lit(kind).alias("kind"), F.col(id).cast("string").alias("id"), *[v.alias(f) for v, f in zip(values, said, strict=True)])

    homeless = F.col("conversation_id").isNull() | (F.length("conversation_id") == 0)
    empty = (F.length("customer_message") == 0) | (F.length("support_response") == 0)
    of_pair = [row("message", "customer_tweet_id", asked=1), row("message", "response_tweet_id", answered=1), row("conversation", "conversation_id", placed=1, empty=empty)]
    return union_all(
        threads.select(row("message", "tweet_id", message=1, own=F.col("author_id") == author, homeless=homeless).alias("m")),
        conversations.select(row("conversation", "conversation_id", conversation=1).alias("m")),
        pairs.select(F.explode(F.array(*of_pair)).alias("m")),
    ).select("m.*")


def quality_gate(threads: DataFrame, conversations: DataFrame, pairs: DataFrame, author: str) -> DataFrame:
    """The seven checks of the prepared tables. ``conversations`` has one row per conversation.

    All mentions of an id come together in one aggregate, whose sums hold every check, so each table is read once. A
    reference that is NULL leads nowhere.
    """
    mentions = _mentions(threads, conversations, pairs, author)
    ids = mentions.groupBy("kind", "id").agg(*[F.sum(c).alias(c) for c in mentions.columns[2:]])
    there = lambda c: F.col("id").isNotNull() & (F.col(c) > 0)
    lost = lambda refs, c: F.sum(F.when(there(c), 0).otherwise(refs))
    message, conversation = F.col("kind") == "message", F.col("kind") == "conversation"
    checks = [
        ("pair_ids_exist_in_tweets", lost(F.col("asked") + F.col("answered"), "message"), "pair endpoints are messages"),
        ("pair_conversations_exist", lost(F.col("placed"), "conversation"), "pair conversations are rebuilt conversations"),
        ("pair_messages_non_empty", F.sum("empty"), "both texts of a pair hold something"),
        ("pair_response_ids_unique", F.count_if(message & (F.col("answered") > 1)), "a reply is used once"),
        ("pair_responses_by_support_author", lost(F.col("answered"), "own"), "replies are by the support account"),
        ("conversation_ids_unique", F.count_if(conversation & (F.col("conversation") > 1)), "conversation ids are unique"),
        ("tweets_have_conversation_id", F.sum("homeless"), "every message has a conversation"),
    ]
    totals = ids.agg(*[F.coalesce(total, F.lit(0)).cast("long").alias(name) for name, total, _ in checks])
    rows = [F.struct(F.lit(name).alias("name"), (F.col(name) == 0).alias("passed"), F.col(name).alias("violations"), F.lit(detail).alias("detail")) for name, _, detail in checks]
    return totals.select(F.inline(F.array(*rows)))


def label_coverage(worksheet: DataFrame, labels: DataFrame) -> DataFrame:
    """Worksheet rows without a label and labels without a worksheet row, as ``(problem, conversation_id)``."""
    missing = worksheet.select("conversation_id").join(labels.select("conversation_id"), "conversation_id", "left_anti")
    unknown = labels.select("conversation_id").join(
        worksheet.select("conversation_id"), "conversation_id", "left_anti"
    )
    return union_all(
        missing.select(F.lit("missing_label").alias("problem"), "conversation_id"),
        unknown.select(F.lit("unknown_id").alias("problem"), "conversation_id"),
    )


def valid_label(rows: DataFrame, allowed=LABELS) -> DataFrame:
    """Rows with a flag that says whether their label is a class of the taxonomy."""
    return rows.withColumn("valid", F.coalesce(F.col("label").isin(*allowed), F.lit(False)))


def golden_gate(worksheet: DataFrame, labels: DataFrame, allowed=LABELS) -> DataFrame:
    """The four checks a labelled worksheet must pass."""
    problems = label_coverage(worksheet, labels)
    known = labels.join(worksheet.select("conversation_id"), "conversation_id", "left_semi")
    return union_all(
        _check("worksheet_ids_unique", _repeated(worksheet, "conversation_id"), "a conversation is listed once"),
        _check("all_labelled", _where(problems, F.col("problem") == "missing_label"), "every row has a label"),
        _check("no_unknown_ids", _where(problems, F.col("problem") == "unknown_id"), "every label has a row"),
        _check("labels_valid", _where(valid_label(known, allowed), ~F.col("valid")), "labels are taxonomy classes"),
    )


class GateError(RuntimeError):
    """At least one structural check failed."""


def require_passed(checks: DataFrame) -> None:
    """Raise if any check failed. A gate has a handful of rows."""
    failed = [f"{r.name}: {r.violations}" for r in checks.filter(~F.col("passed")).take(100)]
    if failed:
        raise GateError("checks failed: " + "; ".join(failed))


def reconcile(computed: DataFrame, expected: DataFrame) -> DataFrame:
    """Two ``(name, value)`` tables side by side; a metric on one side only does not match."""
    return (
        computed.select("name", F.col("value").alias("computed"))
        .join(expected.select("name", F.col("value").alias("expected")), "name", "full")
        .withColumn("matches", F.col("computed").eqNullSafe(F.col("expected")) & F.col("computed").isNotNull())
    )


def sum_consistency(threads: DataFrame, conversations: DataFrame) -> DataFrame:
    """Totals over conversations against totals over messages, as ``(name, computed, expected, matches)``."""
    sums = conversations.agg(
        F.sum("customer_tweets").alias("inbound"), F.sum("support_tweets").alias("outbound")
    )
    return reconcile(unpivot(sums), inbound_distribution(threads))
