"""Dataset profile: counts over the whole message table in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.constants import LINK_COLUMNS, MESSAGE_COLUMNS, TOP_AUTHORS
from replyloom.functions.tables import unpivot
from replyloom.functions.text import strip


def dataset_profile(messages: DataFrame, approximate: bool = False) -> DataFrame:
    """Row counts, distinct ids, direction, malformed flags and thread starters as ``(name, value)``.

    ``inbound_raw`` holds the flag as read. Ids are compared as text; empty ids are counted apart from repeats.
    """
    flag = F.lower(strip(F.col("inbound_raw")))
    some_id = F.when(F.col("tweet_id") != "", F.col("tweet_id"))
    distinct = F.approx_count_distinct(some_id) if approximate else F.count_distinct(some_id)
    row = messages.agg(
        F.count(F.lit(1)).alias("total_rows"),
        distinct.alias("unique_tweet_ids"),
        F.count_if(F.col("tweet_id") == "").alias("empty_tweet_ids"),
        F.count_if(flag == "true").alias("inbound_rows"),
        F.count_if(flag != "true").alias("outbound_rows"),
        F.count_if(~flag.isin("true", "false")).alias("malformed_inbound"),
        F.count_if(F.col("in_response_to_tweet_id") == "").alias("conversation_starters"),
    )
    repeats = F.col("total_rows") - F.col("empty_tweet_ids") - F.col("unique_tweet_ids")
    return unpivot(row.withColumn("duplicate_tweet_ids", repeats))


def empty_by_column(messages: DataFrame, include_links: bool = True) -> DataFrame:
    """Number of empty (blank) values per message column."""
    names = [c for c in MESSAGE_COLUMNS if include_links or c not in LINK_COLUMNS]
    source = {c: "inbound_raw" if c == "inbound" else c for c in names}
    row = messages.agg(*[F.count_if(strip(F.col(source[c])) == "").alias(c) for c in names])
    return unpivot(row).withColumnsRenamed({"name": "column_name", "value": "empty_values"})


def top_outbound_authors(messages: DataFrame, n: int = TOP_AUTHORS) -> DataFrame:
    """Outbound authors by number of messages; equal counts in name order."""
    return (
        messages.filter(~F.col("inbound"))
        .groupBy("author_id")
        .agg(F.count(F.lit(1)).alias("tweets"))
        .orderBy(F.desc("tweets"), "author_id")
        .limit(n)
    )


class UnknownAuthorError(LookupError):
    """The support account has no messages."""


def author_presence(messages: DataFrame, author: str, candidates: int = 8) -> DataFrame:
    """``(author_id, tweets, present)`` for the wanted account, followed by the most frequent outbound authors."""
    wanted = messages.filter(F.col("author_id") == author).agg(
        F.lit(author).alias("author_id"), F.count(F.lit(1)).alias("tweets")
    )
    others = top_outbound_authors(messages, candidates).filter(F.col("author_id") != author)
    return wanted.withColumn("role", F.lit("wanted")).unionByName(others.withColumn("role", F.lit("candidate")))


def require_author(messages: DataFrame, author: str, candidates: int = 8) -> None:
    """Refuse to go on with an account that wrote nothing, and name likely ones."""
    if messages.filter(F.col("author_id") == author).limit(1).isEmpty():
        names = [f"{r.author_id} ({r.tweets})" for r in top_outbound_authors(messages, candidates).take(candidates)]
        raise UnknownAuthorError(f"no messages by {author!r}; frequent outbound authors: {', '.join(names)}")


def author_mix(messages: DataFrame, author: str) -> DataFrame:
    """Who wrote the corpus: direction totals, support account, other accounts, customers."""
    inbound = F.col("inbound")
    row = messages.agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(inbound).alias("inbound"),
        F.count_if(~inbound).alias("outbound"),
        F.count_if(F.col("author_id") == author).alias("by_support_author"),
        F.count_if(~inbound & (F.col("author_id") != author)).alias("by_other_outbound"),
        F.count_distinct(F.when(inbound, F.col("author_id"))).alias("customers"),
    )
    return unpivot(
        row.withColumn("inbound_per_customer", F.try_divide(F.col("inbound"), F.col("customers"))), "double"
    )


def inbound_distribution(messages: DataFrame) -> DataFrame:
    return unpivot(
        messages.agg(
            F.count_if("inbound").alias("inbound"), F.count_if(~F.col("inbound")).alias("outbound")
        )
    )


def funnel(messages: DataFrame, threads: DataFrame, conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows left after each step, with their share of all messages and of all starters."""
    scanned = messages.agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("in_response_to_tweet_id") == "").alias("starters"),
    )
    steps = [
        (1, "messages scanned", scanned.select(F.col("messages").alias("n"))),
        (2, "conversation starters", scanned.select(F.col("starters").alias("n"))),
        (3, "corpus messages", threads.agg(F.count(F.lit(1)).alias("n"))),
        (4, "corpus conversations", conversations.agg(F.count(F.lit(1)).alias("n"))),
        (5, "support pairs", pairs.agg(F.count(F.lit(1)).alias("n"))),
    ]
    out = None
    for no, name, counted in steps:
        row = counted.select(F.lit(no).alias("step"), F.lit(name).alias("name"), F.col("n").alias("count"))
        out = row if out is None else out.unionByName(row)
    all_messages = scanned.select("messages").scalar()
    starters = scanned.select("starters").scalar()
    return out.select(
        "step",
        "name",
        "count",
        F.try_divide(F.col("count"), all_messages).alias("share_of_messages"),
        F.try_divide(F.col("count"), starters).alias("share_of_starters"),
    )
