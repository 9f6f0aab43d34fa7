"""Question-reply pairs and joins on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.constants import PAIR_COLUMNS


def support_pairs(threads: DataFrame, author: str) -> DataFrame:
    """One row per reply of the support author to an inbound message of the same conversation."""
    replies = threads.filter((F.col("author_id") == author) & (F.col("in_response_to_tweet_id") != "")).select(
        "conversation_id",
        F.col("in_response_to_tweet_id").alias("customer_tweet_id"),
        F.col("tweet_id").alias("response_tweet_id"),
        F.col("text").alias("support_response"),
        F.col("created_at").alias("response_created_at"),
        "turn",
    )
    asked = threads.filter("inbound").select(
        "conversation_id",
        F.col("tweet_id").alias("customer_tweet_id"),
        F.col("text").alias("customer_message"),
        F.col("created_at").alias("customer_created_at"),
    )
    return (
        replies.join(asked, ["conversation_id", "customer_tweet_id"])
        .withColumn("tweet_ids", F.concat_ws(";", "customer_tweet_id", "response_tweet_id"))
        .withColumn("created_at", F.col("customer_created_at"))
        .select(*PAIR_COLUMNS)
    )


def members(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a table of keys."""
    return rows.join(ids.select(key), key, "left_semi")


def without(rows: DataFrame, ids: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Rows whose key is not in a table of keys, such as an isolation manifest."""
    return rows.join(ids.select(key), key, "left_anti")


def pair_sizes(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs with the size of their conversation, or their own turn where the conversation is unknown."""
    return pairs.join(sizes.select("conversation_id", "tweets"), "conversation_id", "left").withColumn(
        "turns", F.coalesce(F.col("tweets"), F.col("turn"))
    )


def attach_labels(worksheet: DataFrame, labels: DataFrame) -> DataFrame:
    return worksheet.join(labels.select("conversation_id", "label"), "conversation_id")
