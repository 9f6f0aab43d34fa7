"""Message cleaning, its counters, and removal of repeated ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.functions.tables import unpivot
from replyloom.functions.text import REPEAT_PREFIX, URL, clean_text, collapse, decode_entities, strip


def drop_bad_ids(messages: DataFrame) -> DataFrame:
    return messages.filter((F.col("tweet_id") != "") & (F.col("author_id") != ""))


def clean_messages(messages: DataFrame, strip_leading_mention: bool = True) -> DataFrame:
    return messages.withColumn("text", clean_text(F.col("text"), strip_leading_mention))


def drop_empty_text(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("text") != "")


def dedup_first(messages: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """The first row by ``file_pos`` of every id.

    Only ids that occur more than once are looked at further, so the wide rows are not shuffled when repeats
    are rare, and an id with very many copies is reduced map-side. ``candidates`` may name a cheaper table
    with the same or more ids to find the repeats in.
    """
    source = messages if candidates is None else candidates
    repeated = (
        source.groupBy("tweet_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("tweet_id")
    )
    firsts = (
        messages.select("tweet_id", "file_pos")
        .join(repeated, "tweet_id", "left_semi")
        .groupBy("tweet_id")
        .agg(F.min("file_pos").alias("_first"))
    )
    return (
        messages.join(firsts, "tweet_id", "left")
        .filter(F.col("_first").isNull() | (F.col("_first") == F.col("file_pos")))
        .select(*messages.columns)
    )


def preprocess(messages: DataFrame, strip_leading_mention: bool = True) -> DataFrame:
    """Drop rows without ids, clean the text, drop emptied rows, keep the first row of each id - in this order."""
    valid = drop_bad_ids(messages)
    return dedup_first(drop_empty_text(clean_messages(valid, strip_leading_mention)), candidates=valid)


def cleaning_report(messages: DataFrame, strip_leading_mention: bool = True) -> DataFrame:
    """All cleaning counters as ``(name, value)``. Text counters look at the text before cleaning."""
    before = F.col("text")
    after = F.col("_after")
    valid = (F.col("tweet_id") != "") & (F.col("author_id") != "")
    kept = valid & (after != "")
    mention = F.startswith(before, F.lit("@")) & ~F.startswith(after, F.lit("@"))
    row = (
        messages.withColumn("_after", clean_text(before, strip_leading_mention))
        .agg(
            F.count(F.lit(1)).alias("rows_in"),
            F.count_distinct(F.when(kept, F.col("tweet_id"))).alias("rows_out"),
            F.count_if(F.col("tweet_id") == "").alias("dropped_missing_tweet_id"),
            F.count_if((F.col("tweet_id") != "") & (F.col("author_id") == "")).alias("dropped_missing_author_id"),
            F.count_if(valid & (after == "")).alias("dropped_empty_text"),
            F.count_if(kept).alias("_kept"),
            F.count_if(valid & (decode_entities(before) != before)).alias("decoded_html_entities"),
            F.count_if(valid & before.rlike(REPEAT_PREFIX)).alias("removed_rt_prefix"),
            F.count_if(valid & before.rlike(URL)).alias("removed_urls"),
            F.count_if(valid & mention & F.lit(strip_leading_mention)).alias("removed_leading_mention"),
            F.count_if(valid & (collapse(before) != strip(before))).alias("collapsed_whitespace"),
        )
        .withColumn("dropped_duplicate_tweet_id", F.col("_kept") - F.col("rows_out"))
        .drop("_kept")
    )
    return unpivot(row)
