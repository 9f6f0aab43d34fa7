"""Processed outputs. Parquet is the primary form; CSV matches the flat files of a spreadsheet user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.constants import MESSAGE_COLUMNS

CSV_OPTIONS = {"header": True, "escape": '"', "quoteAll": True}


def write_messages(threads: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "csv":
        flat = threads.select(*MESSAGE_COLUMNS, "conversation_id", "turn", "file_pos")
        flat.write.options(**CSV_OPTIONS).csv(path)
    else:
        threads.write.parquet(path)


def write_conversations(conversations: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "csv":
        conversations.withColumn("tweet_ids", F.concat_ws(";", "tweet_ids")).write.options(**CSV_OPTIONS).csv(path)
    else:
        conversations.write.parquet(path)


def write_pairs(pairs: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "csv":
        pairs.write.options(**CSV_OPTIONS).csv(path)
    else:
        pairs.write.parquet(path)


def write_golden(golden: DataFrame, path: str, splits_path: str) -> None:
    golden.write.options(**CSV_OPTIONS).csv(path)
    golden.select("conversation_id", "split").write.options(**CSV_OPTIONS).csv(splits_path)
