"""Message tables: CSV dump in, typed columnar table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyloom.constants import ID_COLUMNS, MESSAGE_COLUMNS, SEED
from replyloom.functions.ranking import hash_sample, smallest
from replyloom.functions.text import parse_created_at, split_ids, strip

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in MESSAGE_COLUMNS])


class SchemaError(ValueError):
    """The input lacks required columns."""


def check_columns(columns) -> None:
    missing = [c for c in MESSAGE_COLUMNS if c not in set(columns)]
    if missing:
        raise SchemaError(f"missing column(s): {missing}; required: {list(MESSAGE_COLUMNS)}")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """The dump as text columns in header order, empty fields as ``''``, with ``file_pos``.

    Quoted texts hold line breaks, so each file is read by one task; ship a large dump as many files. The
    position is made of the file's rank by name and the row's position within the file.
    """
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    check_columns(header.columns)
    rows = (
        spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header.columns]))
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"))
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # Names only: the content column is pruned from this listing.
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"))
    numbered = files.withColumn("_no", F.row_number().over(Window.orderBy("_file")).cast("long"))
    filled = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in header.columns]
    return rows.join(numbered, "_file").select(
        *filled, (F.shiftleft(F.col("_no") - 1, 33) + F.col("_row")).alias("file_pos")
    )


def normalise(raw: DataFrame) -> DataFrame:
    """Strip the id columns and turn ``inbound`` into a boolean; anything but ``true`` is outbound."""
    out = raw
    for c in ID_COLUMNS:
        out = out.withColumn(c, strip(F.col(c)))
    return out.withColumn("inbound", F.lower(strip(F.col("inbound"))) == "true")


def with_types(messages: DataFrame) -> DataFrame:
    """Add the parsed child list and the parsed time to a normalised table."""
    return messages.withColumn("response_ids", split_ids(F.col("response_tweet_id"))).withColumn(
        "ts", parse_created_at(F.col("created_at"))
    )


def ingest_messages(spark: SparkSession, csv_path: str, table_path: str) -> DataFrame:
    """Parse the dump once; every later step reads the written table. The raw flag is kept for the profile."""
    raw = read_raw_csv(spark, csv_path)
    normalise(raw.withColumn("inbound_raw", F.col("inbound"))).write.parquet(table_path)
    return spark.read.parquet(table_path)


def first_rows(messages: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of the file (development only: it cuts threads)."""
    return smallest(messages, n, F.col("file_pos"), [F.lit("")])


def sample_rows(messages: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows, uniform and repeatable (development only: it cuts threads)."""
    return hash_sample(messages, n, "tweet_id", seed)


def read_prepared(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Thread messages as written by :mod:`replyloom.sources.sinks`, with their types."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in (*MESSAGE_COLUMNS, "conversation_id", "turn", "file_pos")]
    )
    rows = spark.read.schema(schema).options(header=True, multiLine=True, escape='"').csv(path)
    return with_types(
        rows.na.fill("")
        .withColumn("inbound", F.lower("inbound") == "true")
        .withColumn("turn", F.col("turn").cast("long"))
        .withColumn("file_pos", F.col("file_pos").cast("long"))
    )
