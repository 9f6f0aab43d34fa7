"""Label maps, labelling worksheets and isolation manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyloom.constants import WORKSHEET_COLUMNS

WORKSHEET_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in WORKSHEET_COLUMNS])
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("purpose", T.StringType()),
        T.StructField("conversation_ids", T.ArrayType(T.StringType())),
        T.StructField("count", T.LongType()),
    ]
)


def _only_object(spark: SparkSession, path: str, schema: T.DataType) -> DataFrame:
    """The JSON object of each file as ``value``; a file with more than one object is an error."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), T.ArrayType(schema), {"mode": "FAILFAST"})
    objects = text.select(listed.alias("objects"))
    one = F.when(F.size("objects") == 1, F.col("objects")[0])
    return objects.select(F.coalesce(one, F.raise_error(F.lit("a file must hold one JSON object")).cast(schema)).alias("value"))


def read_label_map(spark: SparkSession, path: str, fmt: str = "lines") -> DataFrame:
    """``(conversation_id, label)`` rows of JSON objects ``{id: label}``: one per line, or ``fmt="object"``, one per file."""
    pairs = T.MapType(T.StringType(), T.StringType())
    if fmt == "object":
        maps = _only_object(spark, path, pairs)
    else:
        maps = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", pairs, {"mode": "FAILFAST"}).alias("value"))
    return maps.select(F.explode("value").alias("conversation_id", "label"))


def write_label_map(labels: DataFrame, path: str) -> None:
    """One JSON object of one id per line, so that no line grows with the table."""
    entry = F.map_from_arrays(F.array("conversation_id"), F.array("label"))
    labels.select(F.to_json(entry).alias("value")).write.text(path)


def read_manifest(spark: SparkSession, path: str, fmt: str = "lines") -> DataFrame:
    """The ids of a manifest: one row per id, or ``fmt="object"``, one object ``{purpose, conversation_ids, count}`` per file."""
    if fmt == "object":
        ids = _only_object(spark, path, MANIFEST_SCHEMA).select(F.explode("value.conversation_ids").alias("conversation_id"))
    else:
        ids = spark.read.schema("purpose string, conversation_id string").json(path).select("conversation_id")
    return ids.distinct()


def write_manifest(golden: DataFrame, path: str, purpose: str = "exclude from evidence corpora") -> None:
    golden.select(F.lit(purpose).alias("purpose"), "conversation_id").distinct().write.json(path)


def write_frame_record(record: DataFrame, path: str) -> None:
    """One JSON object: the sampling frame of a worksheet (:func:`replyloom.operators.sampling.sampling_frame`)."""
    record.coalesce(1).write.json(path)


def read_worksheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORKSHEET_SCHEMA).json(path)


def write_worksheet(openers: DataFrame, path: str) -> None:
    """JSON lines with the five worksheet fields and nothing that could hint at a label."""
    openers.select(*WORKSHEET_COLUMNS).write.json(path)
