"""The taxonomy as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.constants import LABELS, TAXONOMY


def taxonomy_table(spark: SparkSession) -> DataFrame:
    rows = [(i, label, name, list(signals), escalated) for i, (label, name, signals, escalated) in enumerate(TAXONOMY)]
    return spark.createDataFrame(
        rows, "priority int, label string, name string, signals array<string>, typically_escalated boolean"
    )


def label_table(spark: SparkSession, labels=LABELS) -> DataFrame:
    return spark.createDataFrame(list(enumerate(labels)), "priority int, label string")


def signal_flags(rows: DataFrame) -> DataFrame:
    """Rows with the taxonomy fields of their label; unknown labels get NULLs."""
    return rows.join(taxonomy_table(rows.sparkSession), "label", "left")


def labels_present(predictions: DataFrame, labels=LABELS) -> DataFrame:
    """True and predicted labels of a taxonomy, in taxonomy order."""
    seen = predictions.select("label").union(predictions.select(F.col("predicted").alias("label"))).distinct()
    return label_table(predictions.sparkSession, labels).join(seen, "label", "left_semi").orderBy("priority")
