"""Small table helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot(row: DataFrame, value_type: str = "long") -> DataFrame:
    """A one-row table of metrics to ``(name, value)`` rows."""
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast(value_type).alias("value")) for c in row.columns]
    return row.select(F.explode(F.array(*pairs)).alias("m")).select("m.name", "m.value")


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
