"""What the operators share: session set-up, bounded Arrow slices, running totals over a global order."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from replyloom.session import scratch_path, ship, stash

#: Rows of one Arrow batch between Spark and Python; texts may be long, so batches are short.
BATCH_ROWS = 500
BATCH_BYTES = "8m"
_ZSTD = pa.Codec("zstd", compression_level=1)
#: Words of 64 bits in the bitmaps that pick out rows before a shuffle: 1 MB at any size of the table.
BITMAP_WORDS = 1 << 17
#: Text bytes that one numpy step works on; spelling words holds some 150 bytes for each of these.
SLICE_BYTES = 1 << 19


def ready(spark: SparkSession) -> SparkSession:
    """Send the package to the workers and keep Arrow batches small enough for very long texts."""
    ship(spark, "replyloom")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds ``max_bytes`` of ``column`` at most, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts behind each other, and the n + 1 offsets of the texts; NULL is empty."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    sizes = pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    joined = b"".join(filled.to_pylist())
    return np.frombuffer(joined, np.uint8), offsets


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows one by one, so that only one large row is a Python object at a time."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def packed(**arrays) -> bytes:
    """Arrays as one compressed value."""
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw).to_pybytes()


def unpacked(value: bytes) -> dict:
    return pickle.loads(_ZSTD.decompress(value[8:], int.from_bytes(value[:8], "little")).to_pybytes())


def crc(column: Column) -> Column:
    """crc32 of a value's text, as the splits use it; NULL counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def pieces_of(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` dealt into ranges of ``order`` and written once; ``_piece`` numbers the ranges in that order."""
    ranged = df.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id())
    return stash(ranged, name)


def running_total(df: DataFrame, order: list[str], value: str, out: str, name: str) -> DataFrame:
    """Adds ``out``, the total of ``value`` over all rows up to this one in ``order``.

    Rows are range-partitioned, so no key, however frequent, makes a hot task: each range is summed on its own
    and then raised by the totals of the ranges before it (one small row per range).
    """
    cols = [F.col(c) for c in order]
    pieces = pieces_of(df, cols, name)
    totals = pieces.groupBy("_piece").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_piece", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_piece").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    return (
        pieces.withColumn("_own", F.sum(value).over(inside))
        .join(offsets, "_piece")
        .withColumn(out, F.col("_own") + F.col("_before"))
        .drop("_piece", "_own", "_before")
    )


def bitmap(keys: DataFrame, column: str) -> DataFrame:
    """A bitmap of a hash column with at most ``BITMAP_WORDS`` rows of 64 bits, so that it can be broadcast at any size of ``keys``."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITMAP_WORDS * 64))
    marked = keys.select(F.expr("1L").alias("one"), bit.alias("bit"))
    return marked.groupBy(F.shiftright("bit", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("__bits"))


def maybe_in(df: DataFrame, column: str, keys: DataFrame, key_column: str, out: str) -> DataFrame:
    """Adds ``out``: false only if the value is certainly not among ``keys``. No row is moved."""
    bit = F.pmod(F.xxhash64(column), F.lit(BITMAP_WORDS * 64))
    joined = df.withColumn("__bit", bit).join(F.broadcast(bitmap(keys, key_column)), F.shiftright("__bit", 6) == F.col("__word"), "left")
    return joined.withColumn(out, F.coalesce(F.expr("(shiftrightunsigned(__bits, cast(__bit & 63 as int)) & 1) = 1"), F.lit(False))).drop("__bit", "__word", "__bits")


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` less the rows named by ``keys(doc_id, print)``, print being xxhash64(text).

    Rows that a bitmap of the keys excludes stay where they are; only possible hits are compared by a join.
    """
    right = keys.select(F.col("doc_id").alias("__id"), F.col("print").alias("__key")).distinct()
    told = maybe_in(docs.withColumn("__print", F.xxhash64("text")), "__print", right, "__key", "__hit")
    same = (F.col("__print") == F.col("__key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    rest = told.filter("__hit").join(right, same, "left_anti")
    return told.filter(~F.col("__hit")).unionByName(rest).drop("__print", "__hit")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


class Appended:
    """A scratch table that grows by one folder per round."""

    def __init__(self, spark: SparkSession, name: str, schema: str | T.StructType):
        self.spark, self.path, self.schema, self.rounds = spark, scratch_path(spark, name), schema, 0

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{self.rounds:04d}"
        df.write.parquet(path)
        self.rounds += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def read(self) -> DataFrame:
        if not self.rounds:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{k:04d}" for k in range(self.rounds)])
