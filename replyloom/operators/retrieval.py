"""Nearest stored rows of a query vector, how good such lists are, and which predictions may go out unseen.

A pass over the stored rows keeps, in each task, the best ``k`` rows found so far of every query, and the score that a
row must beat to be among them; only these lists are moved, and merged by rank. Queries go out in blocks of ``BLOCK``
and meet stored rows in slices of ``SLICE``, so what a task holds does not grow with their number. The work is queries times
rows, as the lists are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replyloom.functions.tables import union_all
from replyloom.functions.vectors import NORM_FLOOR
from replyloom.session import stash

#: Queries that one pass over the stored rows serves, and stored rows that are scored at once.
BLOCK = 4096
SLICE = 1024
#: Scores are equal if they agree in so many digits; then the smaller id comes first.
DIGITS = 9
_FOUND = "query_id string, id string, score double"


def _unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows with ``dim`` finite numbers, and which rows these are."""
    fits = np.flatnonzero(pc.equal(pc.list_value_length(column), dim).fill_null(False).to_numpy(zero_copy_only=False))
    # NULL numbers become NaN
    x = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    finite = np.isfinite(x).all(1)
    x = x[finite]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), NORM_FLOOR), fits[finite]


class _Lists:
    """The best ``k`` rows found so far of every query, as rows ``asked, score, id`` in order of the query."""

    def __init__(self, queries: int, k: int, least: float):
        self.k, self.least = k, least
        self.asked, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.beat, self.full = np.full(queries, least), np.zeros(queries, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes in ``scores``, a row of it for each query."""
        floor = self.beat.copy()
        if scores.shape[1] >= self.k and not self.full.all():
            part = np.partition(scores[~self.full], -self.k, axis=1)[:, -self.k]
            floor[~self.full] = np.maximum(floor[~self.full], part)
        asked, row = np.nonzero(scores >= (floor - 2 * 10.0**-DIGITS)[:, None])  # rounding may make such rows equal
        score = np.round(scores[asked, row], DIGITS)
        some = score >= self.beat[asked]
        if not some.any():
            return
        asked, score, new = asked[some], score[some], ids[row[some]]
        touched = np.zeros(len(self.beat), bool)
        touched[asked] = True
        old = touched[self.asked]
        q, s, i = np.append(self.asked[old], asked), np.append(self.score[old], score), np.append(self.id[old], new)
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last, kept = place == self.k - 1, place < self.k
        self.beat[q[last]], self.full[q[last]] = s[last], True
        self.asked, self.score, self.id = np.append(self.asked[~old], q[kept]), np.append(self.score[~old], s[kept]), np.append(self.id[~old], i[kept])


def _scan(sent, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = sent.value
        lists = _Lists(len(names), k, least)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                x, rows = _unit_rows(part.column("vector"), queries.shape[1])
                if len(rows):
                    lists.add(queries @ x.T, np.array(part.column("id").to_pylist(), object)[rows])
        for start in range(0, len(lists.id), 10_000):
            some = slice(start, start + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in lists.asked[some]], pa.string()), pa.array(lists.id[some].tolist(), pa.string()), pa.array(lists.score[some])], names=["query_id", "id", "score"])

    return run


def topk_retrieval(queries: DataFrame, rows: DataFrame, k: int = 5, least: float = -1.0) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` rows of ``rows (id, vector)`` with the highest cosine to each of ``queries (query_id, vector)``.

    Rows scored below ``least`` are left out. Vectors that are NULL, not finite or of another size than the query's take no part;
    a zero vector scores 0. Leave a query's own row out by an isolation of ids (``pairs.without``) beforehand.
    """
    spark = rows.sparkSession
    stored = rows.select(F.col("id").cast("string").alias("id"), F.transform("vector", lambda v: v.cast("double")).alias("vector")).filter("id is not null")
    # every block reads all rows, which a small file would give to one task
    stored = stash(stored.repartition(spark.sparkContext.defaultParallelism), "stored-vectors")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = lambda lists: lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    asked = stash(queries.select(F.col("query_id").cast("string").alias("query_id"), F.transform("vector", lambda v: v.cast("double")).alias("vector")).filter("query_id is not null and size(vector) > 0"), "queries")
    blocks = asked.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // BLOCK)))))
    found = []
    for part in blocks.select("dim", "block").distinct().orderBy("dim", "block").collect():
        block = blocks.filter((F.col("dim") == part["dim"]) & (F.col("block") == part["block"])).select("query_id", "vector").toArrow()
        unit, fits = _unit_rows(block.column("vector").combine_chunks(), part["dim"])
        names = [block.column("query_id")[int(i)].as_py() for i in fits]
        if names:
            sent = spark.sparkContext.broadcast((names, unit))
            found.append(stash(ranked(stored.mapInArrow(_scan(sent, k, least), _FOUND)).drop("rank"), "found"))
            sent.destroy()
    if not found:
        return spark.createDataFrame([], "query_id string, rank int, id string, score double")
    return ranked(union_all(*found)).select("query_id", "rank", "id", "score")


def same_label(found: DataFrame, queries: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``found`` with ``hit`` where ``queries (query_id, label)`` and ``rows (id, label)`` agree, and the queries whose label the rows have.

    Only the lists are joined with labels, so nothing grows with queries times rows.
    """
    hits = found.join(queries.select("query_id", F.col("label").alias("_asked")), "query_id").join(rows.select("id", F.col("label").alias("_got")), "id")
    answerable = queries.join(rows.select("label").distinct(), "label", "left_semi").select("query_id")
    return hits.withColumn("hit", F.col("_asked") == F.col("_got")).drop("_asked", "_got"), answerable


def recall_at_k(found: DataFrame, queries: DataFrame, cuts: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """``(k, queries, hits, recall, mean_reciprocal_rank)`` of lists ``found (query_id, rank, hit)``, for all of ``queries (query_id)``.

    A query with an empty list is a miss.
    """
    first = found.filter("hit").groupBy("query_id").agg(F.min("rank").alias("rank"))
    placed = queries.select("query_id").distinct().join(first, "query_id", "left")
    row = placed.agg(F.count(F.lit(1)).alias("queries"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in cuts], *[F.sum(F.when(F.col("rank") <= k, 1 / F.col("rank"))).alias(f"r{k}") for k in cuts])
    cells = [
        F.struct(
            F.lit(k).alias("k"), "queries", F.col(f"h{k}").alias("hits"), F.try_divide(F.col(f"h{k}"), F.col("queries")).alias("recall"),
            F.try_divide(F.coalesce(f"r{k}", F.lit(0.0)), F.col("queries")).alias("mean_reciprocal_rank"),
        )
        for k in cuts
    ]
    return row.select(F.inline(F.array(*cells)))


def false_auto_curve(predictions: DataFrame, digits: int = 4) -> DataFrame:
    """``(threshold, auto, wrong, auto_share, false_auto_rate)`` for every confidence that occurs, to ``digits``.

    Rows at or above a threshold go out unseen; the rate is the share of wrong ones among these. Rows are counted by
    confidence first, 10**digits + 1 values at most, and one running total over the counts gives all thresholds.
    """
    sure = F.bround(F.coalesce("confidence", F.lit(0.0)), digits)
    wrong = ~F.col("label").eqNullSafe(F.col("predicted"))
    counts = predictions.groupBy(sure.alias("threshold")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(wrong).alias("_w"))
    above = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = counts.select("threshold", F.sum("_n").over(above).alias("auto"), F.sum("_w").over(above).alias("wrong"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    return totals.select("threshold", "auto", "wrong", (F.col("auto") / F.col("_all")).alias("auto_share"), (F.col("wrong") / F.col("auto")).alias("false_auto_rate"))


def route_decision(predictions: DataFrame, curve: DataFrame, most_wrong: float, always_human: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """Predictions with ``route``, ``auto`` or ``human``.

    ``auto`` is what reaches the lowest threshold of ``curve`` up to which no threshold's false-auto rate passes ``most_wrong``
    (none, if the highest already does), unless its class is one of ``always_human``.
    """
    over = curve.filter(F.col("false_auto_rate") > most_wrong).agg(F.max("threshold").alias("t")).select("t").scalar()
    sure = F.bround(F.coalesce("confidence", F.lit(0.0)), digits)
    auto = (F.coalesce(sure > over, F.lit(True))) & ~F.coalesce(F.col("predicted").isin(*always_human), F.lit(False))
    return predictions.withColumn("route", F.when(auto, "auto").otherwise("human"))
