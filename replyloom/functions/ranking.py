"""Row numbers, samples and exact quantiles that never put one whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyloom.constants import SEED
from replyloom.session import stash

def hash_order(unique: Column, seed: int | str = SEED) -> Column:
    """A repeatable random order: md5 of the seed and a unique key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), unique.cast("string")))


def rank_in_groups(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[str],
    carry: str | None = None,
    rank: str = "rank",
    prev: str = "prev",
    total: str | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by order)``, for groups of any size.

    Adds ``rank``; with ``carry`` also ``prev``, its value in the row before; with ``total`` also the group's size.
    ``order`` must be unique within a group. Rows are range-partitioned by (keys, order), written once so that
    the cut points stay fixed, and ranked per range. Only a group that a cut goes through needs more: the rows in
    the ranges before. Each range has two such groups at most, its first and its last, so their table is broadcast.
    """
    keys, cols = [keys] if isinstance(keys, str) else list(keys), df.columns
    ranged = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    pieces = stash(ranged.withColumn("_piece", F.spark_partition_id()), "ranges")
    last = [F.max_by(carry, F.struct(*order)).alias("_last")] if carry else []
    sizes = pieces.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_size"), *last)
    group, along = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_piece")
    offset = F.coalesce(F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sizes.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("_piece").alias("_at"),
        offset.alias("_offset"),
        F.sum("_size").over(group).alias("_total"),
        F.count(F.lit(1)).over(group).alias("_parts"),
        *([F.lag("_last").over(along).alias("_before")] if carry else []),
    ).filter("_parts > 1")
    own = Window.partitionBy(*keys, "_piece")
    within = F.row_number().over(own.orderBy(*order))
    ranked = pieces.withColumn("_within", within)
    if carry:
        ranked = ranked.withColumn("_lag", F.lag(carry).over(own.orderBy(*order)))
    if total:
        ranked = ranked.withColumn("_own", F.count(F.lit(1)).over(own))
    same = F.col("_piece") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = [(F.coalesce("_offset", F.lit(0)) + F.col("_within")).cast("long").alias(rank)]
    if carry:
        out.append(F.when(F.col("_within") == 1, F.col("_before")).otherwise(F.col("_lag")).alias(prev))
    if total:
        out.append(F.coalesce("_total", "_own").alias(total))
    return ranked.join(F.broadcast(cut), same, "left").select(*cols, *out)


def hash_rank(
    df: DataFrame, keys: Sequence[str], unique: str, out: str, seed: int = SEED, total: str | None = None
) -> DataFrame:
    """Rank of every row in the md5 order of its group."""
    hashed = df.withColumn("_hash", hash_order(F.col(unique), seed))
    return rank_in_groups(hashed, keys, ["_hash", unique], rank=out, total=total).drop("_hash")


#: So many rows are taken by Spark's top-n, which merges them in one task.
TOP_ROWS = 1000
#: Bins of one count, and rows of a bin that are looked at in order.
BINS = 4096
_BIN_ROWS = 10_000


def smallest(df: DataFrame, n: int, key: Column, ties: Sequence[Column]) -> DataFrame:
    """The ``n`` rows that come first by a whole number ``key``, then ``ties``; NULL keys come first.

    The place of the n-th row is found by counting: keys fall into equal bins, and the bin that holds the n-th is split
    again, until it is small enough to look at. The rows up to that place are then a filter, so no task
    ever holds more than its own part. Rows equal in key and ties are interchangeable.
    """
    if n <= TOP_ROWS:
        return df.orderBy(key, *ties).limit(n)
    keyed = df.select(F.coalesce(key, F.lit(-(2**62))).alias("key"), F.struct(*[t.alias(f"t{i}") for i, t in enumerate(ties)]).alias("ties"))
    row = keyed.agg(F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")).first()
    low, high, before, inside = row["low"], row["high"], 0, row["rows"]
    if inside <= n:
        return df
    while low < high and inside > _BIN_ROWS:
        width = (high - low) // BINS + 1
        part = keyed.filter(F.col("key").between(low, high))
        counted = part.groupBy(F.expr(f"(key - {low}L) div {width}L").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
        for bin_, rows in sorted((r["bin"], r["rows"]) for r in counted.collect()):
            if before + rows >= n:
                break
            before += rows
        low, inside = low + bin_ * width, rows
        high = min(high, low + width - 1)
    part = keyed.filter(F.col("key").between(low, high))
    found = part.orderBy("key", "ties").limit(n - before).groupBy("key", "ties").agg(F.count(F.lit(1)).alias("rows"))
    last = found.orderBy(F.desc("key"), F.desc("ties")).first()
    at = F.struct(*[F.lit(v).alias(f"t{i}") for i, v in enumerate(last["ties"])])
    own_key, own_ties = F.coalesce(key, F.lit(-(2**62))), F.struct(*[t.alias(f"t{i}") for i, t in enumerate(ties)])
    below = (own_key < last["key"]) | ((own_key == last["key"]) & (own_ties < at))
    here = (own_key == last["key"]) & own_ties.eqNullSafe(at)
    if part.filter((F.col("key") == last["key"]) & F.col("ties").eqNullSafe(at)).count() == last["rows"]:
        return df.filter(below | here)
    return df.filter(below).unionByName(df.filter(here).limit(last["rows"]))


def hash_sample(df: DataFrame, n: int, unique: str, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows (or all, if there are fewer), uniform and repeatable."""
    digest = hash_order(F.col(unique), seed)
    return smallest(df, n, F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), [digest, F.col(unique)])


def exact_quantiles(df: DataFrame, value: str, points: Sequence[float], width: int = 1) -> DataFrame:
    """Exact linear-interpolated quantiles of a whole-number column, as rows ``(q, value)``.

    Values are counted first, then counts are ranked in buckets of ``width`` values, so that no task sees more
    than one bucket of distinct values.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_bucket", F.floor(F.col("_v") / F.lit(width)))
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("_bucket").agg(F.sum("_c").alias("_size"))
    offsets = buckets.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    running = Window.partitionBy("_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = buckets.agg(F.sum("_size").alias("n")).scalar()
    spans = (
        counts.join(offsets, "_bucket")
        .withColumn("_hi", F.col("_offset") + F.sum("_c").over(running))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
        .select("_v", "_lo", "_hi", total.alias("_n"))
    )
    # Each value serves the quantiles whose lower or upper neighbour lies in its span.
    wanted = F.array(*[F.lit(float(q)) for q in points])
    position = lambda q: q * (F.col("_n") - 1)
    hits = F.transform(
        wanted,
        lambda q: F.struct(
            q.alias("q"),
            ((F.floor(position(q)) >= F.col("_lo")) & (F.floor(position(q)) < F.col("_hi"))).alias("low"),
            ((F.ceil(position(q)) >= F.col("_lo")) & (F.ceil(position(q)) < F.col("_hi"))).alias("high"),
            (position(q) - F.floor(position(q))).alias("part"),
        ),
    )
    return (
        spans.select("_v", F.explode(hits).alias("h"))
        .filter("h.low OR h.high")
        .groupBy(F.col("h.q").alias("q"))
        .agg(
            F.max(F.when(F.col("h.low"), F.col("_v"))).alias("_low"),
            F.max(F.when(F.col("h.high"), F.col("_v"))).alias("_high"),
            F.max("h.part").alias("_part"),
        )
        .select("q", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("value"))
    )
