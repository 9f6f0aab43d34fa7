"""Exact top-k inner products by an impact-ordered index, processed score at a time.

Components become integers, floor(1024 * x). Every row is indexed: rows are dealt into blocks by hash, and a block keeps,
for each component and each quantised level of its values, the posting segment of the rows on that level.

A query meets each block once. What a segment can add to a score, its impact, is the query's component times the
segment's largest (or, for a negative component, smallest) value. Segments are processed by descending impact in groups of
a ``GROUPS``-th of the postings; a row's accumulator sums the impacts of its segments. What a row can still gain is bounded twice: by
the next impact times its components not yet seen, and by the lengths of what is left of query and row (Cauchy-Schwarz).
After the first group the rows with the highest accumulators are scored exactly, which gives a k-th best score to beat.
Processing ends only when the bounds prove all but a share ``RESCORED`` of the rows out, or with the last segment; every
row not proved out is rescored exactly.

Blocks return their k + 1 best rows for each query, the query's own row included, and the best of these over all blocks are ranked; then
the query's own row goes. Queries travel in packs of ``PACK``, so a block's index is read once for a pack; no row of a query
is compared outside a block, and no result of a block is larger than k + 1 rows.

Defined results: vectors that are NULL or hold NULL or non-finite components take no part, neither as query nor as
candidate; vectors of different sizes are not comparable, each size has blocks of its own; a vector without components
scores 0 with those like it; components beyond the range in which scores fit 64 bits stop at its ends
(2**31 / sqrt(size)); a NULL id is no query and comes last among equal scores; rows that share an id are rows of their
own: each is a query and a candidate of the other, only one row equal in id and vector counts as the query's own; an
empty table, or one without queries, gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from replyloom.llm.common import packed, rows_of, table, unpacked
from replyloom.session import stash

K = 10
SCALE = 1024
#: Rows of one block of the index, on average.
BLOCK = 4096
#: Queries that travel together.
PACK = 1024
#: Levels of a component's values in a block.
LEVELS = 32
#: A group of segments holds about this share of a block's postings.
GROUPS = 8
#: Share of a block's rows that may be left when processing ends.
RESCORED = 1 / 4
_FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint, own boolean"


def integers(embedding: Column) -> Column:
    """floor(1024 * x) of each component, within the range in which inner products fit 64 bits."""
    limit = F.floor(F.lit(2.0**31) / F.sqrt(F.greatest(F.size(embedding), F.lit(1)))).cast("double")
    return F.transform(embedding, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, limit), -limit)).cast("long"))


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def build_index(x: np.ndarray) -> dict:
    """Posting segments of the rows of ``x`` (rows x components): rows ordered by component and level, and each segment's bounds."""
    n, dims = x.shape
    lowest = x.min(0, initial=0)
    step = np.maximum(1, -(-(x.max(0, initial=0) - lowest + 1) // LEVELS))
    level = (x - lowest) // step
    order = np.argsort(level, axis=0, kind="stable").T.astype(np.int32)
    by_level = np.take_along_axis(level.T, order, axis=1)
    fresh = np.ones((dims, n), bool)
    fresh[:, 1:] = by_level[:, 1:] != by_level[:, :-1]
    start = np.flatnonzero(fresh)
    values = np.take_along_axis(x.T, order, axis=1).ravel()
    some = len(start) > 0
    return {
        "order": order.ravel(),
        "component": (start // max(n, 1)).astype(np.int32),
        "start": start,
        "size": np.diff(start, append=n * dims),
        "most": np.maximum.reduceat(values, start) if some else start,
        "least": np.minimum.reduceat(values, start) if some else start,
    }


class Block:
    """An index block, ready for queries."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, x: np.ndarray, index: dict):
        self.ids, self.known, self.x, self.index = ids, known, x, index
        self.largest = float(np.abs(x).max(initial=0))
        self.wide = x.astype(np.float64)
        self.square = (self.wide**2).sum(1)
        small = np.minimum(np.abs(index["most"]), np.abs(index["least"])).astype(np.float64)
        self.least_square = np.where((index["most"] < 0) == (index["least"] < 0), small, 0) ** 2

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if float(np.abs(q).max(initial=0)) * self.largest * len(q) < 2.0**53:  # sums of doubles are exact
            return (self.wide[rows] @ q.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ q

    def possible(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the ``k`` of the highest score; all others are proved out."""
        n, dims = self.x.shape
        if n <= 4 * k:
            return np.arange(n)
        wide, ix = q.astype(np.float64), self.index
        weight = wide[ix["component"]]
        impact = np.where(weight > 0, weight * ix["most"], weight * ix["least"])
        turn = np.argsort(-impact, kind="stable")
        through = np.cumsum(ix["size"][turn])
        total, seen, seen_q, seen_x = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        length = float(wide @ wide)
        slack = 1 + 1e-9 * np.sqrt(length * self.square.max())
        beat, left, begin = None, np.arange(n), 0
        while begin < len(turn):
            stop = int(np.searchsorted(through, (through[begin - 1] if begin else 0) + n * dims / GROUPS)) + 1
            group = turn[begin:stop]
            size = ix["size"][group]
            ends = np.cumsum(size)
            rows = ix["order"][np.repeat(ix["start"][group] - (ends - size), size) + np.arange(ends[-1])]
            total += np.bincount(rows, np.repeat(impact[group], size), n)
            seen += np.bincount(rows, minlength=n)
            seen_q += np.bincount(rows, np.repeat(weight[group] ** 2, size), n)
            seen_x += np.bincount(rows, np.repeat(self.least_square[group], size), n)
            begin = min(stop, len(turn))
            following = impact[turn[begin]] if begin < len(turn) else 0.0
            gain = np.minimum((dims - seen) * following, np.sqrt(np.maximum(0, length - seen_q) * np.maximum(0, self.square - seen_x)))
            if beat is None:
                first = np.argpartition(-total, 4 * k)[: 4 * k]
                beat = np.sort(self.scores(first, q))[-k]
            left = np.flatnonzero(total + np.where(seen < dims, gain, 0) + slack >= beat)
            if len(left) <= max(4 * k, n * RESCORED):
                break
        return left

    def best(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` rows of the highest score, ties to the smaller id, and their scores."""
        rows = self.possible(q, k)
        score = self.scores(rows, q)
        pick = np.lexsort((self.ids[rows], ~self.known[rows], -score))[:k]
        return rows[pick], score[pick]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), dims)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    known = ~column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False), known


def _index_block(group: pa.Table) -> pa.Table:
    group = group.combine_chunks()
    dims = group.column("dims")[0].as_py()
    x = _matrix(group.column("x").combine_chunks(), dims)
    ids, known = _ids(group.column("vec_id").combine_chunks())
    index = {name: _narrow(v) for name, v in build_index(x).items()}
    value = packed(ids=ids, known=known, x=_narrow(x), index=index)
    return pa.table({"dims": pa.array([dims], pa.int32()), "block": group.column("block").slice(0, 1).combine_chunks(), "value": pa.array([value], pa.binary())})


def _pack(group: pa.Table) -> pa.Table:
    group = group.combine_chunks()
    dims = group.column("dims")[0].as_py()
    value = packed(query=group.column("row").to_numpy(), ids=group.column("vec_id").to_numpy(), x=_narrow(_matrix(group.column("x").combine_chunks(), dims)))
    return pa.table({"dims": pa.array([dims], pa.int32()), "pack": group.column("pack").slice(0, 1).combine_chunks(), "value": pa.array([value], pa.binary())})


def _searched(k: int):
    """Each pack of queries against the block that comes before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for batch in batches:
            for row in rows_of(batch):
                value = unpacked(row["value"])
                if not row["is_pack"]:
                    index = {name: v.astype(np.int64) for name, v in value["index"].items()}
                    block, held = Block(value["ids"], value["known"], value["x"].astype(np.int64), index), (row["dims"], row["block"])
                elif held == (row["dims"], row["block"]):  # else the block got no rows
                    yield _best_of_pack(block, value, k)

    return run


def _best_of_pack(block: Block, pack: dict, k: int) -> pa.RecordBatch:
    names = ["query", "query_id", "vec_id", "score", "own"]
    out: dict[str, list[np.ndarray]] = {name: [] for name in [*names, "known"]}
    for query, query_id, q in zip(pack["query"], pack["ids"], pack["x"].astype(np.int64), strict=True):
        rows, score = block.best(q, k)
        ids, known = block.ids[rows], block.known[rows]
        own = (ids == query_id) & known & (block.x[rows] == q).all(1)
        for name, values in (("query", np.full(len(rows), query)), ("query_id", np.full(len(rows), query_id)), ("vec_id", ids), ("score", score), ("own", own), ("known", known)):
            out[name].append(values)
    whole = {name: np.concatenate(v) for name, v in out.items()}
    arrays = [pa.array(whole[name], mask=~whole["known"] if name == "vec_id" else None) for name in names]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def index_of(rows: DataFrame, shape: DataFrame) -> DataFrame:
    """``dims, block, value``: the index of all ``rows(row, vec_id, x, dims)``, dealt into ``shape(dims, blocks)``."""
    dealt = rows.join(shape.select("dims", "blocks"), "dims").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    return dealt.groupBy("dims", "block").applyInArrow(_index_block, "dims int, block bigint, value binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors(vec_id, embedding)`` that ``is_query`` takes as queries."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = vectors.filter(F.col("embedding").isNotNull() & F.forall("embedding", finite))
    chosen = (F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()).alias("is_query")
    rows = good.select(F.col("vec_id").cast("long").alias("vec_id"), chosen, F.size("embedding").alias("dims"), integers(F.col("embedding")).alias("x"))
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    # one row per vector size
    counts = rows.groupBy("dims").agg(F.ceil(F.count("*") / block).alias("blocks"), F.ceil(F.count_if("is_query") / pack).alias("packs"))
    shape = stash(counts.filter("packs > 0"), "topk-shape")
    index = index_of(rows, shape)
    packs = rows.filter("is_query").join(shape, "dims").withColumn("pack", F.pmod(F.xxhash64("row"), "packs"))
    packs = packs.groupBy("dims", "pack").applyInArrow(_pack, "dims int, pack bigint, value binary")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    sent = index.join(shape, "dims").select("dims", "block", every("packs").alias("pack"), F.lit(False).alias("is_pack"), "value")
    sent = sent.unionByName(packs.join(shape, "dims").select("dims", every("blocks").alias("block"), "pack", F.lit(True).alias("is_pack"), "value"))
    sent = sent.repartition("dims", "block", "pack").sortWithinPartitions("dims", "block", "pack", "is_pack")
    found = sent.select("dims", "block", "is_pack", "value").mapInArrow(_searched(k + 1), _FOUND)
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("own").desc()]
    of_query = Window.partitionBy("query")
    best = found.withColumn("_at", F.row_number().over(of_query.orderBy(*order))).filter(F.col("_at") <= k + 1)
    own_at = F.min(F.when(F.col("own"), F.col("_at"))).over(of_query)
    others = best.withColumn("_own_at", own_at).filter(F.col("_own_at").isNull() | (F.col("_at") != F.col("_own_at")))
    ranked = others.withColumn("rank", F.col("_at") - F.coalesce((F.col("_at") > F.col("_own_at")).cast("int"), F.lit(0)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


SQL = """
with v as (
    select row_number() over () as r, vec_id::bigint as vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
    select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::bigint as score
    from v q join v c on q.r <> c.r and len(q.x) = len(c.x) where q.vec_id % 100 = 0
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by r order by score desc, vec_id) as rank from scored) where rank <= 10
"""
