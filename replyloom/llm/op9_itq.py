"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Vectors of unit length are turned by learned rotations into balanced binary codes: the mean is taken off, and each rotation
is improved until the turned vectors lie close to the corners of the cube. Codes are cut into substrings, each of which is
a hash table; vectors that share a table's bucket are candidates. With the mean off, a pair of cosine 0.9 lies at a wider
angle, the more so the longer the mean is. So the agreement of code bits is measured on pairs of that cosine, made of the
sample's vectors with their share of the mean, and sets substring length and tables; then rotations are added until
made pairs and the sample's own nearest-to-the-limit links are met at the target recall. Candidates are reranked with the
original vectors in double precision.

Equal vectors are one vector with copies. A bucket of many vectors is cut into blocks, and pairs of blocks are compared in
separate tasks. A pair that shares several buckets counts in the first of them only, which both codes tell, so link
counts add up without a list of pairs; connections leave a block as a spanning forest.

Defined results: vectors that are NULL, zero, or hold NULL or non-finite components link with nothing and are kept;
vectors of different sizes are not comparable, and each size has an index of its own (sizes of ``FEW`` different
vectors or less are compared in full); a NULL id takes part and components are named by the smallest id that is not NULL; repeated rows are vectors of their own; an empty table
gives an empty table; other columns, labels included, are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.common import table
from replyloom.llm.components import components, spanning_forest
from replyloom.session import stash

COSINE = 0.9
RECALL = 0.98
SAMPLE = 4096
ROUNDS = 40
#: Vectors of one block; a task compares two blocks.
BLOCK = 512
#: So many different vectors of one size need no tables.
FEW = 512
#: Comparisons that cost as much as moving a vector to a table.
COMPARED = 128
PAIRS = 2048
_VECTOR = "code bigint, vector binary, bits binary"


def plan_tables(n: int, dims: int, agree: float, recall: float = RECALL) -> tuple[int, int, int]:
    """Substring length, substrings per rotation, and rotations for ``n`` vectors, if a bit of a pair is the same in the share ``agree``.

    Of the lengths up to that with few vectors in a bucket, the one with the least moves and comparisons.
    """
    longest = min(dims, 60, max(4, math.ceil(math.log2(max(16, n) / 8))))
    hits = [min(agree**bits, 1 - 1e-9) for bits in range(1, longest + 1)]
    tables = [max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit))) for hit in hits]
    bits = 1 + min(range(longest), key=lambda k: tables[k] * (1 + n / 2 ** (k + 1) / COMPARED))
    per_rotation = max(1, dims // bits)
    return bits, per_rotation, math.ceil(tables[bits - 1] / per_rotation)


def pairs_at_limit(sample: np.ndarray, mean: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at cosine ``COSINE``: the sample's vectors, each turned to another one with its share of the mean kept."""
    size = np.linalg.norm(mean)
    axis = mean / size if size > 0 else mean
    x, z = (sample[rng.integers(0, len(sample), PAIRS)] for _ in range(2))
    along = x @ axis
    rest = x - along[:, None] * axis
    length = np.linalg.norm(rest, axis=1)
    cosine = (COSINE - along**2) / np.where(length > 0, length**2, 1)
    side = z - (z @ axis)[:, None] * axis
    side -= ((side * rest).sum(1) / np.where(length > 0, length**2, 1))[:, None] * rest
    far = np.linalg.norm(side, axis=1)
    good = (length > 1e-6) & (far > 1e-6) & (np.abs(cosine) <= 1)
    x, along, rest, length, cosine, side, far = (v[good] for v in (x, along, rest, length, cosine, side, far))
    turned = cosine[:, None] * rest + (np.sqrt(1 - cosine**2) * length / far)[:, None] * side
    return x, along[:, None] * axis + turned


def links_at_limit(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sample's own links, those of the least cosine first, ``PAIRS`` at most."""
    at = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for k in range(0, len(sample), 512):
        cosine = sample[k : k + 512] @ sample.T
        i, j = np.nonzero(cosine >= COSINE)
        low = i + k < j
        i, j, c = i[low] + k, j[low], cosine[i[low], j[low]]
        least = np.argsort(c, kind="stable")[:PAIRS]
        at.append((i[least], j[least], c[least]))
    i, j, c = (np.concatenate(v) for v in zip(*at, strict=True))
    least = np.argsort(c, kind="stable")[:PAIRS]
    return sample[i[least]], sample[j[least]]


def learn_rotation(x: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """A rotation found by alternating between codes and rotation from a random start."""
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return r


def learn_index(sample: np.ndarray, n: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The centre, rotations, substring length and substrings per rotation that reach ``RECALL`` on pairs at the limit.

    The centre is the sample's mean, unless links lie on opposite sides of it and so have too few bits in common; then it is
    zero and the rotations are random, by which every pair at the limit has 1 - acos(0.9) / pi of its bits in common.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    tests = [p for p in (pairs_at_limit(sample, mean, rng), links_at_limit(sample)) if len(p[0])]
    for centre, rounds in ((mean, ROUNDS), (np.zeros_like(mean), 0)):
        rotations = [learn_rotation(sample - centre, rng, rounds)]
        same = [(((a - centre) @ rotations[0] >= 0) == ((b - centre) @ rotations[0] >= 0)).mean() for a, b in tests]
        agree = min(same, default=1 - math.acos(COSINE) / math.pi)
        if rounds and agree < 0.6:
            continue
        bits, per_rotation, planned = plan_tables(n, sample.shape[1], max(0.6, agree))
        met = [np.zeros(len(a), bool) for a, _ in tests]
        while not rounds or len(rotations) <= 4 * planned + 8:
            for hit, (a, b) in zip(met, tests, strict=True):
                hit |= (substrings(a, centre, rotations[-1:], bits, per_rotation) == substrings(b, centre, rotations[-1:], bits, per_rotation)).any(1)
            if len(rotations) >= planned and all(hit.mean() >= RECALL for hit in met):
                return centre, np.stack(rotations), bits, per_rotation
            # learned rotations may come to resemble each other; random ones stay independent
            rotations.append(learn_rotation(sample - centre, rng, rounds if len(rotations) < planned else 0))
    raise AssertionError("random rotations reach any recall")


def substrings(x: np.ndarray, mean: np.ndarray, rotations, bits: int, per_rotation: int) -> np.ndarray:
    """The value of each table's substring for each vector: rows x tables."""
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    out = []
    for r in rotations:
        signs = (x - mean) @ r >= 0
        out += [signs[:, k * bits : (k + 1) * bits] @ weights for k in range(per_rotation)]
    return np.stack(out, axis=1).astype(np.int64)


def _unit(raw: list) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one."""
    dims = max((len(v) for v in raw if v is not None), default=0)
    x = np.full((len(raw), dims), np.nan)
    for k, v in enumerate(raw):
        if v is not None and len(v) == dims:
            x[k] = [np.nan if c is None else c for c in v]
    good = np.isfinite(x).all(1) if dims else np.zeros(len(raw), bool)
    largest = np.abs(np.where(good[:, None], x, 0)).max(1, initial=0)
    good &= largest > 0
    x = np.where(good[:, None], x, 0) / np.where(good, largest, 1)[:, None]
    return x / np.where(good, np.sqrt((x * x).sum(1)), 1)[:, None], good


def _coder(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, rotations, bits, per_rotation = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _ = _unit(batch.column("embedding").to_pylist())
            codes = substrings(x, mean, rotations, bits, per_rotation)
            yield pa.RecordBatch.from_arrays(
                [batch.column("code"), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(codes.tolist(), pa.list_(pa.int64()))],
                names=["code", "vector", "bits", "buckets"],
            )

    return run


def _uncoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All vectors of one size in one bucket, named by the size."""
    for batch in batches:
        raw = batch.column("embedding").to_pylist()
        sizes = np.array([len(v) for v in raw], np.int64)
        for dims in np.unique(sizes):
            mine = np.flatnonzero(sizes == dims)
            x, _ = _unit([raw[k] for k in mine])
            bucket = [dims.tobytes()] * len(mine)
            yield pa.RecordBatch.from_arrays(
                [batch.column("code").take(pa.array(mine)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(bucket, pa.binary()), pa.array([[int(dims)]] * len(mine), pa.list_(pa.int64()))],
                names=["code", "vector", "bits", "buckets"],
            )


def _compare(group: pa.Table) -> pa.Table:
    """One pair of blocks of one bucket: links whose first common table is this one, as counts and a spanning forest."""
    side = group.column("side").to_numpy()
    which = group.column("table")[0].as_py()
    code, copies = group.column("code").to_numpy(), group.column("copies").to_numpy()
    x = np.frombuffer(b"".join(group.column("vector").to_pylist())).reshape(len(code), -1)
    buckets = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.int64).reshape(len(code), -1)
    same_block = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    left = np.flatnonzero(side == 0)
    right = left if same_block else np.flatnonzero(side == 1)
    near = x[left] @ x[right].T >= COSINE - 1e-9
    if same_block:
        near &= np.triu(np.ones(near.shape, bool), 1)
    i, j = np.nonzero(near)
    a, b = left[i], right[j]
    exact = np.einsum("ij,ij->i", x[a], x[b]) >= COSINE
    a, b = a[exact], b[exact]
    earlier = (buckets[a, :which] == buckets[b, :which]).any(1) if which else np.zeros(len(a), bool)
    a, b = a[~earlier], b[~earlier]
    n_links = np.zeros(len(code), np.int64)
    np.add.at(n_links, a, copies[b])
    np.add.at(n_links, b, copies[a])
    some = np.flatnonzero(n_links)
    forest = spanning_forest(code[a], code[b])
    n = len(some)
    return pa.table(
        {
            "code": pa.array([*code[some].tolist(), *[p for p, _ in forest]], pa.int64()),
            "n_links": pa.array([*n_links[some].tolist(), *[None] * len(forest)], pa.int64()),
            "other": pa.array([None] * n + [q for _, q in forest], pa.int64()),
        }
    )


def _found(distinct: DataFrame, coder) -> DataFrame:
    """Links of the vectors ``distinct(code, embedding, copies)`` that share a bucket: counts and spanning forests."""
    coded = stash(
        distinct.select("code", "embedding").mapInArrow(coder, "code bigint, vector binary, bits binary, buckets array<bigint>").join(distinct.select("code", "copies"), "code"), "itq-coded"
    )
    places = coded.select("code", F.posexplode("buckets").alias("table", "bucket"))
    sizes = places.groupBy("table", "bucket").count().filter("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int"))
    placed = places.join(sizes, ["table", "bucket"]).withColumn("block", F.pmod(F.xxhash64("code", "table"), F.col("blocks")).cast("int"))
    # block pairs (i, j) with i <= j; a vector goes to those of its own block, once each
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    tasks = placed.select(
        "code", "table", "bucket",
        F.explode(F.transform(others, lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), (F.col("block") > o).cast("int").alias("side")))).alias("t"),
    ).select("code", "table", "bucket", "t.*")
    with_vectors = tasks.join(coded.select("code", "copies", "vector", "bits"), "code")
    return stash(with_vectors.groupBy("table", "bucket", "i", "j").applyInArrow(_compare, "code bigint, n_links bigint, other bigint"), "itq-found")


def link_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    plain = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, plain).alias("embedding"))
    rows = rows.withColumn("code", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    ids = stash(rows.select("vec_id", "code"), "itq-ids")
    distinct = rows.filter("code is not null").groupBy("code").agg(F.any_value("embedding").alias("embedding"), F.count("*").alias("copies"))
    distinct = stash(distinct.withColumn("dims", F.size("embedding")), "itq-distinct")
    sizes = {r["dims"]: r["count"] for r in distinct.groupBy("dims").count().orderBy("dims").collect()}
    if not sizes:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    large = {dims: n for dims, n in sizes.items() if n > FEW}
    parts = []
    if len(large) < len(sizes):
        parts.append(_found(distinct.filter(~F.col("dims").isin(list(large))) if large else distinct, _uncoded))
    for dims, n in large.items():
        mine = distinct.filter(F.col("dims") == dims)
        sample = mine.orderBy(F.xxhash64("code"), "code").limit(SAMPLE).select("embedding").collect()
        index = learn_index(_unit([r["embedding"] for r in sample])[0], n)
        parts.append(_found(mine, _coder(spark.sparkContext.broadcast(index))))
    found = functools.reduce(DataFrame.unionByName, parts)
    degree = found.filter("n_links is not null").groupBy("code").agg(F.sum("n_links").alias("n_links"))
    named = components(found.filter("other is not null").select(F.col("code").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "code")
    facts = distinct.select("code", "copies").join(degree, "code", "left").join(named, "code", "left").select(
        "code", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "code").alias("component")
    )
    whole = ids.join(facts, "code", "left")
    least = whole.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = whole.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_quantised_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
