"""The impact-ordered search against the scores of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from replyloom.llm import op12_impact_topk as op12

VECTORS = "vec_id long, embedding array<float>, label int, row long, x int, dims int, score string, query int"


def whole(v):
    if v is None or any(c is None or not math.isfinite(c) for c in v):
        return None
    limit = math.floor(2.0**31 / math.sqrt(max(1, len(v))))
    return [int(max(-limit, min(limit, math.floor(1024 * float(np.float32(c)))))) if abs(c) < 1e30 else int(math.copysign(limit, c)) for c in v]


def brute(rows, k):
    vectors = [(d, x) for d, v in rows if (x := whole(v)) is not None]
    out = []
    for i, (d, q) in enumerate(vectors):
        if d is None or d % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, x, strict=True)), e is None, e or 0) for j, (e, x) in enumerate(vectors) if j != i and len(x) == len(q)]
        out += [(d, r, None if missing else e, -s) for r, (s, missing, e) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, **sizes):
    vectors = spark.createDataFrame([(*r, 0, 1, 2, 3, "s", 4) for r in rows], VECTORS)
    return sorted((tuple(r) for r in op12.top_k(vectors, F.col("vec_id") % 100 == 0, **sizes).collect()), key=str)


def vectors(seed, n, dims=12):
    rng = np.random.default_rng(seed)
    return [(k, (rng.standard_normal(dims) / 4).tolist()) for k in range(n)]


@pytest.mark.parametrize("block, pack", [(4096, 1024), (70, 2)])
def test_best_rows_equal_all_scores(spark, block, pack):
    rows = vectors(1, 700)
    rows += [(1000 + k, rows[5][1]) for k in range(300)]  # a third are copies; ids 1000, 1100, 1200 are queries among them
    assert run(spark, rows, block=block, pack=pack) == brute(rows, 10)


def test_odd_vectors_have_defined_results(spark):
    rows = [(100, [0.5, -0.25]), (100, [0.5, -0.25]), (100, [0.5, -0.25]), (100, [9.0, 9.0]), (None, [0.5, 0.5]), (None, None), (200, None), (300, [0.1, None])]
    rows += [(400, [float("nan"), 1.0]), (500, [float("inf"), 0.0]), (600, []), (601, []), (700, [1.0, 2.0, 3.0]), (-100, [-0.0001, 0.0]), (0, [0.0, 0.0]), (7, [3e38, -3e38]), (800, [3e38, 3e38])]
    assert run(spark, rows) == brute(rows, 10)
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == [] and run(spark, [(100, [1.0])]) == []


def test_fewer_than_k(spark):
    rows = vectors(2, 6)
    assert run(spark, rows, k=3) == brute(rows, 3) and len(run(spark, rows)) == 5


def test_processing_ends_early_and_on_proof():
    """Rows near the query are found without reading all postings, and the rows left always hold the best."""
    rng = np.random.default_rng(3)
    x = np.floor(1024 * rng.standard_normal((3000, 32)) / 6).astype(np.int64)
    x[:40] = x[0] + rng.integers(-5, 5, (40, 32))
    block = op12.Block(np.arange(3000), np.ones(3000, bool), x, op12.build_index(x))
    for k in (0, 1, 50, 99):
        left = block.possible(x[k], 11)
        best = np.lexsort((np.arange(3000), -(x @ x[k])))[:11]
        assert set(best) <= set(left) and len(left) <= 3000 * op12.RESCORED
        assert block.best(x[k], 11)[0].tolist() == best.tolist()


def test_segments_cover_every_posting_once():
    random.seed(4)
    x = np.array([[random.choice([-3, 0, 0, 900]) for _ in range(5)] for _ in range(200)])
    index = op12.build_index(x)
    assert index["size"].sum() == x.size
    for c, start, size, most, least in zip(*(index[k] for k in ("component", "start", "size", "most", "least")), strict=True):
        values = x[index["order"][start : start + size], c]
        assert values.max() == most and values.min() == least
