"""Retrieval, its measures and routing against plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from replyloom.operators import retrieval


def plain(queries, rows, k, least=-1.0):
    out = []
    for q, v in queries:
        scored = []
        for i, w in rows:
            if w is None or len(w) != len(v) or any(c is None or not np.isfinite(c) for c in w):
                continue
            a, b = np.array(v, float), np.array(w, float)
            s = round(float(a @ b / max(np.linalg.norm(a), 1e-12) / max(np.linalg.norm(b), 1e-12)), 9)
            if s >= least:
                scored.append((-s, i))
        out += [(q, r, i, pytest.approx(-s, abs=1e-8)) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda x: x[:2])


def frames(spark, queries, rows):
    return spark.createDataFrame(queries, "query_id string, vector array<double>"), spark.createDataFrame(rows, "id string, vector array<double>").repartition(5)


@pytest.mark.parametrize("block", [2048, 3])
@pytest.mark.parametrize("least", [-1.0, 0.3])
def test_lists_equal_plain_sorting(spark, monkeypatch, block, least):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(f"r{k:03d}", rng.standard_normal(6).tolist()) for k in range(200)]
    rows += [(f"copy{k:02d}", rows[0][1]) for k in range(9)]  # ties: by id
    rows += [("null", None), ("short", [1.0]), ("holes", [1.0, None, 1.0, 1.0, 1.0, 1.0]), ("nan", [float("nan")] * 6), ("zero", [0.0] * 6)]
    queries = [(f"q{k}", rng.standard_normal(6).tolist()) for k in range(8)] + [("same", rows[0][1])]
    q, r = frames(spark, queries, rows)
    got = sorted((tuple(x) for x in retrieval.topk_retrieval(q, r, 5, least).collect()), key=lambda x: x[:2])
    assert got == plain(queries, rows, 5, least)


def test_retrieval_without_rows_or_queries(spark):
    q, r = frames(spark, [("a", [1.0, 0.0]), ("b", None), (None, [1.0, 0.0])], [("x", [1.0, 0.0])])
    assert [tuple(x) for x in retrieval.topk_retrieval(q, r).collect()] == [("a", 1, "x", 1.0)]
    assert retrieval.topk_retrieval(q, r.filter("false")).count() == 0
    assert retrieval.topk_retrieval(q.filter("false"), r).count() == 0


def test_tasks_return_short_lists_only(spark, monkeypatch):
    sizes = []
    keep = retrieval.stash
    monkeypatch.setattr(retrieval, "stash", lambda df, name: (lambda out: sizes.append((name, out.count())) or out)(keep(df, name)))
    rng = np.random.default_rng(2)
    q, r = frames(spark, [(f"q{k}", rng.standard_normal(4).tolist()) for k in range(3)], [(f"r{k}", rng.standard_normal(4).tolist()) for k in range(3000)])
    retrieval.topk_retrieval(q, r, 2).collect()
    assert all(n <= 3 * 2 * r.rdd.getNumPartitions() for name, n in sizes if name == "found")


def test_recall(spark):
    found = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 4, "z"), ("e", 1, "y")], "query_id string, rank int, id string")
    queries = spark.createDataFrame([("a", "L"), ("b", "M"), ("c", "L"), ("d", "none"), ("e", "L")], "query_id string, label string")
    rows = spark.createDataFrame([("x", "K"), ("y", "L"), ("z", "M")], "id string, label string")
    got = {r["k"]: (r["queries"], r["hits"], r["recall"], r["mean_reciprocal_rank"]) for r in retrieval.recall_at_k(*retrieval.same_label(found, queries, rows)).collect()}
    assert got == {1: (4, 1, 0.25, 0.25), 3: (4, 2, 0.5, 0.375), 5: (4, 3, 0.75, 0.4375)}
    none = retrieval.recall_at_k(*retrieval.same_label(found, queries.filter("false"), rows)).first()
    assert none["queries"] == 0 and none["recall"] is None


def predictions(spark, n=300):
    rng = random.Random(5)
    rows = [(str(k), "a" if rng.random() < c else "b", rng.choice("aab"), c) for k in range(n) for c in [round(rng.random(), 2)]]
    return rows, spark.createDataFrame([*rows, ("n", "a", "a", None)], "id string, label string, predicted string, confidence double")


def test_curve_and_route(spark):
    rows, frame = predictions(spark)
    rows = [*rows, ("n", "a", "a", 0.0)]
    curve = retrieval.false_auto_curve(frame)
    for r in curve.collect():
        auto = [x for x in rows if x[3] >= r["threshold"]]
        wrong = sum(x[1] != x[2] for x in auto)
        assert (r["auto"], r["wrong"]) == (len(auto), wrong) and r["false_auto_rate"] == pytest.approx(wrong / len(auto))
    for most in (0.0, 0.2, 1.0):
        over = [r["threshold"] for r in curve.collect() if r["false_auto_rate"] > most]
        want = {x[0]: "auto" if (not over or x[3] > max(over)) and x[2] != "b" else "human" for x in rows}
        assert {r["id"]: r["route"] for r in retrieval.route_decision(frame, curve, most, ("b",)).collect()} == want


def test_routes_without_predictions(spark):
    _, frame = predictions(spark, 1)
    none = frame.filter("false")
    assert retrieval.false_auto_curve(none).count() == 0 and retrieval.route_decision(none, retrieval.false_auto_curve(none), 0.1).count() == 0
    assert retrieval.route_decision(frame, retrieval.false_auto_curve(none), 0.1).filter(F.col("route") == "auto").count() == 2


def test_stored_rows_are_made_once_and_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    made, tasks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    scan = retrieval._scan

    def counted_scan(*args):
        run = scan(*args)
        return lambda batches: (tasks.add(1), run(batches))[1]

    monkeypatch.setattr(retrieval, "_scan", counted_scan)
    rng = np.random.default_rng(3)
    queries, rows = ([(f"{x}{k:03d}", rng.standard_normal(4).tolist()) for k in range(n)] for x, n in (("q", 20), ("r", 400)))
    q, r = frames(spark, queries, rows)
    one_task = r.coalesce(1).mapInArrow(counted, r.schema)
    got = sorted((tuple(x) for x in retrieval.topk_retrieval(q, one_task, 2).collect()), key=lambda x: x[:2])
    assert got == plain(queries, rows, 2)
    assert made.value == 400  # not once for each block of queries
    assert tasks.value >= 2 * spark.sparkContext.defaultParallelism


def test_lists_are_merged_over_slices(monkeypatch):
    rng = np.random.default_rng(4)
    scores = np.round(rng.standard_normal((7, 60)), 1)  # many ties
    ids = np.array([f"{k:02d}" for k in rng.permutation(60)], object)
    lists = retrieval._Lists(7, 5, -0.5)
    for at in (0, 3, 30, 31):
        lists.add(scores[:, at : {0: 3, 3: 30, 30: 31, 31: 60}[at]], ids[at : {0: 3, 3: 30, 30: 31, 31: 60}[at]])
    want = [(q, -s, i) for q in range(7) for s, i in sorted((-s, i) for s, i in zip(scores[q], ids) if s >= -0.5)[:5]]
    assert [*zip(lists.asked.tolist(), lists.score.tolist(), lists.id.tolist())] == want
