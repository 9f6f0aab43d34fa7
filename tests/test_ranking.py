import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from replyloom.functions import ranking
from replyloom.functions.ranking import exact_quantiles, hash_order, hash_rank, hash_sample, rank_in_groups, smallest


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.choice([None, 1, 2]), i, f"v{i}") for i in range(3000)]
    return spark.createDataFrame(rows, "k string, t int, i int, v string").withColumn("nt", F.col("t").isNull()).repartition(6)


@pytest.mark.parametrize("parts", [1, 8, 60])
def test_rank_in_groups(spark, skewed, parts):
    w = Window.partitionBy("k").orderBy("nt", "t", "i")
    plain = skewed.select("k", "v", F.row_number().over(w).cast("long").alias("rank"), F.lag("v").over(w).alias("prev"))
    plain = plain.withColumn("n", F.count("*").over(Window.partitionBy("k")))
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = rank_in_groups(skewed, "k", ["nt", "t", "i"], carry="v", total="n").select("k", "v", "rank", "prev", "n")
        assert out.count() == 3000
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert out.exceptAll(plain).isEmpty()


def test_hash_rank(skewed):
    w = Window.partitionBy("k").orderBy(hash_order(F.col("v"), 42), "v")
    plain = skewed.select("v", F.row_number().over(w).alias("r"))
    assert hash_rank(skewed, ["k"], "v", "r").select("v", "r").exceptAll(plain).isEmpty()


@pytest.mark.parametrize("n", [0, 1, 500, 5000])
def test_hash_sample(skewed, n):
    expected = {r["v"] for r in skewed.orderBy(hash_order(F.col("v"), 42), "v").limit(n).collect()}
    assert {r["v"] for r in hash_sample(skewed.repartition(3), n, "v").collect()} == expected


@pytest.mark.parametrize("width", [1, 7])
def test_exact_quantiles(spark, width):
    rng = random.Random(3)
    values = [rng.choice([5, 5, 5, rng.randrange(200)]) for _ in range(777)]
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    out = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v int"), "v", points, width).collect()
    assert {r["q"]: pytest.approx(r["value"]) for r in out} == dict(zip(points, np.quantile(values, points)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bin_rows", [10_000, 3])
@pytest.mark.parametrize("n", [1001, 1500, 2999, 3000, 4000])
def test_large_samples_are_a_filter(skewed, monkeypatch, n, bin_rows):
    monkeypatch.setattr(ranking, "_BIN_ROWS", bin_rows)
    expected = {r["v"] for r in skewed.orderBy(hash_order(F.col("v"), 42), "v").limit(n).collect()}
    sample = hash_sample(skewed, n, "v")
    assert {r["v"] for r in sample.collect()} == expected and sample.count() == min(n, 3000)
    assert "TakeOrdered" not in plan(sample) and "Limit" not in plan(sample) and "NestedLoop" not in plan(sample)


@pytest.mark.parametrize("bin_rows", [10_000, 1])
def test_smallest_with_ties_nulls_and_repeated_rows(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(ranking, "_BIN_ROWS", bin_rows)
    monkeypatch.setattr(ranking, "TOP_ROWS", 0)
    rows = [(k, t) for k in (None, -(10**15), 0, 5, 5, 10**15) for t in ("a", "b", "b", None)]
    table = spark.createDataFrame(rows, "k long, t string").repartition(4)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    for n in range(1, len(rows) + 2):
        got = sorted((tuple(r) for r in smallest(table, n, F.col("k"), [F.col("t")]).collect()), key=key)
        assert got == sorted(rows, key=key)[:n], n
    assert smallest(table.filter("false"), 5, F.col("k"), [F.col("t")]).count() == 0
