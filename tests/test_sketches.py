"""Sketches against exact answers, and phrases against patterns."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from replyloom.functions.text import topic_hits
from replyloom.operators import sketches
from replyloom.operators.phrases import phrase_matches, phrase_table

WORDS = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "lmnrst"]


def rows(seed, n=900):
    rng = random.Random(seed)
    return [(f"i{rng.randrange(20_000)}", " ".join(rng.choice(WORDS[: 20 + 200 * (rng.random() < 0.2)]) for _ in range(rng.randint(1, 30)))) for _ in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id string, text string")


def test_answers_lie_in_their_bounds(spark, tmp_path):
    store, data = sketches.SketchStore(spark, str(tmp_path / "store")), []
    for part in range(3):
        data += (own := rows(part))
        store.add(f"p{part}", frame(spark, own), "id", terms=60, stopwords=[])
    got = store.totals().first()
    exact = len({i for i, _ in data})
    assert got["rows"] == len(data) and abs(got["distinct_ids"] - exact) <= sketches.IDS_ERROR * exact
    lengths = np.sort([len(t) for _, t in data])
    for r in store.quantiles([0.01, 0.25, 0.5, 0.9, 0.99]).collect():
        low, high = np.searchsorted(lengths, r["value"], "left") / len(lengths), np.searchsorted(lengths, r["value"], "right") / len(lengths)
        assert low - sketches.RANK_ERROR <= r["q"] <= high + sketches.RANK_ERROR
    counts = collections.Counter(w for _, t in data for w in t.split())
    ranges = {r["term"]: (r["low"], r["high"]) for r in store.top_terms(20, terms=60).collect()}
    assert len(ranges) == 20 and all(a <= counts[w] <= b for w, (a, b) in ranges.items())
    assert {w for w, _ in counts.most_common(10)} <= set(ranges)


def test_a_new_part_reads_its_own_rows_only(spark, tmp_path):
    """The rows of the first part are gone when the second is added and the answers are asked."""
    store = sketches.SketchStore(spark, str(tmp_path / "store"))
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    frame(spark, rows(1, 200)).write.parquet(one)
    store.add("one", spark.read.parquet(one), "id")
    frame(spark, [("x", "only this")]).write.mode("overwrite").parquet(one)
    frame(spark, rows(2, 300)).write.parquet(two)
    store.add("two", spark.read.parquet(two), "id")
    assert store.totals().first()["rows"] == 500
    store.add("two", spark.read.parquet(two).limit(100), "id")  # again: replaced, not counted twice
    assert store.totals().first()["rows"] == 300


def test_terms_that_fit_are_exact(spark, tmp_path):
    store = sketches.SketchStore(spark, str(tmp_path / "store"))
    store.add("a", frame(spark, [("1", "apple pear apple"), ("2", "fig")]), "id", stopwords=[])
    store.add("b", frame(spark, [("3", "apple fig")]), "id", stopwords=[])
    assert [tuple(r) for r in store.top_terms(5).collect()] == [("apple", 3, 3), ("fig", 2, 2), ("pear", 1, 1)]


TOPICS = (("A", "x", ("sign in", "won't", "app", "co-op shop")), ("B", "y", ("ios 11.1", "é", "a b c")), ("C", "z", ("app", "shop co")))
TEXTS = ["please sign in now", "sign  in", "it won't go", "won t", "app", "apple app", "_app app_", "the co-op shop", "co-op  shop", "ios 11.1", "ios 11.12", "é", "éa", "a b c", "xa b c", "a b cd",
         "", None, "...", "app, sign in; won't!", "shop co-op shop co", "App SIGN IN"]


@pytest.mark.parametrize("case_sensitive", [True, False])
def test_phrases_equal_patterns(spark, case_sensitive):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id int, text string")
    got = phrase_matches(texts, phrase_table(spark, TOPICS), "id", case_sensitive=case_sensitive)
    want = texts.select("id", F.explode(topic_hits(F.col("text"), TOPICS, case_sensitive)).alias("topic"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ten_thousand_phrases_without_a_pattern(spark):
    table = spark.range(10_000).selectExpr("concat('topic', id % 50) as topic", "concat('word', id, ' next', id) as phrase")
    texts = spark.range(300).selectExpr("id", "concat('some word', id * 7, ' next', id * 7, ' and word1 next2') as text")
    got = phrase_matches(texts, table, "id")
    assert {r["id"]: r["topic"] for r in got.collect()} == {k: f"topic{k * 7 % 50}" for k in range(300)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan.upper() and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_phrases_that_cannot_be_joined_are_refused(spark):
    texts = spark.createDataFrame([(1, "x")], "id int, text string")
    for phrase in ("#tag", "end!", " ".join("abcdefghijklm")):
        with pytest.raises(ValueError, match="phrase"):
            phrase_matches(texts, spark.createDataFrame([("t", phrase)], "topic string, phrase string"), "id")
    assert phrase_matches(texts, spark.createDataFrame([], "topic string, phrase string"), "id").count() == 0
