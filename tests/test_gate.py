"""The structural checks: one read of each table, and each fault caught."""

import pytest
from pyspark.sql import functions as F

from replyloom.operators import quality, threads
from replyloom.operators.pairs import support_pairs
from replyloom.session import stash

ROWS = [
    ("1", "7", "", "2", "question", 0), ("2", "agent", "1", "3", "answer", 1), ("3", "7", "2", "4", "more", 2), ("4", "agent", "3", "", "done", 3),
    ("5", "8", "", "6", "other", 0), ("6", "agent", "5", "", "reply", 1),
]


@pytest.fixture
def tables(messages):
    rebuilt = stash(threads.reconstruct_threads(messages(ROWS)), "gate-threads")
    return rebuilt, threads.conversation_totals(rebuilt), support_pairs(rebuilt, "agent")


def violations(*tables):
    return {r["name"]: r["violations"] for r in quality.quality_gate(*tables, "agent").collect() if r["violations"]}


def test_sound_tables_pass(tables):
    checks = quality.quality_gate(*tables, "agent").collect()
    assert len(checks) == 7 and all(r["passed"] and r["violations"] == 0 for r in checks)


def test_empty_tables_pass(tables):
    none = [t.filter("false") for t in tables]
    assert all(r["passed"] for r in quality.quality_gate(*none, "agent").collect())


@pytest.mark.parametrize(
    "fault, expected",
    [
        (lambda t, c, p: (t.filter("tweet_id <> '3'"), c, p), {"pair_ids_exist_in_tweets": 1}),
        (lambda t, c, p: (t.filter("tweet_id <> '4'"), c, p), {"pair_ids_exist_in_tweets": 1, "pair_responses_by_support_author": 1}),
        (lambda t, c, p: (t, c, p.withColumn("customer_tweet_id", F.lit(None).cast("string"))), {"pair_ids_exist_in_tweets": 3}),
        (lambda t, c, p: (t.unionByName(t.withColumn("tweet_id", F.lit(None).cast("string"))), c, p.withColumn("customer_tweet_id", F.lit(None).cast("string"))), {"pair_ids_exist_in_tweets": 3}),
        (lambda t, c, p: (t, c.filter("conversation_id <> '1'"), p), {"pair_conversations_exist": 2}),
        (lambda t, c, p: (t, c, p.withColumn("customer_message", F.lit(""))), {"pair_messages_non_empty": 3}),
        (lambda t, c, p: (t, c, p.unionByName(p.filter("turn = 4"))), {"pair_response_ids_unique": 1}),
        (lambda t, c, p: (t.withColumn("author_id", F.when(F.col("tweet_id") == "6", "x").otherwise(F.col("author_id"))), c, p), {"pair_responses_by_support_author": 1}),
        (lambda t, c, p: (t, c.unionByName(c).unionByName(c), p), {"conversation_ids_unique": 2}),
        (lambda t, c, p: (t.withColumn("conversation_id", F.when(F.col("turn") > 1, F.when(F.col("turn") == 2, ""))), c, p), {"tweets_have_conversation_id": 6}),
    ],
    ids=["question-gone", "reply-gone", "null-reference", "null-id-matches-none", "conversation-gone", "empty-text", "reply-twice", "other-author", "conversation-twice", "no-conversation"],
)
def test_each_fault_is_caught(tables, fault, expected):
    assert violations(*fault(*tables)) == expected


def test_gate_reads_each_table_once(tables):
    plan = quality.quality_gate(*tables, "agent")._jdf.queryExecution().optimizedPlan().toString()
    # threads, conversations (made from threads) and the two sides of the join that makes pairs
    assert 0 < plan.count("Relation [") + plan.count("RelationV2") <= 4, plan
    assert "CartesianProduct" not in plan
