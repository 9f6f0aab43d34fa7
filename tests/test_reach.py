"""Reachability by jumps against a plain search, and the rounds it takes."""

import random

import pytest

from replyloom.operators import closure
from replyloom.operators.reach import Jumps, reachable
from tests.test_threads import reach

LINK = "src string, dst string"


def plain(seeds, links):
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
    seen, todo = set(seeds), list(seeds)
    while todo:
        for b in out.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def jobs(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    out = run()
    count = len(sc.statusTracker().getJobIdsForGroup(name))
    sc.setJobGroup("other", "other")
    return out, count


@pytest.mark.parametrize("seed", range(3))
def test_reachable_in_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 200
    name = lambda k: f"n{k}"
    ups = [(name(k), name(rng.randrange(n))) for k in range(n) if rng.random() < 0.6]
    ups += [(name(rng.randrange(n)), name(rng.randrange(n))) for _ in range(6)]  # second parents, rings, self-links
    downs = [(name(rng.randrange(n)), name(k)) for k in range(n) if rng.random() < 0.3]
    rest = [(name(rng.randrange(n)), name(rng.randrange(n))) for _ in range(4)]
    seeds = [(name(rng.randrange(n)),) for _ in range(2)]
    frames = [spark.createDataFrame(links, LINK).repartition(3) for links in (ups, downs, rest)]
    got = [r["id"] for r in reachable(spark.createDataFrame(seeds, "id string"), *frames).collect()]
    assert sorted(got) == sorted(plain([s for (s,) in seeds], ups + downs + rest))


def test_rings_and_empty_tables(spark):
    ring = [(f"r{k}", f"r{(k + 1) % 7}") for k in range(7)] + [("tail", "r0")]
    none, links = spark.createDataFrame([], LINK), spark.createDataFrame(ring, LINK)
    ids = lambda seeds, *links: sorted(r["id"] for r in reachable(spark.createDataFrame(seeds, "id string"), *links).collect())
    assert ids([("r3",)], links, none, none) == [f"r{k}" for k in range(7)]
    assert ids([("r3",)], none, links, none) == [f"r{k}" for k in range(7)]
    assert ids([("tail",)], none, links, none) == [f"r{k}" for k in range(7)] + ["tail"]
    assert ids([], links, links, links) == [] and ids([("x",)], none, none, none) == ["x"]


def test_a_jump_table_has_a_round_per_binary_digit(spark):
    chain = spark.range(1, 1001).selectExpr("cast(id as string) as id", "cast(id - 1 as string) as to")
    tables = Jumps(chain)
    assert tables.rounds == 10 and tables.at(9).count() == 1000 - 2**9 + 1


CHAIN = 2000


@pytest.mark.parametrize("listed", [False, True], ids=["parents-only", "lists-only"])
def test_a_deep_one_way_chain_takes_few_jobs(spark, messages, listed):
    rows = [(f"m{k}", "agent" if k == (0 if listed else CHAIN - 1) else "1", "" if listed or not k else f"m{k - 1}", f"m{k + 1}" if listed and k < CHAIN - 1 else "", "x", 0) for k in range(CHAIN)]
    table = messages(rows)
    found, count = jobs(spark, f"chain-{listed}", lambda: closure.thread_closure(table, "agent").count())
    assert found == CHAIN and count < 200, count
    _, count = jobs(spark, f"chain-both-{listed}", lambda: closure.thread_closure(table, "agent", "component").count())
    assert count < 200


@pytest.mark.parametrize("mode", ["directed", "component"])
@pytest.mark.parametrize("kind", ["parents", "lists", "neither"])
def test_closure_of_tables_without_lists_or_parents(messages, mode, kind):
    rng = random.Random(4)
    rows = []
    for k in range(120):
        parent = f"m{rng.randrange(k)}" if k and rng.random() < 0.9 else ""
        rows.append([f"m{k}", "agent" if rng.random() < 0.04 else "1", parent, "", "x", k % 60])
    if kind != "parents":
        for r in rows:
            r[3] = ",".join(c[0] for c in rows if c[2] == r[0]) if kind == "lists" else ""
        for r in rows:
            r[2] = ""
    expected = reach(rows, "agent", both=mode == "component")
    found = [r["tweet_id"] for r in closure.thread_closure(messages([tuple(r) for r in rows]), "agent", mode).collect()]
    assert sorted(found) == sorted(expected)


def test_no_groups_are_sought_where_no_link_is_declared_by_both_ends(spark, monkeypatch):
    monkeypatch.setattr(closure, "forest_roots", None)
    rows = [("1", "a", "", [], 1), ("2", "b", "1", [], 2), ("3", "a", "2", [], 3), ("4", "c", "", [], 4), ("5", "c", "4", [], 5)]
    messages = spark.createDataFrame(rows, "tweet_id string, author_id string, in_response_to_tweet_id string, response_ids array<string>, file_pos long")
    assert sorted(r.tweet_id for r in closure.reachable_ids(messages, "a").collect()) == ["1", "2", "3"]
