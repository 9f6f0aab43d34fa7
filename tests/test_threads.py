import random

import pytest
from pyspark.sql import functions as F

from replyloom.operators import closure, threads
from replyloom.operators.pairs import support_pairs
from replyloom.plans.explore import explore
from replyloom.plans.prepare import prepare, run_report, stage_status
from tests.conftest import as_dict


def walk(rows):
    """Depth-first order written plainly: {id: (root, turn)}."""
    parent = {r[0]: r[2] for r in rows}
    when = {r[0]: (r[5] is None, r[5] or 0, i) for i, r in enumerate(rows)}
    kids = {}
    for tid, p in parent.items():
        if p in parent and p != tid:
            kids.setdefault(p, []).append(tid)
    out = {}
    for root in parent:
        if parent[root] and parent[root] in parent:
            continue
        stack, turn = [root], 0
        while stack:
            tid = stack.pop()
            turn += 1
            out[tid] = (root, turn)
            stack.extend(sorted(kids.get(tid, []), key=when.get, reverse=True))
    return out


def random_forest(seed, n=220):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        if i == 0 or kind < 0.06:
            parent = ""
        elif kind < 0.09:
            parent = f"gone{i}"
        elif kind < 0.45:
            parent = f"m{i - 1}"  # long chains
        elif kind < 0.75:
            parent = "m0"  # one message holds a third of all replies
        else:
            parent = f"m{rng.randrange(i)}"
        rows.append([f"m{i}", rng.choice(["agent", "1", "2"]), parent, "", "hello", rng.choice([None, 1, 2, 3, 4])])
    rows[50][2] = rows[50][0]  # its own parent
    rows[60][2], rows[61][2] = "m61", "m60"  # two that answer each other
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reading_order_is_depth_first(messages, seed):
    rows = random_forest(seed)
    expected = walk(rows)
    table = messages(rows)
    out = threads.reconstruct_threads(table)
    found = {r["tweet_id"]: (r["conversation_id"], r["turn"]) for r in out.collect()}
    assert found == expected
    stats = as_dict(threads.reconstruction_stats(table, out))
    assert stats["tweets_in"] == len(rows)
    assert stats["tweets_in_conversations"] + stats["cyclic_tweets_skipped"] == len(rows)
    assert stats["cyclic_tweets_skipped"] >= 3
    assert stats["conversations"] == len({root for root, _ in expected.values()})
    sizes = threads.conversation_totals(out).agg(F.sum("tweets")).first()[0]
    assert sizes == len(expected)


def test_giant_conversation_has_one_row(spark):
    out = spark.range(5000).selectExpr("'m0' conversation_id", "id + 1 turn", "concat('m', id) tweet_id", "id % 2 = 0 inbound", "'t' created_at")
    row = threads.conversations_summary(out).collect()
    assert len(row) == 1 and row[0]["tweets"] == 5000 and row[0]["tweet_ids"] == [f"m{i}" for i in range(5000)]
    again = threads.explode_threads(threads.conversations_summary(out))
    assert again.exceptAll(threads.conversation_ids(out)).isEmpty() and again.count() == 5000


def test_siblings(messages):
    table = messages(
        [("p", "1", "", "", "q", 0), ("c", "agent", "p", "", "x", None), ("b", "agent", "p", "", "x", 5),
         ("a", "agent", "p", "", "x", 5), ("z", "agent", "p", "", "x", 2)]
    )
    out = {r["id"]: r["rank"] for r in threads.sibling_rank(table).collect()}
    assert out == {"z": 1, "b": 2, "a": 3, "c": 4}


def test_links(messages):
    table = messages(
        [("1", "1", "", "2,9", "q", 0), ("2", "agent", "1", "3", "a", 1), ("3", "2", "1", "", "b", 2), ("4", "2", "8", "", "c", 3)]
    )
    assert as_dict(threads.link_diagnostics(table)) == {"dangling_child_links": 1, "parent_link_mismatches": 1}
    assert {r["tweet_id"] for r in closure.dangling_refs(table).collect()} == {"9", "8"}
    roots = {r["tweet_id"]: r["partial"] for r in threads.thread_roots(table).collect()}
    assert roots == {"1": False, "4": True}


def test_pairs(messages):
    rows = [
        ("q", "1", "", "", "question", 0), ("r1", "agent", "q", "", "one", 1), ("r2", "agent", "q", "", "two", 2),
        ("s", "agent", "r1", "", "to itself", 3), ("o", "agent", "gone", "", "orphan", 4), ("x", "other", "q", "", "x", 5),
    ]
    pairs = support_pairs(threads.reconstruct_threads(messages(rows)), "agent")
    assert {(r["customer_tweet_id"], r["response_tweet_id"], r["tweet_ids"]) for r in pairs.collect()} == {
        ("q", "r1", "q;r1"), ("q", "r2", "q;r2")
    }


def reach(rows, author, both=False):
    ids = {r[0] for r in rows}
    out = {}
    for r in rows:
        for other in [r[2], *r[3].split(",")]:
            if other in ids:
                out.setdefault(r[0], set()).add(other)
                if both:
                    out.setdefault(other, set()).add(r[0])
    seen = {r[0] for r in rows if r[1] == author}
    todo = list(seen)
    while todo:
        for other in out.get(todo.pop(), ()):
            if other not in seen:
                seen.add(other)
                todo.append(other)
    return seen


@pytest.mark.parametrize("seed", [4, 5])
@pytest.mark.parametrize("mode", ["directed", "component"])
def test_closure(messages, seed, mode):
    rng = random.Random(seed)
    rows = [list(r) for r in random_forest(seed, 150)]
    kids = {}
    for r in rows:
        if rng.random() < 0.7:
            kids.setdefault(r[2], []).append(r[0])
    for r in rows:
        extra = [f"m{rng.randrange(150)}"] if rng.random() < 0.05 else []
        r[3] = ",".join(kids.get(r[0], []) + extra)
        r[1] = "agent" if rng.random() < 0.03 else "1"
    expected = reach(rows, "agent", both=mode == "component")
    table = messages([tuple(r) for r in rows])
    found = [r["tweet_id"] for r in closure.thread_closure(table.repartition(5), "agent", mode).collect()]
    assert sorted(found) == sorted(expected)


def test_closure_directions(messages):
    rows = [("a", "agent", "", "", "x", 0), ("b", "1", "a", "", "unlisted reply", 1), ("c", "1", "", "", "listed", 2)]
    rows.append(("d", "agent", "", "c", "x", 3))
    table = messages(rows)
    ids = lambda mode: {r["tweet_id"] for r in closure.thread_closure(table, "agent", mode).collect()}
    assert ids("directed") == {"a", "c", "d"}
    assert ids("component") == {"a", "b", "c", "d"}


def test_closure_budget(messages):
    rows = [(f"m{i}", "agent" if i == 5 else "1", f"m{i - 1}" if i else "", "", "x", i) for i in range(6)]
    table = messages(rows)
    out = closure.thread_closure_bounded(table, "agent", 2).collect()
    assert {(r["tweet_id"], r["round"], r["converged"]) for r in out} == {("m5", 0, False), ("m4", 1, False), ("m3", 2, False)}
    assert {r["converged"] for r in closure.thread_closure_bounded(table, "agent", 5).collect()} == {True}


def test_whole_preparation(messages):
    table = messages(
        [
            ("1", "7", "", "2", "@Brand my phone", 0),
            ("2", "agent", "1", "3", "@7 hello", 1),
            ("3", "7", "2", "4", "@agent ", 2),  # emptied, so 4 becomes a partial root
            ("4", "agent", "3", "", "@7 still there?", 3),
            ("5", "8", "", "", "@Other lonely", 4),
        ]
    )
    run = prepare(table, "agent")
    assert run.collected.count() == 4
    report = {(r["section"], r["name"]): r["value"] for r in run_report(run).collect()}
    assert report["rebuild", "partial_roots"] == 1
    assert report["cleaning", "dropped_empty_text"] == 1
    assert report["outputs", "messages"] == 3
    assert report["outputs", "conversations"] == 2
    assert report["outputs", "pairs"] == 1
    assert run.checks.filter("NOT passed").isEmpty() and run.checks.count() == 7
    assert {r["status"] for r in stage_status(run_report(run)).collect()} == {"OK"}
    tables = explore(run)
    assert {r["name"]: r["value"] for r in tables["summary"].collect()}["date_start"] == "Tue Oct 31 21:00:00 +0000 2017"
    assert {r["bucket"]: r["count"] for r in tables["message_length_histogram"].collect()}["1-25"] == 3
    assert [r["count"] for r in tables["funnel"].orderBy("step").collect()] == [5, 2, 3, 2, 1]
    for name, table in tables.items():
        assert table.count() >= (0 if name.startswith(("top", "topic_pairs")) else 1), name


def test_steps_at_hand_are_followed_without_rounds(spark, messages, monkeypatch):
    rounds = []
    append = threads.RoundTable.append
    monkeypatch.setattr(threads.RoundTable, "append", lambda self, df, k, **counters: rounds.append(k) or append(self, df, k, **counters))
    rows = [(f"m{i}", "agent", f"m{i - 1}" if i else "", "", "hello", 1) for i in range(400)]
    got = {(r["id"], r["root"], r["turn"]) for r in threads.reading_order(threads.reply_nodes(messages(rows).coalesce(1))).collect()}
    assert got == {(f"m{i}", "m0", i + 1) for i in range(400)}
    assert max(rounds) <= 1  # a range's border at most; doubling alone takes ten


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_shortened_pointers_lead_to_the_same_ends(monkeypatch, chunk):
    monkeypatch.setattr(threads, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(f"s{i}", f"s{rng.randrange(i)}" if i and rng.random() < 0.95 else None, rng.randrange(3)) for i in range(300)]
    rows += [("twice", "s5", 1), ("twice", "s9", 1), ("a", "twice", 1), ("b", "a", 1), ("gone", "nowhere", 1), (None, "s3", 1)]
    rows += [("r0", "r2", 1), ("r1", "r0", 1), ("r2", "r1", 1), ("below", "r1", 1)]
    count = {s: sum(r[0] == s for r in rows) for s, *_ in rows}
    rng.shuffle(rows)
    root = lambda s, b: s if b is None else None
    names = ["step", "back", "entries", "root", "lone"]
    table = [dict(zip(names, (s, b, n, root(s, b), count[s] == 1))) for s, b, n in rows]
    schema = threads.pa.schema([("step", threads.pa.string()), ("back", threads.pa.string()), ("entries", threads.pa.int64()), ("root", threads.pa.string()), ("lone", threads.pa.bool_())])
    batches = [threads.pa.RecordBatch.from_pylist(table[k : k + 5], schema) for k in range(0, len(table), 5)]
    out = [r for b in threads._follow_here(iter(batches)) for r in b.to_pylist()]

    def ends(of):
        by = {}
        for r in of:
            by.setdefault(r["step"], []).append(r)

        def walk(r, depth=0):
            if r["back"] is None:
                return [(r["entries"], r["root"])]
            return [] if depth > 400 else [(r["entries"] + n, e) for x in by.get(r["back"], []) for n, e in walk(x, depth + 1)]

        return sorted(((str(r["step"]), *e) for r in of for e in walk(r)), key=str)

    assert len(out) == len(table) and ends(out) == ends(table)
