"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from replyloom.llm import op13_merkle as op13
from replyloom.session import stash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, digest string, root int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """The root and each node's siblings by level: (left, right)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, k in enumerate(at):
            a = k // 16 * 16
            paths[i].append((level[a:k], level[k + 1 : a + 16]))
            at[i] = k // 16
        level = [h(*level[a : a + 16]) for a in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    order = {}
    for r in rows:
        order.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(order, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        order[s].sort(key=lambda x: x[:3])
        trees[s] = climb([x[2] for x in order[s]])
    root, over = climb([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, over, strict=True):
        for (_, _, own, r), path in zip(order[s], trees[s][1], strict=True):
            whole = [*path, *top]
            now = leaf(r, lowered(r[1])) if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0 else own
            for left, right in whole:
                now = h(*left, now, *right)
            out.append((r[0], own, trees[s][0], root, h(*[d for left, right in whole for d in (*left, *right)]), now, now == root))
    return sorted(out, key=str)


def run(spark, rows, step):
    docs = spark.createDataFrame([(*r, "t", 1, "d", 2) for r in rows], DOCS)
    fields = [docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"]]
    changed = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    shown = F.when(op13.crc(F.col("doc_id")) % 5 == 0, F.unhex(op13.leaf_hash(*fields, changed)))
    got = op13.manifest(docs.select("doc_id", "source", F.unhex(op13.leaf_hash(*fields, docs["text"])).alias("digest"), shown.alias("presented")), step)
    return sorted((tuple(r) for r in got.collect()), key=str)


ODD = [
    (1, None, "en", "a", None), (2, "", None, "a", 0), (None, "No Id", "en", "a", 5), (None, "No Id", "en", "a", 5), (3, "Tie", "en", "a", 3), (3, "tie", "en", "a", 3),
    (4, "alone", "en", "b", 5), (5, "No Source", "en", None, 9), (6, "Empty source", "en", "", 12), (7, "É" * 100_000 + "X", "fr", "é", 100_001), (8, "Same", "en", "a", 4), (8, "Same", "en", "a", 4),
]


@pytest.mark.parametrize("step", [1, 3])
def test_manifest_equals_plain_tree(spark, step):
    rows = ODD + [(100 + d, f"Text {d}", "en", "hot" if d % 3 else f"s{d}", d) for d in range(420)]
    assert run(spark, rows, step) == brute(rows)


def test_one_source_one_row_and_none(spark):
    rows = [(d, f"A {d}", "en", "only", 1) for d in range(17)]
    assert run(spark, rows, 1) == brute(rows)
    assert run(spark, rows[:1], 3) == brute(rows[:1])
    assert run(spark, [], 3) == []


def test_other_order_of_rows_gives_the_same_root(spark):
    rows = ODD + [(d, f"t{d}", "en", "s", d) for d in range(60)]
    assert {r[3] for r in run(spark, rows, 3)} == {r[3] for r in run(spark, rows[::-1], 3)}


def test_frontier_is_the_tree_at_every_size():
    for n in (1, 2, 15, 16, 17, 256, 257, 300):
        nodes = [h(str(k)) for k in range(n)]
        frontier = op13.Frontier(op13._height(n), witnesses=True)
        for d in nodes:
            frontier.append(d)
        root, paths = climb(nodes)
        assert frontier.close() == root
        assert all(op13.folded(d, w) == root for d, w in zip(nodes, frontier.witness, strict=True))
        assert [[("".join(a), "".join(b)) for a, b in p] for p in paths] == frontier.witness


def test_written_tables_hold_digests_not_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(op13, "stash", lambda df, name: seen.append(df.columns) or stash(df, name))
    run(spark, [(d, "t", "en", "s", 1) for d in range(40)], 1)
    assert seen and not any("text" in columns for columns in seen)
