"""Periodic runs on a grammar against a search of all periods."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from replyloom.llm import op11_runs as op11

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """(start, length, period) of all runs."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e > s and e + q - s >= max(6, 4 * q):
                out.setdefault((s, e + q - s), q)
            s = max(e, s) + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def found(texts):
    ids = {}
    flat = [ids.setdefault(x, len(ids)) for t in texts for x in t]
    offsets = np.cumsum([0, *map(len, texts)])
    got = op11.find_runs(np.array(flat, np.int64), offsets)
    at = np.searchsorted(got[:, 1], offsets)
    return [[(int(s - offsets[k]), int(e - s), int(p)) for p, s, e in got[at[k] : at[k + 1]]] for k in range(len(texts))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text("ab", max_size=60), st.text("abcd", max_size=40)), max_size=6))
def test_runs_equal_brute_force(texts):
    assert found(texts) == [brute(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("abc", min_size=1, max_size=7), st.integers(1, 9)), max_size=5), max_size=4))
def test_runs_of_repeated_pieces_equal_brute_force(texts):
    whole = ["".join(piece * n for piece, n in t) for t in texts]
    assert found(whole) == [brute(t) for t in whole]


def test_structured_and_long_texts():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 3000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    rng = random.Random(3)
    prose = [str(rng.randrange(500)) for _ in range(5000)]
    nested = ["x", "y"] * 40 + ["z"]
    texts = [fibonacci[-1], thue, prose, prose[:700] * 5 + prose[700:900], nested * 30, "a" * 5000, "ab" * 3000 + "a"]
    short = [t[:1500] for t in texts]
    assert found(short) == [brute(t) for t in short]
    assert found(texts)[5:] == [[(0, 5000, 1)], [(0, 6001, 2)]]
    assert found(texts)[3] == [(0, 3500, 700)] or brute(texts[3]) == found(texts)[3]


def test_steps_of_one_comparison_find_the_same(monkeypatch):
    monkeypatch.setattr(op11, "STEP_PAIRS", 1)
    text = "abcabcabcabcabxyxyxyxyxyxx" * 5
    assert found([text]) == [brute(text)]


def test_a_grammar_derives_its_text():
    rng = np.random.default_rng(1)
    words, texts = rng.integers(0, 4, 400), np.array([0, 150, 150, 151, 400])
    grammar = op11.Grammar(words, texts)
    rules = np.concatenate(grammar.rules)
    for rule, place in zip(*(np.concatenate(x) for x in zip(*grammar.places, strict=True)), strict=True):
        left, boundary, right = rules[rule]
        assert left < boundary < right and (words[left:right] == words[place : place + right - left]).all()
        assert np.searchsorted(texts, place, side="right") == np.searchsorted(texts, place + right - left - 1, side="right")
    assert len(grammar.symbol) == 3  # one symbol for each text with words


DOCS = "doc_id long, text string, lang string, n_words long, runs int, collapsed string, best int, start long"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "no id " * 9), (4, "x " * 3000), (5, "ab  ab\tab\nab ab ab ab"), (5, "ab  ab\tab\nab ab ab ab"), (6, "a b"), (7, "no break é é é é é é é"), (8, "w " * 20_000 + "end")]


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = ODD + [(100 + d, " ".join(str(rng.randrange(6)) for _ in range(rng.randrange(120)))) for d in range(150)]
    rows += [(400 + d, " ".join([f"p{d}", "q", "r"][: 1 + d % 3] * (3 + d % 5) + [t])) for d, t in enumerate(["tail", "p q"] * 20)]
    docs = spark.createDataFrame([(d, t, "en", 1, 2, "c", 3, 4) for d, t in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        w = planted(d, t)
        runs = brute(w) if len(w) < 10_000 else [(0, 20_000, 1)] if w[:20_000] == ["w"] * 20_000 else None
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((d, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(kept(w, runs)).encode()).hexdigest()))
    got = op11.op11_grammar_runs(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 20


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "one")]])
def test_tables_without_pairs(spark, rows):
    got = op11.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.runs, r.collapsed) for r in got] == [(d, [], t or "") for d, t in rows]


def test_exponents_are_floored_exactly():
    assert math.floor(1000 * 7 / 3) == 2333 and brute("abcabcabcabca") == [(0, 13, 3)]
