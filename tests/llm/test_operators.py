"""Training-data operators against brute force, and the defined results of odd inputs."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry_module
from replyloom.llm import op1_decontaminate as op1
from replyloom.llm import op2_lines as op2
from replyloom.llm import op3_toxicity as op3
from replyloom.llm import op4_chosen_path as op4
from replyloom.llm import op5_suffix as op5
from replyloom.llm import op6_hmm as op6
from replyloom.llm import op7_chat as op7
from replyloom.llm import op8_mixing as op8
from replyloom.llm import op9_itq as op9
from replyloom.llm import op10_pii as op10
from replyloom.llm import registry
from workloads.harness import compare, connect

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, print string, key int, node double, score string"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with the columns of the table and others whose names the operators use inside."""

    def build(rows):
        full = [(d, t, "en", f"s{(d or 0) % 2}", None if t is None else len(t), "x", 1, 2.0, "y") for d, t in rows]
        return spark.createDataFrame(full, DOCS)

    return build


def prose(seed, n, words=60):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return [" ".join(rng.choice(lexicon) for _ in range(rng.randint(1, words))) for _ in range(n)]


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here at all"), (4, "x" * 3000), (5, "same words in both rows"), (5, "same words in both rows")]


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry.Q.items() if sql])
def test_query_matches_sql(spark, name):
    same, message = compare(registry.Q[name][0](spark, SF), connect(SF), registry.Q[name][1])
    assert same, message


def test_queries_are_registered():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in entry_module.queries() if re.match(r"op\d+_", n)]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in entry_module.queries()


# 1 ---------------------------------------------------------------------------------------------------------------
def free_ends_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        now = [i + 1]
        for j, d in enumerate(text):
            now.append(min(before[j] + (c != d), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=80), st.text("abc ", max_size=120))
def test_matcher_equals_full_table(item, text):
    item, text = op1.normal(item), op1.normal(text)
    if item:
        least = free_ends_distance(item, text)
        assert op1.myers(op1.pattern_bits(item), len(item), text)[0] == least
        assert bool(op1.Matcher([(1, item)]).find(text)) == (least <= len(item) // op1.CHARS_PER_EDIT)


def test_leaks_are_found_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(op1, "BLOCK_CHARS", 150)
    items = prose(1, 6, 30)
    items = [x + " and a tail long enough to allow edits" for x in items]
    bench = spark.createDataFrame([(k, t, "z") for k, t in enumerate(items)] + [(90, None, "z"), (91, "", "z"), (92, "!?", "z")], "item_id long, text string, print string")
    body = prose(2, 8)
    rows = ODD + [(10, body[0] + " " + items[0].upper() + ", " + body[1]), (11, body[2] + items[1][:20] + "q" + items[1][21:]), (12, body[3]), (13, items[2][: len(items[2]) // 2])]
    found = {(r.doc_id, r.item_id): r.edits for r in op1.contaminated(docs(rows), bench).collect()}
    expected = {}
    for d, t in rows:
        for k, item in enumerate(items):
            least = free_ends_distance(op1.normal(item), op1.normal(t))
            if least <= len(op1.normal(item)) // op1.CHARS_PER_EDIT:
                expected[d, k] = least
    assert found == expected and {(10, 0), (11, 1)} <= set(found)
    kept = [r.doc_id for r in op1.drop_contaminated(docs(rows), bench).collect()]
    assert sorted(map(str, kept)) == sorted(str(d) for d, _ in rows if d not in (10, 11))
    assert op1.contaminated(docs([]), bench).count() == 0 and op1.contaminated(docs(rows), bench.limit(0)).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------
def distance(a, b):
    before = list(range(len(b) + 1))
    for i, c in enumerate(a):
        now = [i + 1]
        for j, d in enumerate(b):
            now.append(min(before[j] + (c != d), before[j + 1] + 1, now[j] + 1))
        before = now
    return before[-1]


def brute_lines(rows):
    first, n = {}, collections.Counter()
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                n[line] += 1
                first.setdefault(line, (d, k))
    root = {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, order = collections.Counter(), lambda x: (first[x][0] is not None, first[x][0] or 0, first[x][1])
    for a, b in itertools.combinations(first, 2):
        if min(len(a), len(b)) >= op2.LEAST_CHARS and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)), key=order)
            root[high] = low
    return {first[x]: (n[x], links[x], first[find(x)], find(x) == x) for x in first}


def line_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd e") for _ in range(rng.randint(20, 50))) for _ in range(15)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(3):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(x))
                x[k] = rng.choice(["", "x", "é", x[k] + "y"])
            lines.append("".join(x))
        rows.append((100 + d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("crowded", [512, 2])
def test_lines_equal_brute_force(docs, monkeypatch, crowded):
    monkeypatch.setattr(op2, "CROWDED", crowded)
    rows = line_rows(3) + ODD
    got = {(r.doc_id, r.line_no): (r.n_copies, r.n_links, (r.class_doc_id, r.class_line_no), r.kept) for r in op2.dedup_lines(docs(rows)).collect()}
    assert got == brute_lines(rows)


def test_lines_are_removed(docs):
    rows = line_rows(4) + ODD
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in op2.remove_repeated_lines(docs(rows)).collect()), key=str)
    classes, text_of = brute_lines(rows), []
    keep = {at for at, (_, _, of, kept) in classes.items() if kept}
    for d, t in rows:
        if t is None:
            text_of.append((d, None, None))
            continue
        lines = [x for k, x in enumerate(t.split("\n")) if not WORD.search(x) or (d, k) in keep]
        if len(lines) == t.count("\n") + 1 or any(WORD.search(x) for x in lines):
            text_of.append((d, "\n".join(lines), len("\n".join(lines))))
    assert got == sorted(text_of, key=str)
    assert op2.remove_repeated_lines(docs([])).count() == 0


def test_rows_that_share_an_id_lose_their_own_lines(docs):
    rows = [
        (None, "nameless one\nfirst own line\nthe common line"), (None, "nameless two\nsecond own line\nthe common line"),
        (None, "nameless three\nthe common line\nthird own line"), (None, "whole copy\nof two lines"), (None, "whole copy\nof two lines"),
        (8, "shared start\nseen before\neight a"), (8, "shared start\nunique here\neight b"), (3, "seen before"),
    ]
    got = list(op2.remove_repeated_lines(docs(rows)).collect())
    left = collections.Counter(line for r in got for line in r.text.split("\n"))
    assert left == collections.Counter({line for _, t in rows for line in t.split("\n")})
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(rows) - 1
    assert [r.text for r in got if r.doc_id == 3] == ["seen before"]


def test_lines_that_only_share_a_segment_are_no_candidates(spark):
    """Twenty lines with one segment and none of the commonest letters elsewhere, and one near line."""
    rests = [12 * x + 12 * y for x, y in itertools.islice(itertools.combinations("dulcmhfpgw", 2), 20)]
    texts = [f"common begin{x}" for x in [*rests, rests[0][:-3] + "x" + rests[0][-2:]]]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    found = {(r.a, r.b) for r in op2.candidates(lines).collect()}
    assert (0, 20) in found and len(found) < 20


def test_lines_stay_native(spark):
    plan = registry.Q["op2_segment_lines"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# 3 ---------------------------------------------------------------------------------------------------------------
def toxic_rows(seed, n):
    out = []
    for d, t in enumerate(prose(seed, n, 80)):
        toxic = d % 4 == 0
        out.append((d, t + (" you zlork" + "abcdef"[d % 6] + " zlorkish" if toxic else "") + " end", int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark, docs):
    rows = toxic_rows(5, 900)
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in rows] + [(None, 1, 1), (7, 1, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    table = docs([(d, t) for d, t, _ in rows] + [(5000, None), (5001, ""), (None, "plain")])
    fitted = op3.fit(table, labels)
    scores = {r.doc_id: r.score for r in op3.score_texts(table, fitted, ["doc_id"], "doc_id long").collect()}
    assert len(scores) == 903 and all(0 <= s <= 1 for s in scores.values())
    held = [(scores[d] >= op3.THRESHOLD, y == 1) for d, _, y in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    kept = op3.drop_toxic(table, fitted)
    assert kept.columns == table.columns
    assert kept.count() == sum(s < op3.THRESHOLD for s in scores.values())
    nothing = op3.fit(table, labels.filter("toxic = 0"))
    assert {r.score for r in op3.score_texts(table, nothing, ["doc_id"], "doc_id long").collect()} == {0.0}
    assert op3.score_texts(docs([]), fitted, ["doc_id"], "doc_id long").count() == 0


def test_toxic_expressions_count_anywhere_in_a_word(spark, docs):
    rows = toxic_rows(5, 900)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    plain = "".join(prose(77, 3, 80)).replace(" ", "")[:60]
    odd = [(5000, f"{plain}/zlorkish/zlorka"), (5001, '"zlorka" "zlorkish"'), (5002, f"{plain}zlorkish{plain}"), (5003, plain), (5004, f"{plain}/{plain}")]
    fitted = op3.fit(docs([(d, t) for d, t, _ in rows]), labels)
    scores = {r.doc_id: r.score for r in op3.score_texts(docs(odd), fitted, ["doc_id"], "doc_id long").collect()}
    assert min(scores[5000], scores[5001], scores[5002]) >= op3.THRESHOLD > max(scores[5003], scores[5004])


def test_sample_passes_over_long_texts_and_holds_both_classes(spark, docs):
    ids = [r.id for r in spark.range(400).orderBy(op3.F.xxhash64("id")).collect()]
    texts = {d: f"text {d} zl" for d in ids}
    texts[ids[0]] = "long " * 2000
    toxic = {d for part in (0, 2) for d in [x for x in ids[100:] if zlib.crc32(str(x).encode()) % 3 == part][:3]}
    texts |= {d: "mean " * 1500 for d in toxic if zlib.crc32(str(d).encode()) % 3 == 2}
    labels = spark.createDataFrame([(d, int(d in toxic)) for d in ids], "doc_id long, toxic int")
    got = op3.labelled_sample(docs(list(texts.items())), labels, max_docs=40, max_chars=4000).collect()
    assert {(r.toxic, r.part) for r in got} == {(0, 0), (0, 2), (1, 0), (1, 2)}
    assert not any(r.text.startswith("long") for r in got) and sum(r.text.startswith("mean") for r in got) == 1
    assert op3.labelled_sample(docs(list(texts.items())), labels.limit(0)).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------------
def shingles(text, n):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_groups(rows, n):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    members = collections.defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(rows[k][0])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return [(rows[k][0], len(sets[k]), least[find(k)] if sets[k] else rows[k][0]) for k in range(len(rows))]


def near_rows(seed, big=300):
    rng = random.Random(seed)
    rows = list(enumerate(prose(seed, 40, 120), 50))
    for k in range(60):
        w = rows[rng.randrange(40)][1].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(50))
        rows.append((1000 + k, " ".join(w)))
    base = prose(seed + 1, 1, 5)[0].split() + prose(seed + 2, 1, 2)[0].split() * 0 + [f"w{i}" for i in range(60)]
    for k in range(big):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(400)}"
        rows.append((2000 + k, " ".join(w)))
    return rows


def test_near_duplicates_equal_brute_force(docs):
    rows = near_rows(6) + ODD
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op4.near_duplicates(docs(rows), 4).collect()), key=str)
    assert got == sorted(brute_groups(rows, 4), key=str)


def family_rows(seed, n):
    """Copies of one text of which some are linked with it, some with another copy only, some with nothing."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(80)]
    rows = [(5000, " ".join(base))]
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(80), rng.choice([1, 1, 2, 3, 4, 6])):
            w[at] = f"e{seed}x{k}x{at}"
        rows.append((5001 + 2 * k, " ".join(w)))
        w[rng.randrange(80)] = f"f{k}"
        rows.append((5002 + 2 * k, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [16, 512])
def test_families_equal_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(op4, "BLOCK", block)
    rows = family_rows(3, 60)
    got = sorted((r.doc_id, r.component_id) for r in op4.near_duplicates(docs(rows), 4).collect())
    assert got == sorted((d, c) for d, _, c in brute_groups(rows, 4))


def test_documents_have_signatures_before_they_are_dealt_to_blocks(docs, monkeypatch):
    """What grows with a node's blocks is not joined."""
    seen, real = {}, op4.stash

    def stash(df, name):
        seen.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(op4, "BLOCK", 16)
    monkeypatch.setattr(op4, "stash", stash)
    op4.near_duplicates(docs(family_rows(3, 60)), 4).collect()
    assert "Generate" in seen["cps-near"] and "Join" not in seen["cps-near"]


def test_a_pair_of_two_nodes_is_compared_in_the_first():
    rng = np.random.default_rng(5)
    one = rng.integers(-9, 9, op4.POSITIONS).astype(np.int32)
    rows = [(k, one if k < 4 else rng.integers(99, 999, op4.POSITIONS).astype(np.int32)) for k in range(6)]

    def task(node, nodes):
        columns = {"node": [node] * 12, "i": [0] * 12, "j": [0] * 12, "side": [0] * 6 + [1] * 6}
        columns |= {"code": [k for k, _ in rows] * 2, "component": [k for k, _ in rows] * 2, "n": [9] * 12}
        columns |= {"sig": [s.tolist() for _, s in rows] * 2, "nodes": [nodes(k) for k, _ in rows] * 2}
        return set(op4._near_in_blocks(pa.table(columns)).column("code").to_pylist())

    assert task(7, lambda k: [7, 9]) == {0, 1, 2, 3}
    assert task(9, lambda k: [7, 9]) == set()
    assert task(9, lambda k: [9, 7] if k < 2 else [9]) == {0, 1, 2, 3}
    assert task(9, lambda k: [9, 7] if k != 3 else [9]) == {0, 1, 2, 3}
    assert task(9, lambda k: [9, 7] if k in (0, 1, 2, 3) else [9]) == set()


def test_one_of_each_stays(docs):
    rows = near_rows(7, 40) + ODD
    got = collections.Counter(r.doc_id for r in op4.one_of_each(docs(rows), 5).collect())
    groups = brute_groups(rows, 5)
    assert got == collections.Counter({d: 1 for d, _, c in groups if d == c})
    assert op4.one_of_each(docs([]), 5).count() == 0 and op4.near_duplicates(docs([]), 4).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=20), min_size=1, max_size=10))
def test_column_wise_equals_sorting(strings):
    raw = [s.encode() for s in strings]
    text = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint16) + 1
    string, length, common = op5.column_wise(text, np.array([len(s) for s in raw]))
    got = [raw[i][len(raw[i]) - k :] for i, k in zip(string, length, strict=True)]
    assert got == sorted(s[k:] for s in raw for k in range(len(s) + 1))
    for k in range(1, len(got)):
        a, b = got[k - 1], got[k]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def brute_removed(rows):
    owner = {}
    key = lambda d: (d is not None, d or 0)
    for d, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            if w not in owner or key(d) < key(owner[w]):
                owner[w] = d
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 49):
            if key(owner[raw[p : p + 50]]) < key(d):
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((d, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [1 << 20, 700])
def test_passages_equal_brute_force(docs, monkeypatch, part):
    monkeypatch.setattr(op5, "PART", part)
    rng, base = random.Random(8), prose(8, 12, 60)
    rows = ODD + [(6, "y" * 500 + "é" * 100), (7, "y" * 300)]
    for d in range(10, 50):
        pieces = [x[rng.randrange(len(x)) :] for x in rng.sample(base, 3)] + prose(d, 2, 12)
        rng.shuffle(pieces)
        rows.append((d, " Éa ".join(pieces)))
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5.remove_repeats(docs(rows)).collect()), key=str)
    assert got == brute_removed(rows)
    assert op5.remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize(
    "rows",
    [[(1, "one short text")], [(1, "a" * 40 + "b" * 40), (2, "c" * 40 + "d" * 60)], [(1, "equal " * 20), (2, "equal " * 20)], [(3, "same id " * 12), (3, "same id " * 12)]],
    ids=["one-short", "nothing-shared", "equal-texts", "equal-rows"],
)
def test_tables_without_shared_or_removed_passages(docs, rows):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5.remove_repeats(docs(rows)).collect()), key=str)
    assert got == brute_removed(rows)


def test_positions_beyond_the_packed_bits(monkeypatch):
    monkeypatch.setattr(op5, "_POSITION", np.uint64((1 << 12) - 1))
    rng = random.Random(31)
    again = "".join(rng.choices("abcdefgh ", k=500)).encode()
    raw = ["".join(rng.choices("abcdefgh ", k=700)).encode() for _ in range(30)] + [again, b"short", b"", again[100:200]]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    anchors, passages = collections.defaultdict(set), 0
    for owner, start, end, at, anchor in zip(*op5.anchored_strings(data, offsets), strict=True):
        assert offsets[owner] <= start and end <= offsets[owner + 1] and 0 <= at and start + at + op5.ANCHOR <= end and end - start <= 2 * op5.LENGTH - op5.ANCHOR
        mark = data[start + at : start + at + op5.ANCHOR]
        assert op5.spans(op5.prefix_sums(mark, fold=False), np.array([0]), np.array([op5.ANCHOR]))[0] == anchor
        for p in range(start, end - op5.LENGTH + 1):
            anchors[data[p : p + op5.LENGTH].tobytes()].add((int(anchor), int(start + at - p)))
            passages += 1
    assert passages == sum(max(0, len(x) - op5.LENGTH + 1) for x in raw)
    assert all(len(x) == 1 for x in anchors.values())


# 6 ---------------------------------------------------------------------------------------------------------------
def test_forward_and_counts_equal_enumeration():
    rng = np.random.default_rng(1)
    start, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3)
    seqs = [rng.integers(0, 4, n) for n in (1, 2, 4, 5)]
    flat, sizes = np.concatenate(seqs), np.array([len(s) for s in seqs])
    starts = np.cumsum(sizes) - sizes
    loglik, firsts, moves, emits = [], np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
    for s in seqs:
        paths = list(itertools.product(range(3), repeat=len(s)))
        p = np.array([start[z[0]] * math.prod(move[a, b] for a, b in zip(z, z[1:], strict=False)) * math.prod(emit[a, c] for a, c in zip(z, s, strict=True)) for z in paths])
        loglik.append(math.log(p.sum()))
        for z, w in zip(paths, p / p.sum(), strict=True):
            firsts[z[0]] += w
            for a, b in zip(z, z[1:], strict=False):
                moves[a, b] += w
            for a, c in zip(z, s, strict=True):
                emits[a, c] += w
    assert np.allclose(op6.forward(flat, starts, sizes, start, move, emit), loglik)
    got = op6.expected_counts(flat, starts, sizes, start, move, emit)
    assert np.allclose(got[0], firsts) and np.allclose(got[1], moves) and np.allclose(got[2], emits) and np.isclose(got[3], sum(loglik))


def test_language_model_base_and_gain(docs):
    rows = [(k, t) for k, t in enumerate(prose(9, 150) + [x.upper() for x in prose(10, 150)], 10)] + ODD
    got = op6.score_documents(docs(rows), states=3, passes=3).collect()
    counts, tokens = collections.Counter(), lambda t: [*WORD.findall(lower(t)), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    for d, t in rows:
        if not held(d):
            counts.update(tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    expected = []
    for d, t in rows:
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens(t))
        expected.append((d, held(d), len(tokens(t)), sum(w in counts for w in tokens(t)), total, round(base, 6)))
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(expected, key=str)
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert op6.score_documents(docs([])).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------
marks = st.sampled_from(["</s>", "<s>", "[INST]", " [/INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>", "<|/|>", "~", "<~/s>", "[~~/INST]", "x", " ", "\n"])


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "tool", "", "|>", "<|/|>"]), st.lists(marks, max_size=8).map("".join))
def test_turns_read_back(role, body):
    text, start, end = op7.render_turn(role, body)
    got = op7.parse_turn(text)
    assert got[3] == len(text) and (got[1], got[2]) == (start, end) and op7.unescape(text[start:end]) == body
    assert op7.unescape(op7.escape(body)) == body


def test_conversations_with_odd_rows(spark):
    rows = [(1, 0, "user", "hi", "e"), (1, 1, "assistant", None, "e"), (1, 1, "assistant", "</s>", "e"), (2, None, None, "a", "e"), (None, 0, "user", "", "e")] + [(3, 0, "user", "q", "e")] * 2
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fragment string")
    got = {r.conv_id: r for r in op7.read_back(op7.format_turns(turns)).collect()}
    text = lambda *parts: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in parts).encode()).hexdigest()
    assert got[1].turns_sha256 == text(("user", "hi"), ("assistant", ""), ("assistant", "</s>")) and got[1].loss_chars == 4
    assert got[2].turns_sha256 == text(("", "a")) and got[3].n_turns == 2 and got[None].n_turns == 1
    assert op7.read_back(op7.format_turns(turns.limit(0))).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------
def test_mix_fills_targets(docs, spark):
    rows = ODD + [(k, t) for k, t in enumerate(prose(11, 300), 20)]
    table = docs(rows)
    got = op8.mix(table).collect()
    assert len(got) == len(rows) and got and all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    total = sum(r["size"] for r in got)
    by = collections.defaultdict(lambda: [0, 0.0, 0, 0])
    for r in got:
        by[r.source] = [r.source_size, r.target, by[r.source][2] + r.taken, max(by[r.source][3], r["size"])]
    assert math.isclose(sum(t for _, t, _, _ in by.values()), min(1.5, 2) * total)
    assert all(t <= 2 * s + 1e-6 and abs(taken - t) <= 2 * most + 1 for s, t, taken, most in by.values())
    assert sorted(got, key=str) == sorted(op8.mix(table.repartition(3)).collect(), key=str)
    assert op8.mix(docs([])).count() == 0
    nulls = spark.createDataFrame([(None, None, None), (1, "a b", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r["size"], r.source_size) for r in op8.mix(nulls).collect()} == {(None, 0, 2), (1, 2, 2)}


# 9 ---------------------------------------------------------------------------------------------------------------
def test_vector_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op9, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 24))
    x = np.concatenate([base, base[rng.integers(0, 30, 150)] + rng.standard_normal((150, 24)) * 0.2, np.repeat(base[:1], 40, 0)]).astype(np.float32)
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] + [1.0] * 23), (903, [None] + [1.0] * 23), (904, [1.0, 2.0]), (905, []), (906, [float("inf")] * 24)]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(k, v, 1) for k, v in odd]
    got = {r.vec_id: r for r in op9.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, code int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    links = near.sum(1) - 1
    assert sum(got[k].n_links for k in range(len(x))) >= 0.9 * links.sum() and all(got[k].n_links <= links[k] for k in range(len(x)))
    assert all(got[k].n_links == 0 and got[k].kept for k, _ in odd)
    assert all(near[0, k] <= (got[k].component_id == got[0].component_id) for k in range(len(x)))
    assert op9.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_with_a_common_direction_and_of_two_sizes(spark, monkeypatch):
    monkeypatch.setattr(op9, "FEW", 100, raising=False)
    rng = np.random.default_rng(4)
    rows, expected = [], {}
    for dims, count in ((48, 1200), (32, 700), (5, 20)):
        side = rng.standard_normal((count, dims)) / math.sqrt(dims)
        side[1::2] = 0.7 * side[::2] + math.sqrt(1 - 0.7**2) * side[1::2]
        x = math.sqrt(0.68) * np.eye(dims)[0] + math.sqrt(0.32) * side
        u = x / np.linalg.norm(x, axis=1)[:, None]
        near = (u @ u.T >= 0.9).sum(1) - 1
        expected |= {len(rows) + k: int(n) for k, n in enumerate(near)}
        rows += [(len(rows) + k, v.tolist()) for k, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in op9.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for some in (range(1200), range(1200, 1900), range(1900, 1920)):
        assert sum(got[k] for k in some) >= 0.95 * sum(expected[k] for k in some) > 0
    assert all(got[k] <= expected[k] for k in got)


# 10 --------------------------------------------------------------------------------------------------------------
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = (True, kind == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(digits) <= 19 and op10.luhn(digits), 8 <= len(digits) <= 15)[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


bits = st.sampled_from(["a", "b.", "@", "@x.y", "1", "22", ".", "+1", "-", " ", "(", "255", "4111111111111111", "é", "_", "%", "007"])


@settings(max_examples=500, deadline=None)
@given(st.lists(bits, max_size=14).map("".join))
def test_exact_spans_equal_the_patterns(text):
    assert sorted(op10.exact_spans(text)) == brute_spans(text)


def test_personal_data_is_found(docs):
    rng, rows = random.Random(12), list(ODD)
    for d, t in enumerate(prose(12, 400), 20):
        extra = [f"{t[:3].strip()}{d}@mail{d % 9}.example.com", f"10.{d % 250}.7.9", "4111 1111 1111 1111", f"+1 (555) 555-{1000 + d}", f"order {d}{d}{d}{d}1234567", f"999.{d}.300.1"]
        rows.append((d, t + " " + " ; ".join(rng.sample(extra, 2))))
    rows.append((9999, "write an e-mail to anna.x (at) mail4 dot example dot com please"))
    got = op10.find_personal_data(docs(rows)).collect()
    assert len(got) == len(rows)
    text_of = dict(rows)
    for r in got:
        base = brute_spans(text_of[r.doc_id] or "")
        shown = ",".join(f"{op10.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert set(shown.split(",")) - {""} <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in range(4)]
    assert op10.find_personal_data(docs([])).count() == 0


@pytest.mark.parametrize("address", ["john (at) example.com", "john at example.com", "john [AT] mail.example.com", "john@example.com", "john at example dot com"])
def test_wide_addresses_depend_on_themselves_only(address):
    for text in (address, f"so {address}, he said", f"{address} and @ and dot"):
        start = text.index(address)
        assert any(k == 0 and a <= start and b >= start + len(address) for k, a, b in op10.wide_spans(text))
    assert op10.disguised(0, "john@example.com", 2) == "john at example.com" and op10.disguised(0, "john@example.com", 3) == "john (at) example.com"
    assert not [k for k, _, _ in op10.wide_spans("meet me at noon, @ nobody") if k == 0]
