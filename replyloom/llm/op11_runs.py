"""Periodic runs of words, found on a grammar.

A run is a stretch of words with smallest period q whose length is at least ``LEAST`` and ``EXPONENT * q``, and which
neither neighbouring word extends.

The word ids of a slice of texts are compressed by Re-Pair: in each round the pairs of neighbouring symbols are counted,
and a pair that is more frequent than those it overlaps with becomes a new symbol; pairs never cross texts. What is left
of a text when no pair is repeated is joined two by two, so that each text is one symbol. Each rule X -> YZ is searched
once, at the first place X derives: for every period of a quarter of X or less, words next to the boundary between Y and Z are
compared with those a period on, squares are confirmed and extended by prefix hashes up to the ends of X. Any run crosses the boundary
of the smallest symbol that holds it whole, so it is found there whole; symbols inside it find parts of it.

A rule's runs are then translated to all places the rule derives. Of the intervals with one period, those that
lie in others are dropped, which leaves the maximal ones. Each is compared word by word with itself a period on.

Defined results: NULL, empty and blank texts have no words and no runs; a text is one row of a task, searched in steps of
``STEP_PAIRS`` comparisons, so that a very long text costs n log n; repeated rows each get their own result; a NULL id
counts as an empty text for crc32; ties for the highest exponent go to the smallest start, then period; an empty table gives an
empty table; columns other than ``doc_id`` and ``text`` are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.common import crc, slices, table
from replyloom.llm.words import mixed

LEAST = 6
EXPONENT = 4
#: Text bytes whose words share a grammar.
SLICE = 1 << 20
#: (boundary, period) pairs looked at in one step.
STEP_PAIRS = 1 << 20
#: Re-Pair ends when a round replaces less than this share of the symbols.
SLOW = 1 / 64
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Grammar:
    """Rules as (left, boundary, right) of the first derived place, and all places of each rule."""

    def __init__(self, words: np.ndarray, texts: np.ndarray):
        """``words``: ids; ``texts``: the n + 1 offsets of the texts."""
        self.rules: list[np.ndarray] = []
        self.places: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0
        self.symbol = words.astype(np.int64)
        self.start = np.arange(len(words))
        self.text = np.repeat(np.arange(len(texts) - 1), np.diff(texts))
        self.end = texts[1:]
        self.fresh = int(words.max(initial=-1)) + 1
        while self._replace_frequent():
            pass
        while self._join_rest():
            pass

    def _replace(self, at: np.ndarray, rule: np.ndarray) -> None:
        """Replaces the pairs that begin at ``at`` by symbols; pairs of one ``rule`` number get one symbol."""
        numbers, first, rule = np.unique(rule, return_index=True, return_inverse=True)
        stop = np.append(self.start, 0)
        stop[-1] = self.end[-1]
        left, boundary = self.start[at], self.start[at + 1]
        right = np.minimum(stop[at + 2], self.end[self.text[at]])
        self.rules.append(np.stack([left[first], boundary[first], right[first]], axis=1))
        self.places.append((rule + self.count, left))
        self.symbol[at] = rule + self.fresh
        self.count += len(numbers)
        self.fresh += len(numbers)
        keep = np.ones(len(self.symbol), bool)
        keep[at + 1] = False
        self.symbol, self.start, self.text = self.symbol[keep], self.start[keep], self.text[keep]

    def _replace_frequent(self) -> bool:
        if len(self.symbol) < 2:
            return False
        inside = self.text[1:] == self.text[:-1]
        at = np.flatnonzero(inside)
        _, pair, times = np.unique(self.symbol[at] * np.int64(self.fresh) + self.symbol[at + 1], return_inverse=True, return_counts=True)
        # the more frequent pair wins; a pair's number decides between equally frequent ones
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(1, len(times) + 1)
        weight = np.zeros(len(self.symbol) + 1, np.int64)
        weight[at + 1] = np.where(times[pair] > 1, rank[pair], 0)
        own = weight[1:]
        # stretches of one pair (a a a ...) win or lose as one, and give every other pair
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        size = np.diff(edge, append=len(own))
        value = own[edge]
        before, after = np.append(0, value[:-1]), np.append(value[1:], 0)
        wins = (value > 0) & (value > before) & (value > after)
        step = np.arange(len(own)) - np.repeat(edge, size)
        chosen = np.flatnonzero(np.repeat(wins, size) & (step % 2 == 0))
        if not len(chosen):
            return False
        enough = len(chosen) >= len(self.symbol) * SLOW
        self._replace(chosen, own[chosen])
        return enough

    def _join_rest(self) -> bool:
        if len(self.symbol) < 2:
            return False
        first = np.append(True, self.text[1:] != self.text[:-1])
        edge = np.flatnonzero(first)
        step = np.arange(len(self.text)) - np.repeat(edge, np.diff(edge, append=len(self.text)))
        at = np.flatnonzero((step[:-1] % 2 == 0) & (self.text[1:] == self.text[:-1]))
        if len(at):
            self._replace(at, np.arange(len(at)))
        return len(at) > 0


class Hashes:
    """Equality of stretches of words by prefix hashes modulo 2**64 of random word codes."""

    def __init__(self, words: np.ndarray, seed: int = 11):
        n = len(words)
        code = mixed(words.astype(np.uint64) * np.uint64(2 * seed + 1) + np.uint64(0x1234_5678_9ABC_DEF1)) | np.uint64(1)
        self.power = np.full(n + 1, _BASE, np.uint64)
        self.power[0] = 1
        self.power = np.cumprod(self.power, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(code * self.power[:n], out=self.sums[1:])

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` words from ``a`` equal those from ``b``; a <= b."""
        return (self.sums[a + length] - self.sums[a]) * self.power[b - a] == self.sums[b + length] - self.sums[b]

    def extent(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from ``a`` on (or before ``a``) equal those from (before) ``b``, ``most`` at most."""
        low, high = np.zeros_like(most), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_] + 1) // 2
            shift = 0 if forward else middle
            equal = self.same(a[open_] - shift, b[open_] - shift, middle)
            low[open_[equal]] = middle[equal]
            high[open_[~equal]] = middle[~equal] - 1


def _crossing(words: np.ndarray, hashes: Hashes, rules: np.ndarray, first: int) -> np.ndarray:
    """Runs across the boundaries of ``rules``, whose numbers begin at ``first``: rows of rule, start, end, period."""
    left, boundary, right = rules.T
    periods = (right - left) // EXPONENT
    rule = np.repeat(np.arange(len(rules)), periods)
    p = np.arange(len(rule)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    found = []
    for behind in (True, False):  # a square begins, or ends, at the boundary
        base = boundary[rule] if behind else boundary[rule] - 2 * p
        some = np.flatnonzero((base >= left[rule]) & (base + 2 * p <= right[rule]))
        b, q = base[some], p[some]
        some = some[(words[b] == words[b + q]) & (words[b + q - 1] == words[b + 2 * q - 1])]
        b, q = base[some], p[some]
        some = some[hashes.same(b, b + q, q)]
        found.append(np.stack([rule[some], base[some], p[some]], axis=1))
    rule, base, p = np.concatenate(found).T
    start = base - hashes.extent(base, base + p, base - left[rule], forward=False)
    end = base + p + hashes.extent(base, base + p, right[rule] - p - base, forward=True)
    long = end - start >= np.maximum(LEAST, EXPONENT * p)
    rows = np.stack([rule + first, start, end, p], axis=1)[long]
    # the smallest period of a stretch comes first; multiples of it have the same ends
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(1))] if len(rows) else rows


def _maximal(intervals: np.ndarray) -> np.ndarray:
    """Rows of (period, start, end) that lie in no other row of their period, ordered by start, then period."""
    if not len(intervals):
        return intervals
    p, s, e = intervals[np.lexsort((-intervals[:, 2], intervals[:, 1], intervals[:, 0]))].T
    span = int(e.max()) + 1
    through = np.maximum.accumulate(p * span + e)
    fresh = np.append(True, (p * span + e)[1:] > through[:-1])
    p, s, e = p[fresh], s[fresh], e[fresh]
    order = np.lexsort((p, s))
    return np.stack([p, s, e], axis=1)[order]


def find_runs(words: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """All runs as rows of (period, start, end) in positions of ``words``, ordered by start, then period."""
    grammar = Grammar(words, texts)
    if not grammar.count:
        return np.zeros((0, 3), np.int64)
    rules = np.concatenate(grammar.rules)
    rule_of, place = (np.concatenate(x) for x in zip(*grammar.places, strict=True))
    for seed in range(11, 64):
        hashes = Hashes(words, seed)
        wide = np.flatnonzero(rules[:, 2] - rules[:, 0] >= LEAST)
        cost = np.cumsum((rules[wide, 2] - rules[wide, 0]) // EXPONENT)
        found, a = [], 0
        while a < len(wide):
            b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + STEP_PAIRS, side="right")))
            part = _crossing(words, hashes, rules[wide[a:b]], 0)
            part[:, 0] = wide[a:b][part[:, 0]]
            found.append(part)
            a = b
        if not found:
            return np.zeros((0, 3), np.int64)
        runs = np.concatenate(found)
        # each rule's runs to all of its places
        by_rule = np.argsort(rule_of, kind="stable")
        edges = np.searchsorted(rule_of[by_rule], np.arange(grammar.count + 1))
        times = (edges[1:] - edges[:-1])[runs[:, 0]]
        which = np.repeat(np.arange(len(runs)), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        shift = place[by_rule[edges[runs[which, 0]] + nth]] - rules[runs[which, 0], 0]
        moved = np.stack([runs[which, 3], runs[which, 1] + shift, runs[which, 2] + shift], axis=1)
        out = _maximal(moved)
        if all(np.array_equal(words[s : e - p], words[s + p : e]) for p, s, e in out.tolist()):
            return out
    raise AssertionError("word hashes kept colliding")


def collapsed(n: int, runs: np.ndarray, base: int = 0) -> np.ndarray:
    """Which of ``n`` words stay: a run keeps its first period, unless another run drops it."""
    change = np.zeros(n + 1, np.int64)
    p, s, e = runs.T
    np.add.at(change, s + p - base, 1)
    np.add.at(change, e - base, -1)
    return np.cumsum(change)[:n] == 0


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", SLICE):
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("text")]
        split = [t.split() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        every = [w for words in split for w in words]
        ids = pa.array(every, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if every else np.zeros(0, np.int64)
        runs = find_runs(ids, offsets)
        edges = np.searchsorted(runs[:, 1], offsets)
        kept, lists = [], []
        for k, words in enumerate(split):
            mine = runs[edges[k] : edges[k + 1]]
            lists.append([{"start": s - int(offsets[k]), "length": e - s, "period": p} for p, s, e in mine.tolist()])
            if len(mine):
                words = [words[i] for i in np.flatnonzero(collapsed(len(words), mine, int(offsets[k])))]
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(lists, _RUNS_ARROW), pa.array(kept, pa.large_binary()).cast(pa.string() if sum(map(len, kept)) < 2**31 - 1 else pa.large_string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs(doc_id, text)``: runs by start, then period, and the text without repeats."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(_search, f"doc_id bigint, n_words bigint, runs {_RUNS}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text whose words repeat from word a on with period p, where crc32 of the id is divisible by 10."""
    h = crc(doc_id)
    g = F.floor(h / 10)
    # [^\x20\x09-\x0D]+ are the words
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    repeated = F.transform(
        F.array(F.struct(words.alias("w"), F.size(words).cast("long").alias("n"), g.alias("g"))),
        lambda x: F.transform(
            F.array(F.struct(x["w"].alias("w"), (x["g"] % x["n"]).alias("a"), (1 + F.floor((x["n"] - x["g"] % x["n"]) / (3 + x["g"] % 8))).alias("p"))),
            lambda y: F.transform(y["w"], lambda w, i: F.when(i < y["a"], w).otherwise(F.get(y["w"], (y["a"] + (i - y["a"]) % y["p"]).cast("int")))),
        )[0],
    )[0]
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.array_join(repeated, " ")).otherwise(text)


def op11_grammar_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    # the run of the greatest length / period, compared as products of whole numbers
    better = lambda x, y: (
        F.when(x["length"] * y["period"] > y["length"] * x["period"], -1).when(x["length"] * y["period"] < y["length"] * x["period"], 1)
        .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)
    )
    best = F.get(F.array_sort("runs", better), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digests = found.withColumn("best", best).withColumn("runs_sha256", F.sha2(listed, 256)).withColumn("collapsed_sha256", F.sha2("collapsed", 256))
    return digests.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
