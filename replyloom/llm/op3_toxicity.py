"""Toxicity by class-conditional Kneser-Ney models.

Two models, one of toxic and one of ordinary training texts, spell every byte of a word, and its end, from the bytes before
it, ``ORDER`` - 1 at most, the word's start among them. A byte that was not seen behind that history is spelled from a
shorter one. Counts are numbers of documents, discounted by an absolute amount; the mass taken away goes to continuation
counts (behind how many different bytes a shorter expression stands), which both classes share. So a rare expression
weighs little, while a known one speaks for its class wherever it stands in a word. The weight of stepping to a shorter
history is taken as alike in both classes.

A word's evidence is the ratio of its two log-likelihoods; one of more than ``STRETCH`` bytes, such as a text without
blanks, has that of each stretch of so many. A text's evidence is length-normalised: the mean per word over the whole text
and the means over its strongest words. A logistic curve, fitted on labelled texts that the models did not see, turns them
into a score.

The models are fitted on a bounded sample of labelled rows: at most ``MAX_DOCS`` texts and ``MAX_CHARS`` characters, in
order of a hash of the id. Ids whose texts do not fit any more are passed over. The first ``LEAST_DOCS`` of each class and
part have a share of the characters to themselves, and a class that has none yet gets its shortest text, so that labelled
classes are in the sample however rare or long they are. Every text is scored whole.

Defined results: NULL and empty texts have no evidence and get the score of the curve at zero evidence; rows without a label
are scored, not learned from; repeated label rows count once each id (toxic if any says so); NULL labels are ignored;
without both classes in the sample every score is 0; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.common import crc, slices, table, text_bytes
from replyloom.llm.words import mixed, prefix_sums, spans, word_bounds
from replyloom.session import stash

DISCOUNT = 0.75
MAX_DOCS = 24_000
MAX_CHARS = 32_000_000
LEAST_DOCS = 200
#: An expression is part of the models if so many sampled documents have it.
MIN_DOCS = 3
THRESHOLD = 0.7
TOP = (1, 3, 8)
#: Bytes of the longest expressions counted, the spelled one included.
ORDER = 8
#: Bytes that are one piece of evidence at most; histories reach over its edge.
STRETCH = 24
CACHE_WORDS = 400_000
MARK = 0x20


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray, last: np.ndarray):
    """Stretches ``data[starts:ends]`` laid out with marks: hash sums, and owner, place and first byte of history of each spelled byte.

    ``lead`` bytes of a stretch are history only; without any the stretch starts its word. ``last`` ones end their word.
    """
    sizes = ends - starts
    piece = np.cumsum(sizes + 2) - (sizes + 2)
    laid = np.full(int((sizes + 2).sum()), MARK, np.uint8)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    laid[np.repeat(piece + 1, sizes) + inside] = data[np.repeat(starts, sizes) + inside]
    n = sizes - lead + last
    owner = np.repeat(np.arange(len(sizes)), n)
    place = np.repeat(piece + 1 + lead, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return prefix_sums(laid), owner, place, (piece + (lead > 0))[owner]


class KneserNey:
    """Both classes' models: the log ratio of each counted expression, from a table of expressions (``count_expressions``)."""

    def __init__(self, gram: np.ndarray, history: np.ndarray, suffix: np.ndarray, size: np.ndarray, counts: np.ndarray):
        order = np.argsort(gram)
        self.grams, history, suffix, size, counts = gram[order], history[order], suffix[order], size[order], counts[order]
        at_suffix = np.minimum(np.searchsorted(self.grams, suffix), max(0, len(gram) - 1))
        behind = np.bincount(at_suffix[size > 1], minlength=len(gram)).astype(float)
        group = np.unique(history, return_inverse=True)[1]
        total = lambda x: np.bincount(group, x)[group]
        sums, kinds = total(behind), total((behind > 0).astype(float))
        shared, lower = np.zeros(len(gram)), np.full(len(gram), 1 / 257)
        for k in range(1, int(size.max(initial=0)) + 1):
            mine = size == k
            if k > 1:
                lower[mine] = shared[at_suffix[mine]]
            known = mine & (sums > 0)
            shared[mine] = lower[mine]
            shared[known] = (np.maximum(behind[known] - DISCOUNT, 0) + DISCOUNT * kinds[known] * lower[known]) / sums[known]
        logs = []
        for c in (0, 1):
            n = counts[:, c].astype(float)
            t, kinds = total(n), total((n > 0).astype(float))
            logs.append(np.log(np.where(t > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(t, 1), lower)))
        self.ratio = logs[1] - logs[0]

    def log_ratios(self, data, starts, ends, lead, last) -> np.ndarray:
        """log p(stretch | toxic) - log p(stretch | ordinary), each byte by its longest known expression."""
        sums, owner, place, least = _spelled(data, starts, ends, lead, last)
        out = np.zeros(len(owner))
        open_ = np.arange(len(owner) if len(self.grams) else 0)
        for k in range(ORDER, 0, -1):
            fits = open_[place[open_] - k + 1 >= least[open_]]
            code = spans(sums, place[fits] - k + 1, place[fits] + 1)
            at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
            hit = self.grams[at] == code
            out[fits[hit]] = self.ratio[at[hit]]
            left = np.zeros(len(owner), bool)
            left[open_] = True
            left[fits[hit]] = False
            open_ = np.flatnonzero(left)
        return np.bincount(owner, out, minlength=len(starts))


class Evidence:
    """Length-normalised evidence of whole texts; words are looked up once and kept in a bounded table."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def of_stretches(self, data, starts, ends, lead, last) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        hashes = mixed(spans(prefix_sums(data), starts, ends) + (2 * lead + last).astype(np.uint64))
        uniq, first, inv = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, uniq), max(0, len(self.keys) - 1))
        old = self.keys[at] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        values = np.empty(len(uniq))
        values[old] = self.values[at[old]]
        new = np.flatnonzero(~old)
        values[new] = self.model.log_ratios(data, *(x[first[new]] for x in (starts, ends, lead, last)))
        if len(self.keys) + len(new) > CACHE_WORDS:
            self.keys, self.values = uniq, values
        else:
            keys = np.concatenate([self.keys, uniq[new]])
            order = np.argsort(keys)
            self.keys, self.values = keys[order], np.concatenate([self.values, values[new]])[order]
        return values[inv]

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text: mean evidence of all words, means of the strongest words, log word count."""
        data, offsets = text_bytes(column)
        starts, ends, _ = word_bounds(data, offsets)
        times = -(-(ends - starts) // STRETCH)
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        word, stop = np.repeat(starts, times), np.repeat(ends, times)
        begin = word + STRETCH * step
        lead = np.minimum(ORDER - 1, begin - word)
        end = np.minimum(begin + STRETCH, stop)
        values = self.of_stretches(data, begin - lead, end, lead, (end == stop).astype(np.int64))
        of_text = np.searchsorted(begin, offsets)
        out = np.zeros((len(offsets) - 1, 2 + len(TOP)))
        for d, (a, b) in enumerate(zip(of_text[:-1], of_text[1:], strict=True)):
            if b > a:
                best = np.sort(np.partition(values[a:b], max(0, b - a - max(TOP)))[-max(TOP) :])[::-1]
                out[d] = [values[a:b].mean(), *[best[:k].sum() / k for k in TOP], math.log(b - a)]
        return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> DataFrame:
    """``text, toxic, part`` of the sampled training rows; ``part`` 0 fits the models and 2 the curve.

    The ids are chosen on narrow columns; they are at most ``max_docs`` and ``LEAST_DOCS`` of each class and part, which
    bounds what is broadcast.
    """
    y = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.filter(crc(F.col("doc_id")) % 3 != 1)
    sized = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).join(y, "doc_id").groupBy("doc_id", "toxic").agg(F.sum("chars").alias("chars"))
    kind = F.concat_ws(":", F.col("toxic") == 1, crc(F.col("doc_id")) % 3)
    sized = stash(sized.select("*", F.xxhash64("doc_id").alias("draw"), kind.alias("kind")), "toxicity-sizes")
    order = ["draw", "doc_id"]
    shortest = {r["kind"]: r["least"] for r in sized.groupBy("kind").agg(F.min(F.struct("chars", *order, "toxic")).alias("least")).collect()}
    chosen, chars = {}, 0
    for k in sorted(shortest):
        own = 0
        for row in sized.filter(F.col("kind") == k).orderBy(*order).limit(LEAST_DOCS).collect():
            if own + row["chars"] <= max_chars // 8:
                own += row["chars"]
                chosen[row["doc_id"]] = int(row["toxic"])
        if not own and shortest[k]["doc_id"] not in chosen:
            own += shortest[k]["chars"]
            chosen[shortest[k]["doc_id"]] = int(shortest[k]["toxic"])
        chars += own
    for row in sized.orderBy(*order).limit(max_docs).collect():
        if row["doc_id"] not in chosen and chars + row["chars"] <= max_chars:
            chars += row["chars"]
            chosen[row["doc_id"]] = int(row["toxic"])
    ids = docs.sparkSession.createDataFrame(sorted(chosen.items()), "doc_id long, toxic int")
    part = (crc(F.col("doc_id")) % 3).alias("part")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic", part)


_EXPRESSIONS = "gram long, history long, suffix long, size int, ordinary long, toxic long"


def _count_expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        data, offsets = text_bytes(part.column("text"))
        toxic = np.array([y == 1 for y in part.column("toxic").to_pylist()])
        starts, ends, of_text = word_bounds(data, offsets)
        doc = np.repeat(np.arange(part.num_rows, dtype=np.uint64), np.diff(of_text))
        apart = lambda code, doc: np.unique(mixed(code) + doc * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
        some = apart(spans(prefix_sums(data), starts, ends), doc) if len(starts) else np.zeros(0, np.int64)
        none = np.zeros(len(some), np.int64)
        sums, owner, place, least = _spelled(data, starts[some], ends[some], none, none + 1)
        doc = doc[some][owner]
        for k in range(1, ORDER + 1):
            fits = np.flatnonzero(place - k + 1 >= least)
            begin, end = place[fits] - k + 1, place[fits] + 1
            code = spans(sums, begin, end)
            each = apart(code, doc[fits])
            gram, first, which = np.unique(code[each], return_index=True, return_inverse=True)
            at = each[first]
            by_class = [np.bincount(which, toxic[doc[fits[each]].astype(np.int64)] == c, minlength=len(gram)).astype(np.int64) for c in (False, True)]
            columns = [x.view(np.int64) for x in (gram, spans(sums, begin[at], end[at] - 1), spans(sums, begin[at] + 1, end[at]))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, np.full(len(gram), k, np.int32), *by_class)], names=[c.split()[0] for c in _EXPRESSIONS.split(", ")])


def count_expressions(sample: DataFrame) -> tuple[np.ndarray, ...]:
    """Expressions that ``MIN_DOCS`` have, with history, suffix and size, and documents of each class; bounded by the sample's characters."""
    parts = sample.select("text", "toxic").mapInArrow(_count_expressions, _EXPRESSIONS)
    rows = parts.groupBy("gram").agg(*[F.first(c).alias(c) for c in ("history", "suffix", "size")], F.sum("ordinary").alias("o"), F.sum("toxic").alias("t"))
    got = rows.filter(F.col("o") + F.col("t") >= MIN_DOCS).toArrow()
    gram, history, suffix, size, o, t = (got.column(c).to_numpy() for c in ("gram", "history", "suffix", "size", "o", "t"))
    return gram.view(np.uint64), history.view(np.uint64), suffix.view(np.uint64), size, np.column_stack([o, t])


def _scorer(fitted):
    evidence = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = fitted.value
        if model is not None and not evidence:
            evidence.append(Evidence(model))
        for part in slices(batches, "text"):
            if model is None:
                score = np.zeros(part.num_rows)
            else:
                x = evidence[0].features(part.column("text"))
                z = np.column_stack([x, np.ones(len(x))]) @ weights
                score = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in part.schema.names if c != "text"], pa.array(score)], names=[*[c for c in part.schema.names if c != "text"], "score"])

    return run


def _sampled_features(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(model.value)
        for part in slices(batches, "text"):
            x = evidence.features(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame):
    """The model and the curve's weights, or (None, None) if a class is missing in the sample."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels)
    expressions = count_expressions(sample.filter("part = 0"))
    if not (expressions[-1].sum(0) > 0).all():
        return None, None
    model = KneserNey(*expressions)
    seen = spark.sparkContext.broadcast(model)
    rows = sample.filter("part = 2").select("text", "toxic").mapInArrow(_sampled_features(seen), "toxic int, x array<double>").toArrow()
    y = np.array(rows["toxic"].to_pylist(), float)
    if not (y > 0).any() or not (y == 0).any():
        return None, None
    return model, fit_curve(np.array(rows["x"].to_pylist()), (y == 1).astype(float))


def score_texts(docs: DataFrame, fitted, keep: list[str], keep_schema: str) -> DataFrame:
    """The columns ``keep`` and ``score`` for each text."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted)
    return docs.select(*keep, "text").mapInArrow(_scorer(sent), f"{keep_schema}, score double")


def _filter(fitted):
    evidence = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = fitted.value
        if model is not None and not evidence:
            evidence.append(Evidence(model))
        for part in slices(batches, "text"):
            if model is not None:
                x = evidence[0].features(part.column("text"))
                part = part.filter(pa.array(np.column_stack([x, np.ones(len(x))]) @ weights < math.log(THRESHOLD / (1 - THRESHOLD))))
            yield part

    return run


def drop_toxic(docs: DataFrame, fitted) -> DataFrame:
    """The rows of ``docs`` with a score below the threshold, all columns as they are; nothing is moved."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted)
    return docs.mapInArrow(_filter(sent), docs.schema)


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fitted = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_texts(docs, fitted, ["doc_id"], "doc_id long")
    return scored.select("doc_id", (crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
