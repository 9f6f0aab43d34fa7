"""Personal data: high-recall generators, gradient-boosted trees, calibrated thresholds.

Generators propose spans of four kinds: the exact formats below (kept always), and wider ones that overlap them: spelled-out
or spaced e-mail addresses, dotted number groups, long digit groups, telephone numbers without a plus sign. Boosted trees
score each proposal from its format (lengths, digits, groups, separators) and its context (characters and cue words around,
line position). They learn from all documents, in which the exact matches are right and wider proposals
that overlap none and stand beside no cue word are wrong; exact matches are also shown in disguise (plus sign dropped, other
separators, "at" spelled out and "dot" as well or not), since these are what the wider generators are for. Per kind, the threshold is the
least score that keeps the wanted precision on all examples that the trees did not see, a quarter of them by a hash. Proposals above it that
overlap no exact match are added, best first.

Defined results: NULL and empty texts have no spans; positions count code points, end exclusive; repeated rows get a row
each; without proposals of both sorts nothing is added; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replyloom.llm.common import table
from replyloom.session import stash

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.995
TREES, DEPTH = 16, 3

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT_DOMAIN = r"(?:@|\(at\)|\[at\]|\bat\b)\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\bdot\b)\x20?)[A-Za-z0-9-]{1,63}){1,6}"
#: Every wide e-mail address ends in this; searching it first spares most texts the longer pattern.
_ADDRESSED = re.compile(_AT_DOMAIN, re.I)
_WIDE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?" + _AT_DOMAIN, re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?[.:]\x20?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9][\x20.\-/]?){12,18}[0-9](?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:00|\(?[0-9]{2,4}\)?)[\x20.\-/]?\(?[0-9]{2,4}\)?(?:[\x20.\-/]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])"),
}
_CUES = {
    "email": re.compile(r"e-?mail|contact|write|address|@", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|credit|account|pay", re.I),
    "phone": re.compile(r"phone|call|tel\b|mobile|fax", re.I),
}
FEATURES = ("kind", "length", "digits", "letters", "groups", "longest_group", "shortest_group", "dots", "blanks", "dashes", "brackets", "slashes", "spelled", "largest", "luhn", "before", "after", "line_start", "cue", "other_cue", "digits_near")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def exact_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact formats, leftmost without overlap in each kind; failing matches are dropped."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def wide_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, kind in enumerate(KINDS):
        if kind != "email" or _ADDRESSED.search(text):
            out += [(k, m.start(), m.end()) for m in _WIDE[kind].finditer(text)]
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    groups = re.findall(r"[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    near = before[-12:] + after[:12]
    kind_of = lambda c: 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3
    cues = [bool(_CUES[k].search(before)) for k in KINDS]
    digits = _digits(span)
    return [
        float(kind), len(span), len(digits), sum(c.isalpha() for c in span), len(groups), max(sizes), min(sizes), span.count("."), span.count(" "), span.count("-"),
        span.count("(") + span.count(")"), span.count("/"), float(bool(re.search(r"\b(?:at|dot)\b", span, re.I))), max((min(int(g[:9]), 10**6) for g in groups), default=0),
        float(len(digits) >= 13 and luhn(digits)), kind_of(text[start - 1 : start]), kind_of(after[:1]), float(start == 0 or text[start - 1] == "\n"),
        float(cues[kind]), float(any(cues) and not cues[kind]), float(sum(c.isdigit() for c in near)),
    ]


def disguised(kind: int, span: str, turn: int) -> str:
    """An exact match as a writer might put it otherwise."""
    if kind == 0:
        spelled = span.replace("@", (" at ", " (at) ")[turn % 2])
        return spelled if turn // 2 % 2 else re.sub(r"\.(?=[^.]*$)", " dot ", spelled)
    if kind == 1:
        return span.replace(".", " . ") if turn % 2 else span
    digits = _digits(span)
    if kind == 2:
        return (" ", ".", "/")[turn % 3].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return f"{digits[-10:-7]}{'-. '[turn % 3]}{digits[-7:-4]}{'-. '[turn % 3]}{digits[-4:]}" if len(digits) >= 10 else digits


def _overlaps(spans: list[tuple[int, int, int]], start: int, end: int) -> bool:
    return any(a < end and start < b for _, a, b in spans)


def _right(text: str, exact: list[tuple[int, int, int]]) -> list[list[float]]:
    """Features of the exact matches, as they stand and in disguise."""
    out = []
    for turn, (kind, a, b) in enumerate(exact):
        shown = disguised(kind, text[a:b], turn)
        out += [features(text, kind, a, b), features(text[:a] + shown + text[b:], kind, a, a + len(shown))]
    return out


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        exact, wide, right = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            mine = exact_spans(text)
            exact.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(mine)])
            right.append(_right(text, mine))
            wide.append([{"kind": k, "start": a, "end": b, "x": features(text, k, a, b)} for k, a, b in wide_spans(text) if not _overlaps(mine, a, b)])
        span = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(exact, pa.list_(pa.struct(span))), pa.array(wide, pa.list_(pa.struct([*span, ("x", pa.list_(pa.float64()))]))), pa.array(right, pa.list_(pa.list_(pa.float64())))],
            names=["row", "doc_id", "exact", "wide", "right"],
        )


_SPAN = "struct<kind:int,start:int,end:int>"
_PROPOSED = f"row long, doc_id long, exact array<{_SPAN}>, wide array<struct<kind:int,start:int,end:int,x:array<double>>>, right array<array<double>>"


def fit(proposed: DataFrame):
    """Boosted trees and each kind's threshold from all proposals, or None if these have not both sorts of examples."""
    right = proposed.select(F.lit(1.0).alias("label"), F.explode("right").alias("x"))
    wrong = proposed.select(F.lit(0.0).alias("label"), F.explode("wide.x").alias("x")).filter(F.col("x")[FEATURES.index("cue")] == 0)
    rows = stash(right.union(wrong).withColumn("held", F.pmod(F.xxhash64("x"), F.lit(4)) == 0), "pii-examples")
    counts = {(r["held"], r["label"]): r["n"] for r in rows.groupBy("held", "label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 4:
        return None
    train = rows.withColumn("features", array_to_vector("x"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=10, subsamplingRate=0.8).fit(train.filter("not held"))
    scored = model.transform(train.filter("held")).select("label", F.col("x")[0].cast("int").alias("kind"), vector_to_array("probability")[1].alias("p"))
    # scores are counted first; trees of this depth give few different ones
    counted = scored.groupBy("kind", "p").agg(F.count("*").alias("n"), F.sum("label").alias("right"))
    down = Window.partitionBy("kind").orderBy(F.desc("p"))
    sums = counted.select("kind", "p", F.sum("n").over(down).alias("n"), F.sum("right").over(down).alias("right"))
    least = sums.groupBy("kind").agg(F.min(F.when(F.col("right") / F.col("n") >= PRECISION, F.col("p"))).alias("p"), F.bool_or(F.col("right") < F.col("n")).alias("tried"))
    found = {r["kind"]: (2.0 if r["p"] is None else r["p"], r["tried"]) for r in least.collect()}
    told = [found.get(kind, (2.0, False)) for kind in range(len(KINDS))]
    return model, [best if tried else max(best, 0.9) for best, tried in told]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def text_of(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)

    for batch in batches:
        out = []
        for doc_id, exact, added in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "exact", "added")], strict=True):
            base = [(s["kind"], s["start"], s["end"]) for s in exact]
            taken: list[tuple[int, int, int]] = []
            for s in sorted(added or [], key=lambda s: (-s["p"], s["start"], s["kind"])):
                if not _overlaps(taken, s["start"], s["end"]):
                    taken.append((s["kind"], s["start"], s["end"]))
            counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
            out.append((doc_id, *counts, hashlib.sha256(text_of(base).encode()).hexdigest(), text_of(sorted(base + taken)), len(taken)))
        types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _RESULT.split(", ")])


_RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of every row of ``docs(doc_id, text)``; one pass over the texts, then only proposals move."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    proposed = stash(numbered.mapInArrow(_propose, _PROPOSED), "pii-proposals")
    fitted = fit(proposed)
    if fitted is None:
        added = proposed.select("row", "doc_id", "exact", F.lit(None).cast("array<struct<kind:int,start:int,end:int,p:double>>").alias("added"))
    else:
        model, thresholds = fitted
        wide = proposed.select("row", F.explode("wide").alias("w")).select("row", "w.*").withColumn("features", array_to_vector("x"))
        scored = model.transform(wide).withColumn("p", vector_to_array("probability")[1])
        good = scored.filter(F.col("p") >= F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("kind") + 1))
        per_row = good.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end", "p")).alias("added"))
        added = proposed.select("row", "doc_id", "exact").join(per_row, "row", "left")
    return added.select("doc_id", "exact", "added").mapInArrow(_finish, _RESULT)


def op10_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
