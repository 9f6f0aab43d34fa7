"""Benchmark decontamination by pigeonhole edit matching.

Documents and items are compared as lower-cased letters and digits with single blanks between words. An item of m
characters may differ by m // ``CHARS_PER_EDIT`` edits anywhere in a document. It is split into budget-plus-one pieces, one of
which must occur unchanged; all pieces are searched at once, and where one hits, Myers' bit-parallel distance checks the
whole item around it, with both ends of the text free.

Items are taken in blocks of bounded size: each block's pieces go to the executors, and all documents are searched
against the block. Documents are never moved, so no item, however often it leaked, makes a hot task.

Defined results: NULL or empty texts and items match nothing (items without a letter or digit neither); NULL ids are
reported as they are; repeated rows of either table are one each, equal pairs are reported once per document row; empty
tables give an empty table; other columns are ignored. Texts are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.common import Appended, table, without

CHARS_PER_EDIT = 16
#: Characters of the items of one block; a single longer item is a block of its own.
BLOCK_CHARS = 1_000_000

_GAP = re.compile(r"[\W_]+")
_FOUND = "doc_id long, print long, item_id long, edits int, start long, end long"


def normal(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def pieces(item: str) -> list[tuple[int, str]]:
    """The item's budget-plus-one pieces of nearly equal length with their places."""
    n = len(item) // CHARS_PER_EDIT + 1
    cuts = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def pattern_bits(item: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for k, c in enumerate(item):
        bits[c] = bits.get(c, 0) | 1 << k
    return bits


def myers(bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any substring of ``text``, and the first end where it is reached."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for k, c in enumerate(text):
        eq = bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, k + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = items
        self.bits: dict[int, dict[str, int]] = {}
        self.search = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(items):
            for at, piece in pieces(item):
                places.setdefault(piece, []).append((k, at))
        for piece, where in places.items():
            self.search.add_word(piece, (len(piece), where))
        if places:
            self.search.make_automaton()
        self.any = bool(places)

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """By item: the least edits within its budget, and start and end of the text around the match."""
        found: dict[int, tuple[int, int, int]] = {}
        if not self.any or not text:
            return found
        covered: dict[int, tuple[int, int]] = {}
        for last, (size, where) in self.search.iter(text):
            for k, at in where:
                item = self.items[k][1]
                m, budget = len(item), len(item) // CHARS_PER_EDIT
                begin = last + 1 - size - at
                # one check answers for all starts in the next m characters; an exact match can't be bettered
                low, high = covered.get(k, (0, -1))
                if low <= begin <= high or k in found and not found[k][0]:
                    continue
                covered[k] = (begin, begin + m)
                low = max(0, begin - budget)
                if text.startswith(item, max(0, begin)):
                    best, end = 0, max(0, begin) + m - low
                else:
                    bits = self.bits.get(k) or self.bits.setdefault(k, pattern_bits(item))
                    best, end = myers(bits, m, text[low : begin + 2 * m + budget])
                if best <= budget and (k not in found or best < found[k][0]):
                    found[k] = (best, max(0, low + end - m), low + end)
        return found


def _searcher(sent):
    matcher: list[Matcher] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not matcher:
            matcher.append(Matcher(sent.value))
        one = matcher[0]
        for batch in batches:
            rows = []
            for doc_id, code, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "print", "text")], strict=True):
                for k, (edits, start, end) in one.find(normal(text)).items():
                    rows.append((doc_id, code, one.items[k][0], edits, start, end))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks; the driver holds one block at a time."""
    block: list[tuple[int | None, str]] = []
    chars = 0
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct()
    for item_id, text in items.toLocalIterator():
        item = normal(text)
        if item:
            if block and chars + len(item) > BLOCK_CHARS:
                yield block
                block, chars = [], 0
            block.append((item_id, item))
            chars += len(item)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and item found in it: ``doc_id, print, item_id, edits, start, end``.

    ``print`` is xxhash64(text); ``start`` and ``end`` count characters of the normalised text, ``end`` being exact.
    """
    spark = docs.sparkSession
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text")
    found = Appended(spark, "leaks", _FOUND)
    for block in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)
        found.add(marked.mapInArrow(_searcher(sent), _FOUND))
        sent.unpersist()
    return found.read()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which an item is found."""
    return without(docs, contaminated(docs, benchmark).select("doc_id", "print"))


def op1_pigeonhole_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "edits", "start", "end")
