"""Line de-duplication by a segment-partition edit join. DataFrame functions only.

Two lines are linked if they are equal, or if both have ``LEAST_CHARS`` characters or more and their edit distance is
``EDITS`` at most. A line is split into ``EDITS + 1`` segments, one of which occurs unchanged in any line that near; the
other line probes the segment indexes of every length in reach with the substrings that the position of the edits
allows (multi-match-aware selection: twelve for two edits). A segment's key and the least and greatest line there are told
first; only lines under a key where two meet are looked at again. Pairs that meet are compared by letter counts, which two
edits move by four at most, and then by a banded bit-parallel edit distance.

Copies of a line are one line from the start (sums per line, map-side first). Segments that occur in very many lines are
split once more: what is left of the line beside the shared segment must itself be within the distance, so it is
partitioned and probed in the same way inside the segment's group. Lines are moved as hashes; only lines that have copies
or candidates move as text, picked out by a bitmap of fixed size before any shuffle.

Defined results: lines are the parts of a text between "\\n"; blank lines are left alone (not listed, never
removed); NULL texts have no lines; the first occurrence goes by (doc_id, line number, hash of the text), NULL id first;
repeated rows are occurrences of their own, so all but one are copies; an empty table gives an empty table; other columns
stay as they are. On removal a document is a pair of id and text: rows that share an id (or have none) lose lines each for
itself, of equal rows without an id one stays, and equal rows with an id are one document and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.common import is_empty, maybe_in, table
from replyloom.llm.components import components
from replyloom.session import stash

EDITS = 2
LEAST_CHARS = 24
#: Different lines with one segment at one place and of one length from which on they are partitioned again.
CROWDED = 512
#: Letters counted, eight to a number; random lines that share a segment differ in some of them.
LETTERS = "etanorislhducmpfgwybvk 1"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, print, line_no, line, id`` of all lines that are not blank; ``print`` is the text's hash."""
    parts = docs.select("doc_id", F.xxhash64("text").alias("print"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return parts.filter(F.col("line").rlike(NOT_BLANK)).withColumn("id", F.xxhash64("line"))


def _without(text: Column, start: Column, size: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), F.substring(text, start + size + 1, F.length(text)))


#: Every way to meet a segment: how much shorter the indexed line is, which segment, and its shift in the probing line.
#: With i segments before and EDITS - i behind, at most so many edits lie on either side, which bounds the shift.
PROBES = [
    (less, i, shift)
    for less in range(EDITS + 1)
    for i in range(EDITS + 1)
    for shift in range(max(-i, less - (EDITS - i)), min(i, less + (EDITS - i)) + 1)
]
#: The line's own segments are among them.
OWN = [(0, i, 0) for i in range(EDITS + 1)]


def entries(lines: DataFrame, text: str, ways: list[tuple[int, int, int]]) -> DataFrame:
    """One row per way: ``key``, and where the substring stands; ``lines`` has ``text``, its ``length`` and ``group``."""
    way = F.array(*[F.struct(F.lit(a).alias("less"), F.lit(b).alias("i"), F.lit(c).alias("shift")) for a, b, c in ways])
    rows = lines.select("*", F.explode(way).alias("w")).withColumn("indexed", F.col("length") - F.col("w.less"))
    start = F.expr(f"cast(floor(indexed * w.i / {EDITS + 1}) as int)")
    stop = F.expr(f"cast(floor(indexed * (w.i + 1) / {EDITS + 1}) as int)")
    rows = rows.withColumn("at", start + F.col("w.shift")).withColumn("size", stop - start)
    rows = rows.filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("length")))
    key = F.xxhash64("group", "indexed", "w.i", F.substring(F.col(text), F.col("at") + 1, F.col("size")))
    return rows.withColumn("key", key).withColumn("same_length", F.col("w.less") == 0)


def letter_counts(text: Column) -> Column:
    """Counts of the letters modulo 256, a byte each, in an array of longs."""
    size = F.octet_length(text)
    packed = []
    for k, letter in enumerate(LETTERS):
        count = F.shiftleft((size - F.octet_length(F.replace(text, F.lit(letter)))).cast("long") % 256, 8 * (k % 8))
        if k % 8:
            packed[-1] = packed[-1].bitwiseOR(count)
        else:
            packed.append(count)
    return F.array(*packed)


def _near_counts(a: str, b: str) -> Column:
    """Byte-wise differences, taken modulo 256 and summed, within two per edit."""
    terms = []
    for k in range(len(LETTERS)):
        x, y = (f"(shiftrightunsigned({c}[{k // 8}], {8 * (k % 8)}) & 255)" for c in (a, b))
        terms.append(f"least(pmod({x} - {y}, 256), pmod({y} - {x}, 256))")
    return F.expr(" + ".join(terms) + f" <= {2 * EDITS}")


def banded_distance(a: str, b: str) -> Column:
    """Edit distance of two array columns of characters, exact up to ``EDITS``, by bit-parallel steps over a band.

    ``a`` has ``EDITS`` characters at least, and the sizes differ by ``EDITS`` at most.

    Bit k of a step stands for row j - EDITS + k of the distance table; the band moves down one row with each column. The
    distance is followed along the lower edge of the band, where it never falls, to the last row, then along that row, where
    it can fall by twice the band at most; so beyond three times ``EDITS`` the rest is not computed.
    """
    t, w = EDITS, 2 * EDITS + 1
    mask = (1 << w) - 1
    match = " | ".join(f"shiftleft(cast(coalesce(get({a}, j - 1 - {t} + {k}) = get({b}, j - 1), false) as bigint), {k})" for k in range(w))
    step = f"""
        transform(array(struct({match} as pm)), p -> transform(array(struct(
            ((((p.pm & s.vp) + s.vp) ^ s.vp) | p.pm | s.vn) & {mask}L as d0)), d -> transform(array(struct(
                (s.vn | ~(d.d0 | s.vp)) & {mask}L as hp, d.d0 & s.vp as hn)), h -> named_struct(
                    'vp', (h.hn | ~(shiftright(d.d0, 1) | h.hp)) & {mask}L,
                    'vn', shiftright(d.d0, 1) & h.hp,
                    'dist', s.dist + cast(case when j + {t} <= size({a}) then 1L - (shiftright(d.d0, {w - 1}) & 1L)
                        else (shiftrightunsigned(h.hp, greatest(0, size({a}) - j + {t})) & 1L) - (shiftrightunsigned(h.hn, greatest(0, size({a}) - j + {t})) & 1L) end as bigint)
                ))[0])[0])[0]
    """
    start = ((1 << (t + 1)) - 1) << t
    return F.expr(f"""aggregate(case when size({b}) > 0 then sequence(1, size({b})) else array() end,
        named_struct('vp', {start}L, 'vn', 0L, 'dist', {t}L), (s, j) -> case when s.dist > {3 * t}L then s else {step} end, s -> s.dist)""")


def _paired(index: DataFrame, probe: DataFrame) -> DataFrame:
    met = index.join(probe.withColumnsRenamed({"id": "b", "counts": "b_counts"}), "key")
    met = met.filter((F.col("id") != F.col("b")) & (~F.col("same_length") | (F.col("id") < F.col("b"))) & _near_counts("counts", "b_counts"))
    return met.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))


def met_keys(lines: DataFrame) -> DataFrame:
    """``key, n_own`` of the segments under which different lines of ``lines(id, line, length, group)`` meet, with the number of lines that have it as their own."""
    own = (F.col("w.less") == 0) & (F.col("w.shift") == 0)
    told = entries(lines, "line", PROBES).select("key", "id", own.alias("own")).groupBy("key")
    found = told.agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count_if("own").alias("n_own"))
    return found.filter("least <> most and n_own > 0").select("key", "n_own")


def candidates(lines: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of ids of the different ``lines(id, line)`` that share a segment and have letter counts in reach; some more than once."""
    grouped = lines.withColumn("length", F.length("line")).withColumn("group", F.lit(0).cast("long"))
    keys = stash(met_keys(grouped), "lines-keys")
    crowded = F.col("n_own") > CROWDED
    here = maybe_in(entries(grouped, "line", PROBES), "key", keys, "key", "hit").filter("hit").join(keys, "key")
    met = stash(
        here.select(
            "key", "id", "same_length", letter_counts(F.col("line")).alias("counts"),
            (F.col("same_length") & (F.col("w.shift") == 0)).alias("own"),
            F.when(crowded, _without(F.col("line"), F.col("at"), F.col("size"))).alias("rest"),
        ),
        "lines-met",
    )
    wide = met.filter("rest is null")
    pairs = _paired(wide.filter("own").select("key", "id", "counts"), wide.select("key", "id", "counts", "same_length"))
    if is_empty(keys.filter(crowded)):
        return pairs
    # inside a crowded segment's group, the rest of the line is partitioned and probed again
    rest = lambda df: df.select("id", "counts", F.col("key").alias("group"), "rest").distinct().withColumn("length", F.length("rest"))
    close = met.filter("rest is not null")
    again = _paired(
        entries(rest(close.filter("own")), "rest", OWN).select("key", "id", "counts").distinct(),
        entries(rest(close), "rest", PROBES).select("key", "id", "counts", "same_length").distinct(),
    )
    return pairs.unionByName(again)


def line_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and links: ``id, doc_id, line_no, n_copies`` of each different line's first occurrence, with the ``print`` of its text; pairs ``a, b`` of ids."""
    lines = lines_of(docs)
    facts = stash(
        lines.groupBy("id").agg(F.min(F.struct("doc_id", "line_no", "print")).alias("first"), F.count("*").alias("n_copies")).select("id", "first.*", "n_copies"),
        "lines",
    )
    long = lines.filter(F.length("line") >= LEAST_CHARS).select("id", "line")
    told = maybe_in(long, "id", facts.filter("n_copies > 1"), "id", "copied")
    single = told.filter(~F.col("copied")).select("id", "line")
    copied = stash(told.filter("copied").groupBy("id").agg(F.any_value("line").alias("line")), "lines-copied")
    pairs = candidates(single.unionByName(copied))
    pairs = stash(pairs.distinct(), "lines-pairs")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    picked = maybe_in(long, "id", wanted, "id", "hit").filter("hit").groupBy("id").agg(F.any_value("line").alias("line"))
    chars = stash(picked.join(wanted, "id", "left_semi").select("id", F.split("line", "").alias("chars")), "lines-chars")
    both = pairs.join(chars.withColumnsRenamed({"id": "a", "chars": "x"}), "a").join(chars.withColumnsRenamed({"id": "b", "chars": "y"}), "b")
    near = both.filter((F.abs(F.size("x") - F.size("y")) <= EDITS) & (banded_distance("x", "y") <= EDITS))
    return facts, stash(near.select("a", "b"), "lines-links")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per different line: first occurrence, copies, links to other lines, and its class's first occurrence.

    ``doc_id, line_no, n_copies, n_links, class_doc_id, class_line_no, kept, id, print``; a line is kept if it is its class's
    first, and then only in its first occurrence, which is in a text of hash ``print``.
    """
    facts, links = line_classes(docs)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    named = facts.join(degree, "id", "left").join(components(links), "id", "left")
    named = named.withColumn("component", F.coalesce("component", "id"))
    place = F.struct("doc_id", "line_no", "print")
    least = named.filter("n_links > 0").groupBy("component").agg(F.min(place).alias("least"))
    out = named.join(least, "component", "left").withColumn("least", F.coalesce("least", place))
    return out.select(
        "doc_id", "line_no", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("least.doc_id").alias("class_doc_id"), F.col("least.line_no").alias("class_line_no"),
        (place == F.col("least")).alias("kept"), "id", "print",
    )


def _one_without_id(docs: DataFrame) -> DataFrame:
    """``docs``, with ``__print``, less all but one of the rows that have equal texts and no id: every line of these is a copy."""
    printed = docs.withColumn("__print", F.xxhash64("text"))
    nameless = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(NOT_BLANK), F.lit(False))
    again = stash(printed.filter(nameless).groupBy("__print").count().filter("count > 1").select(F.col("__print").alias("__again")), "lines-nameless")
    if is_empty(again):
        return printed
    told = maybe_in(printed, "__print", again, "__again", "__hit").withColumn("__hit", F.col("__hit") & nameless)
    return told.filter(~F.col("__hit")).drop("__hit").unionByName(told.filter("__hit").drop("__hit").dropDuplicates(["__print"]))


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with every line class left only in its first occurrence.

    A text left without any line goes as a whole; ``n_chars``, if there, follows the text. Only texts that may lose a line
    are moved.
    """
    first = {"doc_id": "first_id", "line_no": "first_no", "print": "first_print"}
    classes = stash(dedup_lines(docs).filter((F.col("n_copies") > 1) | ~F.col("kept")).withColumnsRenamed(first), "lines-repeated")
    here = maybe_in(lines_of(docs), "id", classes, "id", "hit").filter("hit").select("doc_id", "print", "line_no", "id")
    stays = F.col("kept") & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("line_no") == F.col("first_no")) & (F.col("print") == F.col("first_print"))
    gone = here.join(classes.select("id", "kept", *first.values()), "id").filter(~stays)
    words = gone.groupBy("doc_id", "print", F.shiftright("line_no", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, line_no & 63)")).alias("bits"))
    marks = words.groupBy("doc_id", "print").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("__gone"))
    marks = stash(marks.withColumnsRenamed({"doc_id": "__id", "print": "__key"}), "lines-gone")
    told = maybe_in(_one_without_id(docs), "__print", marks, "__key", "__hit")
    same = told.filter(~F.col("__hit")).select(*docs.columns)
    cut = told.filter("__hit").join(marks, (F.col("__print") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    kept = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> (shiftrightunsigned(coalesce(__gone[cast(floor(i / 64) as int)], 0L), cast(i % 64 as int)) & 1) = 0), '\\n')")
    cut = cut.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept))
    cut = cut.filter(F.col("__gone").isNull() | F.col("text").rlike(NOT_BLANK))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return same.unionByName(cut.select(*docs.columns))


def op2_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).drop("id", "print")
