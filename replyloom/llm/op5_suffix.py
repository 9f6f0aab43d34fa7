"""Suffix-array removal of repeated passages: collection BWT and common prefixes built column by column.

A byte is removed if a passage of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.

Passages are dealt out by content: each belongs to its smallest ``ANCHOR``-byte substring (by hash, leftmost), and the
passages of a document that follow each other and share that substring form one string of at most
``2 * LENGTH - ANCHOR`` bytes. Equal passages thus meet in one bucket, whatever surrounds them. Of equal strings only the
smallest document's goes on, in each slice of texts before anything is moved and in each bucket again: in the other
documents all of their passages are repeated. So a passage in every document costs one string per slice.

Before any text is dealt out, the anchors alone are: 32 bits each, once per slice, come to the anchor's bucket, which answers
which of them occur in more than one document. Strings whose anchor is in one document only stay where they are.

In a bucket, the different strings around one anchor form a collection. Strings are cut to the stretch of their passages whose
hash occurs again (the others hold nothing that is repeated), and its suffixes are sorted by column-wise
construction: round j inserts for every string its suffix of length j, at the place that the symbols inserted before
give (the number of smaller symbols, and of equal ones further up). The Burrows-Wheeler transform, the common prefixes
and the suffix names are sequential files that each round reads once and writes once. Suffixes with a common prefix of
``LENGTH`` or more are equal passages; the smallest document among them keeps its own.

Defined results: NULL text is empty; a NULL id counts as smaller than all others; rows with equal ids do not remove from
each other; texts shorter than ``LENGTH`` keep all; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.common import maybe_in, packed, slices, table, text_bytes, unpacked
from replyloom.llm.words import mixed, powers, prefix_sums, spans
from replyloom.session import stash

LENGTH = 50
ANCHOR = 16
SLICE = 1 << 20
BUCKET_BYTES = 12 << 20
#: Longer texts are cut into parts of so many bytes that overlap by a passage less one byte.
PART = 1 << 20
#: Symbols of one collection; whole anchors only.
COLLECTION = 4 << 20
_LOWEST = -(2**63)
_POSITION = np.uint64((1 << 24) - 1)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    done, now = 1, x
    while done * 2 <= width:
        now = np.minimum(now[:-done], now[done:])
        done *= 2
    rest = width - done
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def anchored_strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """All passages as strings around their anchors: part, start, end, anchor's offset in the string, anchor's hash.

    Parts are taken so many at a time that a position fits beside the hash's upper bits.
    """
    out = []
    begin = 0
    while begin < len(offsets) - 1:
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + int(_POSITION), side="right")) - 1)
        base = offsets[begin]
        owner, start, end, anchor_at, anchor = _anchored(data[base : offsets[stop]], offsets[begin : stop + 1] - base)
        out.append((owner + begin, start + base, end + base, anchor_at, anchor))
        begin = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _anchored(data, offsets)


def _anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(np.uint64)
    sums = prefix_sums(data, fold=False)
    n = len(data) - ANCHOR + 1
    anchors = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * powers(n)[1])
    least = _sliding_least((anchors & ~_POSITION) | np.arange(n, dtype=np.uint64), LENGTH - ANCHOR + 1)
    # a string begins where the anchor changes or a text begins, and ends before the next one or with its text
    sizes = np.diff(offsets)
    texts = np.flatnonzero(sizes >= LENGTH)
    begins = np.zeros(len(least), bool)
    begins[1:] = least[1:] != least[:-1]
    for a in offsets[1:-1]:
        begins[max(0, a - LENGTH + 1) : a] = False
    begins[offsets[texts]] = True
    start = np.flatnonzero(begins)
    owner = np.searchsorted(offsets, start, side="right") - 1
    end = np.minimum(np.append(start[1:], len(data)) + LENGTH - 1, offsets[owner + 1])
    picked = (least[start] & _POSITION).astype(np.int64)
    return owner, start, end, picked - start, anchors[picked]


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _least_owner(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For equal codes: index of the first of the smallest id, each row's group, the group's smallest id."""
    order = np.lexsort((ids, codes))
    fresh = np.concatenate([[True], codes[order][1:] != codes[order][:-1]]) if len(order) else np.zeros(0, bool)
    group = np.empty(len(codes), np.int64)
    group[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    return first, group, ids[first]


def _equal_runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal values; none where there are no values."""
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True)) if len(values) else []


def _parts(part: pa.RecordBatch) -> tuple:
    """Bytes and offsets of a slice's texts, long ones in parts; each part's row and place in its text."""
    data, offsets = text_bytes(part.column("text"))
    rows, bases, cuts = [], [], []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for base in range(0, max(1, b - a - LENGTH + 1), PART - LENGTH + 1):
            rows.append(k), bases.append(base), cuts.append((a + base, min(a + base + PART, b)))
    if len(rows) > part.num_rows:
        data = np.concatenate([data[a:b] for a, b in cuts])
        offsets = np.concatenate([[0], np.cumsum([b - a for a, b in cuts])])
    ids = part.column("doc_id").to_pylist()
    id_of = np.array([_LOWEST if ids[k] is None else ids[k] for k in rows], np.int64)
    return data, offsets, np.array(rows), np.array(bases, np.int64), ids, part.column("print").to_pylist(), id_of


def _bucket(anchor: np.ndarray, n_buckets: int) -> np.ndarray:
    return (anchor >> np.uint64(32)) % np.uint64(n_buckets)


def _print(anchor: np.ndarray) -> np.ndarray:
    return anchor.astype(np.uint32)


def _by_bucket(bucket: np.ndarray, n_buckets: int):
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
    return [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _dealt(out: list, chunk: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in out], pa.int32()), pa.array([chunk] * len(out), pa.string()), pa.array([v for _, v in out], pa.binary())],
        names=["bucket", "chunk", "value"],
    )


def _deal_anchors(n_buckets: int):
    """Each anchor of a slice once, to its bucket; those in several documents of the slice are known to be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            data, offsets, rows, _, ids, prints, _ = _parts(part)
            owner, _, _, _, anchor = anchored_strings(data, offsets)
            row = rows[owner]
            order = np.lexsort((row, anchor))
            anchor, row = anchor[order], row[order]
            fresh = np.ones(len(anchor), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
            anchor, row = anchor[fresh], row[fresh]
            first = np.ones(len(anchor), bool)
            first[1:] = anchor[1:] != anchor[:-1]
            group = np.cumsum(first) - 1
            known = np.bincount(group, minlength=1)[group] > 1 if len(group) else first
            chunk = uuid.uuid4().hex
            home = int(chunk[:8], 16) % n_buckets
            sent_anchor, sent_row = anchor[first], row[first]
            out = []
            for b, mine in enumerate(_by_bucket(_bucket(sent_anchor, n_buckets), n_buckets)):
                prints_here = _print(sent_anchor[mine])
                by_print = np.argsort(prints_here, kind="stable")
                value = dict(steps=np.diff(prints_here[by_print], prepend=np.uint32(0)), row=sent_row[mine][by_print].astype(np.int32))
                if b == home:
                    value |= dict(row_ids=ids, prints=prints, known_row=row[known].astype(np.int32), known=_print(anchor[known]))
                if len(mine) or b == home:
                    out.append((b, packed(**value)))
            yield _dealt(out, chunk)

    return run


def _shared_anchors(group: pa.Table) -> pa.Table:
    """The anchors of one bucket that several slices have, per slice."""
    chunks = group.column("chunk").to_pylist()
    values = [unpacked(v.as_py()) for v in group.column("value")]
    prints = [np.cumsum(v["steps"], dtype=np.uint32) for v in values]
    every = np.sort(np.concatenate(prints))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out_chunk, out_value = [], []
    for chunk, v, mine in zip(chunks, values, prints, strict=True):
        at = np.minimum(np.searchsorted(twice, mine), max(0, len(twice) - 1))
        hit = twice[at] == mine if len(twice) else np.zeros(len(mine), bool)
        row, shared = v["row"][hit], mine[hit]
        extra = {}
        if "row_ids" in v:
            extra = {k: v[k] for k in ("row_ids", "prints")}
            row, shared = np.concatenate([row, v["known_row"]]), np.concatenate([shared, v["known"]])
        if len(row) or extra:
            out_chunk.append(chunk), out_value.append(packed(row=row, shared=shared, **extra))
    return pa.table({"chunk": pa.array(out_chunk, pa.string()), "value": pa.array(out_value, pa.binary())})


def _shared_per_text(group: pa.Table) -> pa.Table:
    values = [unpacked(v.as_py()) for v in group.column("value")]
    home = next(v for v in values if "row_ids" in v)
    row, shared = np.concatenate([v["row"] for v in values]), np.concatenate([v["shared"] for v in values])
    order = np.argsort(row, kind="stable")
    row, shared = row[order], shared[order]
    parts = [(int(row[a]), shared[a:b].tobytes()) for a, b in _equal_runs(row)]
    return pa.table(
        {
            "doc_id": pa.array([home["row_ids"][r] for r, _ in parts], pa.int64()),
            "print": pa.array([home["prints"][r] for r, _ in parts], pa.int64()),
            "shared": pa.array([x for _, x in parts], pa.binary()),
        }
    )


def _deal(n_buckets: int):
    """Strings around shared anchors, each slice's different ones once, to the anchors' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            data, offsets, rows, bases, ids, prints, id_of = _parts(part)
            owner, start, end, anchor_at, anchor = anchored_strings(data, offsets)
            shared = [np.frombuffer(b"".join(x), np.uint32) for x in part.column("shared").to_pylist()]
            shared = np.unique(np.concatenate([x.astype(np.uint64) | np.uint64(k << 32) for k, x in enumerate(shared)]))
            mark = _print(anchor).astype(np.uint64) | (rows[owner].astype(np.uint64) << np.uint64(32))
            keep = shared[np.minimum(np.searchsorted(shared, mark), max(0, len(shared) - 1))] == mark if len(shared) else np.zeros(len(mark), bool)
            owner, start, end, anchor_at, anchor = (x[keep] for x in (owner, start, end, anchor_at, anchor))
            text_code = spans(prefix_sums(data, fold=False), start, end) if len(start) else anchor
            first, group, least = _least_owner(text_code, id_of[owner])
            covered = id_of[owner] > least[group]
            start_in_part = start - offsets[owner]
            is_first = np.zeros(len(owner), bool)
            is_first[first] = True
            chunk = uuid.uuid4().hex
            home = int(chunk[:8], 16) % n_buckets
            number = np.full(len(first), -1, np.int64)
            out = []
            for b, mine in enumerate(_by_bucket(_bucket(anchor, n_buckets), n_buckets)):
                if not len(mine) and b != home:
                    continue
                gone, kept, sent = mine[covered[mine]], mine[~covered[mine]], mine[is_first[mine]]
                number[group[sent]] = np.arange(len(sent))
                sizes = (end - start)[sent]
                value = dict(
                    ids=id_of, owner=owner[sent].astype(np.int32), size=sizes.astype(np.uint8), anchor_at=anchor_at[sent].astype(np.uint8),
                    text=_gathered(data, start[sent], sizes), at_string=number[group[kept]].astype(np.int32), at_part=owner[kept].astype(np.int32),
                    at_start=start_in_part[kept].astype(np.int32), gone_part=owner[gone].astype(np.int32),
                    gone_start=start_in_part[gone].astype(np.int32), gone_size=(end - start)[gone].astype(np.uint8),
                )
                if b == home:
                    value |= dict(row_ids=ids, prints=prints, rows=rows, bases=bases)
                out.append((b, packed(**value)))
            yield _dealt(out, chunk)

    return run


class _SequentialFiles:
    """The growing columns of a collection; every round reads each file from front to back and writes it anew.

    Files only grow, so they stay open and are written over in place; cutting them first would force them to disk.
    """

    def __init__(self, folder: str, **columns: np.ndarray):
        self.kinds = {n: x.dtype for n, x in columns.items()}
        self.files = {n: open(os.path.join(folder, n), "w+b", buffering=0) for n in columns}
        for name, x in columns.items():
            self.write(name, x)

    def read(self, name: str) -> np.ndarray:
        self.files[name].seek(0)
        return np.frombuffer(self.files[name].read(), self.kinds[name])

    def write(self, name: str, x: np.ndarray) -> None:
        self.files[name].seek(0)
        rest = memoryview(np.ascontiguousarray(x)).cast("B")
        while len(rest):
            rest = rest[self.files[name].write(rest) :]

    def merge(self, name: str, keep: np.ndarray, places: np.ndarray, values) -> np.ndarray:
        """The column with ``values`` put in at ``places``."""
        new = np.empty(len(keep), self.kinds[name])
        new[keep] = self.read(name)
        new[places] = values
        return new

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high + 1]) for many ranges at once, from minima over powers of two."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    now, width = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(now[low[mine]], now[high[mine] - width + 1])
        if len(now) > width:
            now = np.minimum(now[:-width], now[width:])
        width *= 2
    return out


def column_wise(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of a string collection in order: string, suffix length, common prefix with the suffix before.

    ``text`` holds the strings behind each other as 16-bit symbols above 0; 0 stands for "begins here". A string's end is
    smaller than any symbol, and ends are in string order.
    """
    n = len(sizes)
    ends = np.cumsum(sizes)
    longest = int(sizes.max(initial=0))
    with tempfile.TemporaryDirectory() as folder:
        last = np.where(sizes > 0, text[np.maximum(ends - 1, 0)], 0).astype(np.uint16)
        files = _SequentialFiles(
            folder, bwt=last, lcp=np.zeros(n, np.uint8), string=np.arange(n, dtype=np.int32), length=np.zeros(n, np.uint8)
        )
        place = np.arange(n)
        for j in range(1, longest + 1):
            active = np.flatnonzero(sizes >= j)
            bwt, lcp = files.read("bwt"), files.read("lcp")
            at = np.flatnonzero(bwt)
            by_symbol = at[np.argsort(bwt[at], kind="stable")]
            rank = np.empty(len(bwt), np.int64)
            rank[by_symbol] = np.arange(len(by_symbol))
            new = rank[place[active]]
            keep = np.ones(n + len(by_symbol), bool)
            keep[n + new] = False
            touched = np.unique(np.concatenate([new, new[new + 1 < len(by_symbol)] + 1]))
            symbol = bwt[by_symbol]
            joined = touched[(touched > 0) & (symbol[touched] == symbol[np.maximum(touched, 1) - 1])]
            common = np.zeros(n + len(by_symbol), np.uint8)
            common[n + joined] = np.minimum(254, _range_least(lcp, by_symbol[joined - 1] + 1, by_symbol[joined])) + 1
            left = ends[active] - j - 1
            before = np.where(sizes[active] > j, text[np.maximum(left, 0)], 0)
            prefixes = files.merge("lcp", keep, n + new, 0)
            prefixes[n + touched] = common[n + touched]
            files.write("lcp", prefixes)
            for name, values in (("bwt", before), ("string", active), ("length", j)):
                files.write(name, files.merge(name, keep, n + new, values))
            place[active] = n + new
            old = np.flatnonzero(sizes < j)
            if len(old):
                moved = np.flatnonzero(keep)
                place[old] = moved[place[old]]
        out = files.read("string"), files.read("length"), files.read("lcp")
        files.close()
        return out


def repeated_passages(text: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages (string, offset) that also start in a string of a smaller id."""
    string, length, lcp = column_wise(text.astype(np.uint16) + 1, sizes)
    group = np.cumsum(lcp < LENGTH)
    long = length >= LENGTH
    string, length, group = string[long], length[long].astype(np.int64), group[long]
    if not len(string):
        return string, length
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.repeat(np.minimum.reduceat(ids[string], edges), np.diff(np.append(edges, len(group))))
    again = ids[string] > least
    return string[again], sizes[string[again]] - length[again]


def _shared_stretches(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings with a passage whose hash occurs again in the collection, and where the first of these begins and the last ends.

    No passage outside these stretches is repeated, so only they need to be sorted.
    """
    per = np.maximum(sizes - LENGTH + 1, 0)
    string = np.repeat(np.arange(len(sizes)), per)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(per) - per, per)
    at = np.repeat(np.cumsum(sizes) - sizes, per) + offset
    code = spans(prefix_sums(text, fold=False), at, at + LENGTH)
    order = np.argsort(code)
    same = code[order][1:] == code[order][:-1]
    hit = np.zeros(len(code), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    hits = np.flatnonzero(hit)
    edges = np.array(_equal_runs(string[hits]), np.int64).reshape(-1, 2)
    return string[hits[edges[:, 0]]], offset[hits[edges[:, 0]]], offset[hits[edges[:, 1] - 1]] + LENGTH


def _settle(group: pa.Table) -> pa.Table:
    """One bucket: which passages of which parts go, packed per chunk of texts."""
    chunks = group.column("chunk").to_pylist()
    values = [unpacked(v.as_py()) for v in group.column("value")]
    codes, anchors, ids, sizes, texts = [], [], [], [], []
    for v in values:
        size = v["size"].astype(np.int64)
        ends = np.cumsum(size)
        sums = prefix_sums(v["text"], fold=False)
        codes.append(spans(sums, ends - size, ends)), sizes.append(size), texts.append(v["text"]), ids.append(v["ids"][v["owner"]])
        at = ends - size + v["anchor_at"]
        anchors.append(spans(sums, at, at + ANCHOR))
    code, anchor, owner, size = (np.concatenate(x) for x in (codes, anchors, ids, sizes))
    text = np.concatenate(texts)
    start = np.cumsum(size) - size
    first, same, least = _least_owner(code, owner)
    whole = owner > least[same]
    # strings that share their anchor with a different string
    order = np.argsort(anchor[first], kind="stable")
    sorted_anchor = anchor[first][order]
    fresh = np.concatenate([[True], sorted_anchor[1:] != sorted_anchor[:-1]]) if len(order) else np.zeros(0, bool)
    number = np.cumsum(fresh) - 1
    shared = np.bincount(number)[number] > 1 if len(order) else fresh
    members, number = first[order[shared]], number[shared]
    found_string, found_offset = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    begin = 0
    volume = np.cumsum(size[members])
    while begin < len(members):
        limit = (volume[begin - 1] if begin else 0) + COLLECTION
        stop = int(np.searchsorted(volume, limit, side="right"))
        stop = max(begin + 1, stop)
        if stop < len(members):
            whole_to = np.searchsorted(number, number[stop])
            stop = int(whole_to) if whole_to > begin else int(np.searchsorted(number, number[begin], side="right"))
        part = members[begin:stop]
        some, low, high = _shared_stretches(_gathered(text, start[part], size[part]), size[part])
        part = part[some]
        s, o = repeated_passages(_gathered(text, start[part] + low, high - low), high - low, least[same[part]])
        found_string.append(part[s]), found_offset.append(o + low[s])
        begin = stop
    hit, offset = np.concatenate(found_string), np.concatenate(found_offset)
    # a hit of a group's first string holds for all of the group's remaining owners, which have the same id
    by_group = np.argsort(same[hit], kind="stable")
    hit_group, hit_offset = same[hit][by_group], offset[by_group]
    out_chunk, out_value = [], []
    base = 0
    for chunk, v, n in zip(chunks, values, map(len, sizes), strict=True):
        string = base + v["at_string"]
        gone = whole[string] if len(string) else np.zeros(0, bool)
        low = np.searchsorted(hit_group, same[string], side="left")
        high = np.searchsorted(hit_group, same[string], side="right")
        some = np.flatnonzero(~gone & (high > low))
        times = (high - low)[some]
        which = np.repeat(some, times)
        pick = np.repeat(low[some] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        part = np.concatenate([v["gone_part"], v["at_part"][gone], v["at_part"][which]])
        begins = np.concatenate([v["gone_start"], v["at_start"][gone], v["at_start"][which] + hit_offset[pick]])
        length = np.concatenate([v["gone_size"].astype(np.int64), size[string[gone]], np.full(len(which), LENGTH)])
        extra = {k: v[k] for k in ("row_ids", "prints", "rows", "bases") if k in v}
        if len(part) or extra:
            order = np.lexsort((begins, part))
            out_chunk.append(chunk)
            out_value.append(packed(part=part[order].astype(np.int32), start=begins[order].astype(np.int32), size=length[order].astype(np.uint8), **extra))
        base += n
    return pa.table({"chunk": pa.array(out_chunk, pa.string()), "value": pa.array(out_value, pa.binary())})


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[fresh], ends[np.append(np.flatnonzero(fresh)[1:], len(ends)) - 1]


def _per_text(group: pa.Table) -> pa.Table:
    """The removed spans of one chunk's texts."""
    values = [unpacked(v.as_py()) for v in group.column("value")]
    home = next(v for v in values if "rows" in v)
    part, start, size = (np.concatenate([v[k] for v in values]).astype(np.int64) for k in ("part", "start", "size"))
    row, begin = home["rows"][part], start + home["bases"][part]
    order = np.argsort(row, kind="stable")
    row, begin, size = row[order], begin[order], size[order]
    out: dict[str, list] = {"doc_id": [], "print": [], "starts": [], "ends": []}
    for a, b in _equal_runs(row):
        s, e = merged_spans(begin[a:b], begin[a:b] + size[a:b])
        out["doc_id"].append(home["row_ids"][row[a]]), out["print"].append(home["prints"][row[a]])
        out["starts"].append(s.tolist()), out["ends"].append(e.tolist())
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print"))


def _joined(marked: DataFrame, facts: DataFrame) -> DataFrame:
    right = facts.withColumnsRenamed({"doc_id": "_id", "print": "_print"})
    return marked.join(right, (F.col("print") == F.col("_print")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id", "_print")


def removed_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, print, starts, ends`` (byte spans to remove) of the rows of ``docs(doc_id, text)`` that lose any."""
    marked = _marked(docs)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, -(-n_bytes // BUCKET_BYTES))
    dealt, packed_rows = "bucket int, chunk string, value binary", "chunk string, value binary"
    anchors = marked.mapInArrow(_deal_anchors(n_buckets), dealt).groupBy("bucket").applyInArrow(_shared_anchors, packed_rows)
    shared = anchors.groupBy("chunk").applyInArrow(_shared_per_text, "doc_id long, print long, shared binary")
    # equal rows, and the parts of very long texts, may come from several slices
    shared = stash(shared.groupBy("doc_id", "print").agg(F.collect_list("shared").alias("shared")), "suffix-anchors")
    sharing = maybe_in(marked, "print", shared, "print", "hit").filter("hit").drop("hit")
    strings = _joined(sharing, shared).filter("shared is not null").select("doc_id", "text", "print", "shared")
    settled = strings.mapInArrow(_deal(n_buckets), dealt).groupBy("bucket").applyInArrow(_settle, packed_rows)
    found = settled.groupBy("chunk").applyInArrow(_per_text, "doc_id long, print long, starts array<long>, ends array<long>")
    merged = found.groupBy("doc_id", "print").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    return stash(merged, "suffix-spans")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        out = []
        for doc_id, text, starts, ends in zip(*[part.column(c).to_pylist() for c in ("doc_id", "text", "starts", "ends")], strict=True):
            raw = (text or "").encode()
            removed = spans_n = 0
            if starts:
                s, e = merged_spans(np.array(starts), np.array(ends))
                removed, spans_n = int((e - s).sum()), len(s)
                kept = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True))
            else:
                kept = raw
            out.append((doc_id, len(raw), removed, spans_n, hashlib.sha256(kept).hexdigest(), kept))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row of ``docs(doc_id, text)``."""
    found = removed_spans(docs)
    told = maybe_in(_marked(docs), "print", found, "print", "hit")
    none = F.lit(None).cast("array<long>")
    whole = told.filter(~F.col("hit")).select("doc_id", "text", none.alias("starts"), none.alias("ends"))
    cut = _joined(told.filter("hit"), found).select("doc_id", "text", "starts", "ends")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return whole.unionByName(cut).mapInArrow(_cut, schema)


def op5_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
