"""Merkle manifest of a dataset with incremental witnesses.

Every row is a leaf. A source's leaves, ascending by ``doc_id``, form a tree of runs of ``FANOUT``; the sources' roots,
ascending by source, form one more tree of the same kind, whose root names the whole dataset.

A tree is built by aligned appends. Leaves get their place in the tree from a range sort and the counts of the ranges
before theirs, and go in blocks of ``FANOUT ** STEP`` consecutive places, so that a source with a third of all rows is
many blocks of one size. A task reads its blocks in order and appends each node to a frontier, which holds one open run
per level. An appended node starts with an empty witness; when a run completes, each node in it hands the witnesses
below it the digests of its siblings, and its parent is appended one level up. A block's root is a further append
to the next, ``STEP`` levels higher round of the same kind, until each tree has one node.

Witnesses are extended the same way: the round that appended the block roots returns each root's witness up to the root
of the dataset, which goes back to that block's task once and extends the witnesses of all its leaves. So no leaf's
witness is moved, only one per block.

Defined results: NULL is written ``-`` in a leaf; a NULL id comes first in its source, counts as an empty text for
crc32; a NULL source is a source of its own, before all others; rows of one source and id are ordered by leaf, so equal
rows have equal leaves at neighbouring places, each with the witness of its own place; a source of one row has that leaf as its root; an
empty table has no rows and no root; texts of any length are hashed by Spark's ``sha2`` in one piece; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from replyloom.llm.common import crc, table
from replyloom.session import stash

FANOUT = 16
#: Levels that one round adds; a block has ``FANOUT ** STEP`` nodes at most.
STEP = 3
#: Rows of one Arrow batch returned to Spark.
ROWS = 500
_WITNESS = "array<struct<left:string,right:string>>"
_WITNESS_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def node_hash(*digests: str) -> str:
    """The digest of nodes or siblings: sha256 over their hex texts behind each other."""
    h = hashlib.sha256()
    for d in digests:
        h.update(d.encode())
    return h.hexdigest()


class Frontier:
    """A tree that grows by appends on its right edge, with one open run of nodes per level.

    ``witness[i]`` of the i-th node appended holds (left siblings, right siblings) for each level whose run is complete.
    Without ``witnesses`` only the root is found.
    """

    def __init__(self, levels: int, witnesses: bool):
        self.levels, self.witnesses = levels, witnesses
        self.open: list[list[tuple[str, list[int]]]] = [[] for _ in range(levels)]
        self.witness: list[list[tuple[str, str]]] = []
        self.appended = 0
        self.root = ""

    def append(self, digest: str) -> None:
        self.witness.append([])
        self._add(0, digest, [self.appended] if self.witnesses else [])
        self.appended += 1

    def close(self) -> str:
        """Completes the runs that stay short on the right edge; the root."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.root

    def _add(self, level: int, digest: str, below: list[int]) -> None:
        if level == self.levels:
            self.root = digest
            return
        self.open[level].append((digest, below))
        if len(self.open[level]) == FANOUT:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _ in run]
        for k, (_, below) in enumerate(run):
            if below:
                siblings = ("".join(digests[:k]), "".join(digests[k + 1 :]))
                for i in below:
                    self.witness[i].append(siblings)
        self._add(level + 1, node_hash(*digests), [i for _, below in run for i in below])


def proof_hash(witness: list[tuple[str, str]]) -> str:
    return node_hash(*[d for siblings in witness for d in siblings])


def folded(digest: str, witness: list[tuple[str, str]]) -> str:
    """The root that ``digest`` leads to with the siblings of ``witness``."""
    for left, right in witness:
        digest = node_hash(left, digest, right)
    return digest


def leaf_hash(*columns: Column) -> Column:
    """sha256 of the values, each as UTF-8 byte count, colon and value, or ``-``."""
    written = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*written), 256)


def _numbered(nodes: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``nodes(tree, ...)`` with ``place``, counted from 0 in ``order`` in each tree, and ``size``, the nodes of the tree; the largest size.

    A range's rows are numbered as they are sorted; a tree that goes through several ranges gets the counts of those before.
    """
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_seen", F.monotonically_increasing_id())
    rows = stash(ranged.withColumn("_range", F.shiftright("_seen", 33)), name)
    counts = rows.groupBy("tree", "_range").agg(F.count("*").alias("_n"), F.min("_seen").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shift = stash(counts.select("tree", "_range", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size")), f"{name}-shift")
    placed = rows.join(shift, ["tree", "_range"]).withColumn("place", F.col("_seen") + F.col("_shift")).drop("_seen", "_range", "_shift")
    return placed, shift.agg(F.max("size")).first()[0] or 0


def _height(size: int) -> int:
    levels = 0
    while size > 1:
        size, levels = -(-size // FANOUT), levels + 1
    return levels


def _blocks(nodes: DataFrame, step: int, *others: DataFrame) -> DataFrame:
    """Nodes, and rows of ``others`` first, dealt out by block and sorted by place in it."""
    keyed = nodes.withColumn("block", F.floor(F.col("place") / F.lit(FANOUT**step)).cast("long"))
    for other in others:
        keyed = keyed.unionByName(other.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)
    return keyed.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of one block after another."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["tree"], row["block"])
            if own != key and rows:
                yield key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield key, rows


def _roots(step: int):
    """One row per block: its root, by appends to a frontier of at most ``STEP`` levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["tree", "place", "size", "digest"])

        for (tree, block), rows in _batches(batches):
            size = rows[0]["size"]
            frontier = Frontier(min(step, _height(size)), witnesses=False)
            for row in rows:
                frontier.append(row["digest"].hex())
            out.append((tree, block, -(-size // FANOUT**step), bytes.fromhex(frontier.close())))
            if len(out) == ROWS:
                yield batch()
                out = []
        yield batch()

    return run


def _witnesses(step: int):
    """One row per node: its witness, extended by that of its block's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), rows in _batches(batches):
            above, nodes = [(w["left"], w["right"]) for w in rows[0]["witness"]], rows[1:]
            frontier = Frontier(min(step, _height(nodes[0]["size"])), witnesses=True)
            for row in nodes:
                frontier.append(row["digest"].hex())
            frontier.close()
            for a in range(0, len(nodes), 64):
                part = range(a, min(a + 64, len(nodes)))
                whole = [[{"left": x, "right": y} for x, y in (*frontier.witness[i], *above)] for i in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(part), pa.string()), pa.array([nodes[i]["place"] for i in part], pa.int64()), pa.array(whole, _WITNESS_ARROW)],
                    names=["tree", "block", "witness"],
                )

    return run


def _proofs(step: int):
    """One row per leaf: digest of its witness, and the root that the presented leaf leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
        for _, rows in _batches(batches):
            head, leaves = rows[0], rows[1:]
            above = [(w["left"], w["right"]) for w in head["witness"]]
            subroot, root = head["subroot"].hex(), head["root"].hex()
            frontier = Frontier(min(step, _height(leaves[0]["size"])), witnesses=True)
            for row in leaves:
                frontier.append(row["digest"].hex())
            frontier.close()
            for a in range(0, len(leaves), ROWS):
                out = []
                for i in range(a, min(a + ROWS, len(leaves))):
                    row, witness = leaves[i], [*frontier.witness[i], *above]
                    out.append((row["doc_id"], row["digest"].hex(), subroot, root, proof_hash(witness), folded((row["presented"] or row["digest"]).hex(), witness)))
                types = [pa.int64()] + [pa.string()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


class Tree:
    """Trees over ``nodes(tree, place, size, digest)``: rounds of appends upwards, then witnesses downwards."""

    def __init__(self, nodes: DataFrame, largest: int, step: int, name: str):
        self.rounds, self.step, self.name = [nodes], step, name
        while largest > 1:
            roots = _blocks(self.rounds[-1].select("tree", "place", "size", "digest"), step).mapInArrow(_roots(step), "tree string, place bigint, size bigint, digest binary")
            self.rounds.append(stash(roots, f"{name}-roots"))
            largest = -(-largest // FANOUT**step)

    def tops(self) -> DataFrame:
        """``tree, digest``: each tree's root."""
        return self.rounds[-1].select("tree", "digest")

    def block_witnesses(self, above: DataFrame) -> DataFrame:
        """``tree, block, witness`` for the blocks of the lowest round, if ``above(tree, witness)`` are those of the trees' roots."""
        now = above.select("tree", F.lit(0).cast("long").alias("block"), "witness")
        for nodes in reversed(self.rounds[1:-1] if len(self.rounds) > 1 else []):
            own = _blocks(nodes.select("tree", "place", "size", "digest"), self.step, now)
            now = stash(own.mapInArrow(_witnesses(self.step), f"tree string, block bigint, witness {_WITNESS}"), f"{self.name}-witnesses")
        return now


def manifest(rows: DataFrame, step: int = STEP) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for ``rows(doc_id, source, digest, presented)``.

    ``digest`` is the 32 bytes of the row's leaf, ``presented`` those of the leaf shown with its witness (NULL: the same).
    """
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source")).alias("tree")
    # written before the range sort, whose sampling would hash every text twice
    hashed = stash(rows.select(tree, F.col("doc_id").cast("long").alias("doc_id"), "digest", "presented"), "merkle-hashed")
    leaves, largest = _numbered(hashed, ["doc_id", "digest"], "merkle-leaves")
    per_source = Tree(leaves, largest, step, "merkle-source")
    subroots, n_sources = _numbered(per_source.tops().select(F.lit("all").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"], "merkle-subroots")
    whole = Tree(subroots, n_sources, step, "merkle-dataset")
    none = F.expr(f"cast(array() as {_WITNESS})")
    above = whole.block_witnesses(whole.tops().select("tree", none.alias("witness")))
    witnesses = _blocks(subroots.select("tree", "place", "size", "digest"), step, above).mapInArrow(_witnesses(step), f"tree string, block bigint, witness {_WITNESS}")
    root = whole.tops().select("tree", F.col("digest").alias("root"))  # one row
    facts = subroots.select("tree", F.col("source"), "place", F.col("digest").alias("subroot")).join(witnesses.withColumnRenamed("block", "place"), ["tree", "place"]).join(F.broadcast(root), "tree")
    facts = stash(facts.select(F.col("source").alias("tree"), "witness", "subroot", "root"), "merkle-above")
    heads = per_source.block_witnesses(facts.select("tree", "witness")).join(facts.select("tree", "subroot", "root"), "tree")
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    proofs = _blocks(leaves, step, heads).mapInArrow(_proofs(step), schema)
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_witness_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"]]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(crc(F.col("doc_id")) % 5 == 0, F.unhex(leaf_hash(*fields, lowered)))
    return manifest(docs.select("doc_id", "source", F.unhex(leaf_hash(*fields, docs["text"])).alias("digest"), tampered.alias("presented")))


def _levels_sql(nodes: str, out: str, levels: int) -> str:
    """CTEs that raise ``nodes(tree, place, digest)`` by runs until one is left; ``out``: digest, siblings and fold steps per level."""
    parts = [f"{out}_0 as (select *, count(*) over (partition by tree) as n from {nodes})"]
    for k in range(levels):
        parts.append(
            f"{out}_{k + 1} as (select tree, place // 16 as place, case when max(n) = 1 then max(digest) else sha256(string_agg(digest, '' order by place)) end as digest,"
            f" (max(n) + 15) // 16 as n from {out}_{k} group by tree, place // 16)"
        )
        parts.append(
            f"{out}_side_{k} as (select a.tree, a.place, coalesce(string_agg(b.digest, '' order by b.place) filter (b.place < a.place), '') as lo,"
            f" coalesce(string_agg(b.digest, '' order by b.place) filter (b.place > a.place), '') as hi, max(a.n) > 1 as used"
            f" from {out}_{k} a join {out}_{k} b on a.tree = b.tree and a.place // 16 = b.place // 16 group by a.tree, a.place)"
        )
    return ",\n".join(parts)


def _fold_sql(source: str, out: str, prefix: str, levels: int, place: str, tree: str) -> str:
    """CTEs that fold ``now`` of each row of ``source`` through the levels, gathering the siblings in ``proof``."""
    parts, before = [], source
    for k in range(levels):
        parts.append(
            f"{out}_{k} as (select s.* exclude (now, proof), case when t.used then sha256(t.lo || s.now || t.hi) else s.now end as now,"
            f" s.proof || case when t.used then t.lo || t.hi else '' end as proof from {before} s"
            f" join {prefix}_side_{k} t on t.tree = s.{tree} and t.place = s.{place} // {16**k})"
        )
        before = f"{out}_{k}"
    return ",\n".join(parts)


def _written(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::varchar)) || ':' || {column}::varchar, '-')"


#: Levels written out, enough for 16^5 rows a source and 16^3 sources.
_LEAF_LEVELS, _SOURCE_LEVELS = 5, 3
_FIELDS = " || ".join(_written(c) for c in ("doc_id", "source", "lang", "n_chars"))
SQL = f"""
with codes as (
    select range as c, list_reduce([range::bigint] || range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as t from range(256)
), steps as (select list(t order by c) as t from codes),
rows_ as (
    select doc_id, coalesce('=' || source, '') as tree, sha256({_FIELDS} || {_written("text")}) as digest,
        sha256({_FIELDS} || {_written("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) as changed,
        xor(list_reduce([4294967295::bigint] || list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda x: ascii(x)::bigint),
            lambda h, b: xor(h >> 8, t[xor(h & 255, b) + 1])), 4294967295) % 5 = 0 as hit
    from documents, steps
), leaves as (
    select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as place from rows_
),
{_levels_sql("(select tree, place, digest from leaves)", "own", _LEAF_LEVELS)},
tops as (
    select 'all' as tree, tree as source, row_number() over (order by encode(tree)) - 1 as place, digest from own_{_LEAF_LEVELS}
),
{_levels_sql("(select tree, place, digest from tops)", "top", _SOURCE_LEVELS)},
shown as (
    select l.doc_id, l.digest as leaf, l.tree, l.place, t.digest as subroot, t.place as at, 'all' as whole, '' as proof,
        case when l.hit then l.changed else l.digest end as now
    from leaves l join tops t on t.source = l.tree
),
{_fold_sql("shown", "up", "own", _LEAF_LEVELS, "place", "tree")},
{_fold_sql(f"up_{_LEAF_LEVELS - 1}", "over", "top", _SOURCE_LEVELS, "at", "whole")}
select doc_id, leaf, subroot, r.digest as root, sha256(proof) as proof_sha256, now as folded_root, now = r.digest as verified
from over_{_SOURCE_LEVELS - 1}, (select digest from top_{_SOURCE_LEVELS}) r
"""
