"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

A document's set is its distinct ``words``-word shingles. ``TREES`` independent trees branch the documents: every node
picks ``BRANCHES`` minwise positions, and a document goes to one child per pick, named by its minwise token there. A
pair of similarity 0.8 stays together along some path of a tree with probability above 0.93 at any depth (the
survival of a branching process with two children that live with probability 0.8), so four trees lose less than one
pair in 50,000. Small nodes are compared exhaustively, by minwise estimate and then on the full sets.

In a larger node every document is compared with one leader first, which is one row each, and a node whose documents are
all in one component by then is done. A larger one whose documents resemble their leader on average (a family) gets new
leaders as long as these halve what is outside its largest component: the document that shares most minwise tokens with
the majority of those outside, so the original of a group of near copies. Families and nodes of a few blocks are then
settled: what is outside the largest component is compared with all of the node, block by block, on signatures; only
documents with a likely partner there are compared on full sets. The rest branch on, and all children of a node together
are no larger than it. Exact copies of a set are one class from the start. So a group of thousands of copies costs rows
in proportion to its size, and links between different texts are found or implied by a chain of verified links.

A pair of similarity 0.8 or more is passed over by its minwise estimate with probability below one in 50,000.

Defined results: NULL, empty and wordless texts have an empty set, are linked with nothing and are their own
component; a NULL id takes part, and components are named by the smallest id that is not NULL; rows with equal ids are
documents of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.common import Appended, is_empty, maybe_in, slices, table, text_bytes, without
from replyloom.llm.components import components, spanning_forest
from replyloom.llm.words import mixed, shingle_sets
from replyloom.session import stash

TREES = 4
BRANCHES = 2
POSITIONS = 64
#: Documents of a node up to which all are compared at once.
SMALL_NODE = 16
#: Mean minwise similarity to the leader from which on a node is one family; below it, two children together are no larger than it.
FAMILY = 0.5
#: Documents of one block of a node that is settled; a task compares two blocks.
BLOCK = 512
#: Documents up to which a node that is no family is settled too: its signatures go to four blocks at most.
FEW_BLOCKS = 4 * BLOCK
PERCENT = 80
#: Pairs whose minwise estimate is below this are not compared in full: four and a half deviations under 0.8.
LEAST_ESTIMATE = 0.575

_RANDOM = np.random.default_rng(404)
_FACTOR = _RANDOM.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SETS = "doc_id bigint, print bigint, n_shingles bigint, code bigint, sig array<int>"


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minwise token of a set at each position."""
    least = np.full(POSITIONS, np.uint64(2**64 - 1))
    for a in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[a : a + 4096, None] * _FACTOR ^ _FACTOR[::-1]).min(axis=0))
    return (mixed(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _set_code(shingles: np.ndarray) -> int:
    total = mixed(shingles ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def _to_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(*text_bytes(part.column("text")), words)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("print"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_code(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int32())),
                ],
                names=["doc_id", "print", "n_shingles", "code", "sig"],
            )

    return run


def _to_full(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(*text_bytes(part.column("text")), words)
            yield pa.RecordBatch.from_arrays([part.column("code"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["code", "shingles"])

    return run


def _estimate(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / POSITIONS


def _near_in_blocks(group: pa.Table) -> pa.Table:
    """The documents of a block of outsiders and a block of the node that have a likely partner on the other side.

    A pair that meets in several nodes counts in the first of them.
    """
    side, n, component = (group.column(c).to_numpy() for c in ("side", "n", "component"))
    sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(len(side), POSITIONS)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = np.zeros((len(left), len(right)), np.uint8)
    for p in range(POSITIONS):
        same += sig[left, p][:, None] == sig[right, p][None, :]
    least, most = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
    near = (same >= LEAST_ESTIMATE * POSITIONS) & (100 * least >= PERCENT * most) & (component[left][:, None] != component[right][None, :])
    nodes = group.column("nodes").combine_chunks()
    row = np.repeat(np.arange(len(side)), nodes.value_lengths().to_numpy(zero_copy_only=False))
    ids = nodes.flatten().to_numpy()
    row, ids = row[ids < group.column("node")[0].as_py()], ids[ids < group.column("node")[0].as_py()]
    by_id = np.argsort(ids, kind="stable")
    at = np.cumsum(side == 0) - 1, np.cumsum(side == 1) - 1
    for members in np.split(row[by_id], np.flatnonzero(np.diff(ids[by_id])) + 1):
        outs = side[members] == 0
        near[np.ix_(at[0][members[outs]], at[1][members[~outs]])] = False
    return group.select(["node", "i", "j", "side", "code", "component"]).take(np.concatenate([left[near.any(axis=1)], right[near.any(axis=0)]]))


def _compare_blocks(group: pa.Table) -> pa.Table:
    """Links between a block of outsiders and a block of the node, counted on the sets' shared shingles; a forest of them."""
    side, code, component = (group.column(c).to_numpy() for c in ("side", "code", "component"))
    column = group.column("shingles").combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(code)), sizes)
    shingles, at, times = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    row, at = row[shared], (np.cumsum(times > 1) - 1)[at[shared]]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    common = np.zeros((len(left), len(right)), np.float32)
    n_columns = int((times > 1).sum())
    for low in range(0, n_columns, 4096):
        some = (at >= low) & (at < low + 4096)
        hits = np.zeros((len(code), min(4096, n_columns - low)), np.float32)
        hits[row[some], at[some] - low] = 1
        common += hits[left] @ hits[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    linked = (100 * common >= PERCENT * union) & (component[left][:, None] != component[right][None, :])
    i, j = np.nonzero(linked)
    forest = spanning_forest(code[left[i]], code[right[j]])
    a, b = [min(x) for x in forest], [max(x) for x in forest]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "linked": pa.array([True] * len(a), pa.bool_())})


class _Join:
    def __init__(self, docs: DataFrame, words: int):
        self.spark, self.words = docs.sparkSession, words
        self.marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print"))
        self.sets = stash(self.marked.mapInArrow(_to_sets(words), _SETS), "cps-sets")
        self.classes = stash(
            self.sets.filter("code is not null").groupBy("code").agg(
                F.min_by("print", F.struct("doc_id", "print")).alias("print"),
                F.any_value("n_shingles").alias("n"),
                F.any_value("sig").alias("sig"),
            ),
            "cps-classes",
        )
        self.sigs = self.classes.select("code", "sig")
        self.full = Appended(self.spark, "cps-full", "code long, shingles array<long>")
        self.tested = Appended(self.spark, "cps-tested", "a long, b long, linked boolean")
        self.filled = False
        self.known: DataFrame | None = None
        self.fresh: list[DataFrame] = []

    def first_nodes(self) -> DataFrame:
        picks = [(tree, tree * BRANCHES + k) for tree in range(TREES) for k in range(BRANCHES)]
        node = [F.xxhash64(F.lit(t), F.lit(p), F.col("sig")[p]) for t, p in picks]
        return self.classes.select("code", "n", F.explode(F.array(*node)).alias("node"))

    def children(self, nodes: DataFrame) -> DataFrame:
        """Every node picks its positions by its own name, so that all its documents use the same ones."""
        child = []
        for k in range(BRANCHES):
            at = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(POSITIONS)).cast("int")
            child.append(F.xxhash64("node", F.lit(k), F.element_at("sig", at + 1)))
        return nodes.select("code", "n", F.explode(F.array(*child)).alias("node"))

    def live(self, nodes: DataFrame) -> DataFrame:
        """Nodes of two or more documents with their size and leader; of small nodes with the same documents one."""
        facts = nodes.groupBy("node").agg(
            F.count("*").alias("size"),
            F.min_by(F.struct("code", "n"), F.xxhash64("node", "code")).alias("leader"),
            F.sum(F.xxhash64("code").cast("decimal(38,0)")).alias("members"),
        )
        facts = facts.filter("size > 1")
        small = facts.filter(F.col("size") <= SMALL_NODE)
        same = small.groupBy("size", "members").agg(F.min("node").alias("node"), F.any_value("leader").alias("leader"))
        picked = same.select("node", "size", "leader").unionByName(facts.filter(F.col("size") > SMALL_NODE).select("node", "size", "leader"))
        return stash(nodes.join(picked, "node"), "cps-nodes")

    def candidates(self, live: DataFrame) -> DataFrame:
        """All pairs of small nodes and each document of a large node with its leader, by size and minwise estimate."""
        small = live.filter(F.col("size") <= SMALL_NODE).select("node", "code", "n")
        other = small.select("node", F.col("code").alias("b"), F.col("n").alias("nb"))
        pairs = small.join(other, "node").filter("code < b").select(F.col("code").alias("a"), F.col("n").alias("na"), "b", "nb")
        stars = live.filter((F.col("size") > SMALL_NODE) & (F.col("code") != F.col("leader.code"))).select(
            F.least("code", "leader.code").alias("a"), F.col("n").alias("na"), F.greatest("code", "leader.code").alias("b"), F.col("leader.n").alias("nb")
        )
        return self.likely(pairs.unionByName(stars))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Of ``pairs(a, na, b, nb)`` those not compared yet that may be similar by size and minwise estimate."""
        near = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT).select("a", "b").distinct()
        sig = self.sigs
        signed = self.untested(near).join(sig.withColumnsRenamed({"code": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"code": "b", "sig": "sb"}), "b")
        return stash(signed.filter(_estimate(F.col("sa"), F.col("sb")) >= LEAST_ESTIMATE).select("a", "b"), "cps-candidates")

    def families(self, named: DataFrame) -> DataFrame:
        """``node, members, alike`` of the nodes of ``named`` that fit a few blocks, or whose documents resemble their leader on average; ``alike`` tells these if they fill more than a block."""
        sizes = named.groupBy("node").agg(F.count("*").alias("members"))
        larger = named.join(sizes.filter(F.col("members") > BLOCK).select("node"), "node", "left_semi")
        signed = larger.join(larger.filter("code = leader").select("node", F.col("sig").alias("l_sig")), "node")
        means = signed.groupBy("node").agg(F.avg(_estimate(F.col("sig"), F.col("l_sig"))).alias("mean"), F.count("*").alias("members"))
        alike = F.col("mean") >= FAMILY
        some = means.filter((F.col("members") <= FEW_BLOCKS) | alike).select("node", "members", alike.alias("alike"))
        return sizes.filter(F.col("members") <= BLOCK).withColumn("alike", F.lit(False)).unionByName(some)

    def centres(self, members: DataFrame) -> DataFrame:
        """``node, centre, n_centre``: the document of each node that has the node's commonest token at most positions."""
        tokens = members.select("node", F.posexplode("sig").alias("at", "token")).groupBy("node", "at", "token").count()
        common = tokens.groupBy("node", "at").agg(F.max_by("token", F.struct("count", "token")).alias("token"))
        whole = common.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("common"))
        most = F.max_by(F.struct("code", "n"), F.struct(_estimate(F.col("sig"), F.col("common")), "code"))
        return members.join(whole, "node").groupBy("node").agg(most.alias("c")).select("node", F.col("c.code").alias("centre"), F.col("c.n").alias("n_centre"))

    def lead(self, members: DataFrame) -> None:
        """Compare the documents of families with a centre of all, then of those outside the largest component while these halve."""
        outside, left = members, None
        while not is_empty(outside):
            centre = self.centres(outside)
            far = members.join(centre, "node").filter("code <> centre")
            pairs = far.select(F.least("code", "centre").alias("a"), F.col("n").alias("na"), F.greatest("code", "centre").alias("b"), F.col("n_centre").alias("nb"))
            self.verify(self.likely(pairs))
            named = with_component(members, self.groups())
            outside = stash(largest(named).filter("out").select("node", "code", "n", "sig"), "cps-outside")
            before, left = left, outside.count()
            if before is not None and 2 * left > before:
                return

    def across(self, named: DataFrame) -> None:
        """Compare the full sets of documents in different components of a family, in pairs of blocks.

        All outside the node's largest component meet all of the node, first by signatures; sets go only to where a likely
        partner is, and what leaves a task is a spanning forest of links. A document's nodes, two for each tree and level at most, are grouped once.
        """
        blocks = [F.ceil(F.col(size) / BLOCK).cast("int").alias(name) for size, name in (("size", "blocks"), ("n_out", "out_blocks"))]
        place = F.struct("node", "out", *blocks, (F.col("n_out") > 0).alias("open"))
        placed = largest(named).groupBy("code").agg(
            F.collect_list(place).alias("places"), *[F.any_value(c).alias(c) for c in ("n", "component", "sig")]
        )
        placed = placed.select("code", "n", "component", "sig", F.col("places.node").alias("nodes"), F.explode(F.filter("places", lambda x: x["open"])).alias("place"))
        placed = stash(placed.select("code", "n", "component", "sig", "nodes", "place.*"), "cps-placed")
        own = lambda n: F.pmod(F.xxhash64("code", "node"), F.col(n)).cast("int")
        facts = ["node", "code", "n", "component", "nodes", "sig"]
        left = placed.filter("out").select(*facts, own("out_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"))
        right = placed.select(*facts, F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1)).alias("i"), own("blocks").alias("j"), F.lit(1).alias("side"))
        near = left.unionByName(right).groupBy("node", "i", "j").applyInArrow(_near_in_blocks, "node long, i int, j int, side int, code long, component long")
        near = stash(near, "cps-near")
        if not is_empty(near):
            full = maybe_in(self.full.read(), "code", near, "code", "hit").filter("hit").drop("hit")
            tasks = near.join(full, "code")
            self.test(tasks.groupBy("node", "i", "j").applyInArrow(_compare_blocks, "a long, b long, linked boolean"))

    def untested(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.tested.read().select("a", "b"), ["a", "b"], "left_anti") if self.tested.rounds else pairs

    def fill(self, codes: DataFrame) -> None:
        """Make the full sets of these classes from the texts, once for each; not after the first round, which knows all to come."""
        if self.filled:
            return
        if self.full.rounds:
            codes = codes.join(self.full.read().select("code"), "code", "left_anti")
        wanted = stash(codes.distinct().join(self.classes.select("code", "print"), "code"), "cps-wanted")
        if not is_empty(wanted):
            texts = maybe_in(self.marked.select("print", "text"), "print", wanted, "print", "hit").filter("hit").dropDuplicates(["print"]).join(wanted, "print")
            self.full.add(texts.select("code", "text").mapInArrow(_to_full(self.words), "code long, shingles array<long>"))

    def verify(self, pairs: DataFrame) -> None:
        """Compare the full sets of pairs; only sets that a pair needs are moved."""
        if is_empty(pairs):
            return
        codes = pairs.select(F.explode(F.array("a", "b")).alias("code")).distinct()
        self.fill(codes)
        full = maybe_in(self.full.read(), "code", codes, "code", "hit").filter("hit").drop("hit")
        both = pairs.join(full.withColumnsRenamed({"code": "a", "shingles": "x"}), "a").join(full.withColumnsRenamed({"code": "b", "shingles": "y"}), "b")
        common = F.size(F.array_intersect("x", "y"))
        linked = common * 100 >= (F.size("x") + F.size("y") - common) * PERCENT
        self.test(both.select("a", "b", linked.alias("linked")))

    def test(self, results: DataFrame) -> None:
        links = self.tested.add(results).filter("linked").select("a", "b")
        if not is_empty(links):
            self.fresh.append(links)

    def groups(self) -> DataFrame | None:
        """Components of all links so far, from the last ones and the links since."""
        if self.fresh:
            stars = [self.known.select(F.col("id").alias("a"), F.col("component").alias("b"))] if self.known else []
            self.known = components(functools.reduce(DataFrame.unionByName, self.fresh + stars))
            self.fresh = []
        return self.known

    def run(self) -> DataFrame | None:
        """``id, component`` of every class with a link, or None if there is none."""
        nodes = self.first_nodes()
        while True:
            live = self.live(nodes)
            self.sigs = stash(self.sigs.join(live.select("code").distinct(), "code", "left_semi"), "cps-sigs")
            self.verify(self.candidates(live))
            groups, larger = self.groups(), live.filter(F.col("size") > SMALL_NODE)
            if is_empty(larger):
                return groups
            named = with_component(larger.select("node", "code", "n", F.col("leader.code").alias("leader")), groups)
            open_ = named.groupBy("node").agg((F.min("component") != F.max("component")).alias("open")).filter("open").select("node")
            named = stash(named.join(open_, "node").join(self.sigs, "code"), "cps-open")
            self.fill(named.select("code"))
            self.filled = True
            families = stash(self.families(named), "cps-families")
            if not is_empty(families):
                large = families.filter((F.col("members") > BLOCK) & F.col("alike")).select("node")
                if not is_empty(large):
                    self.lead(stash(named.join(large, "node").select("node", "code", "n", "sig"), "cps-large"))
                self.across(stash(with_component(named.join(families, "node").select("node", "code", "n", "sig"), self.groups()), "cps-settled"))
            others = named.join(families, "node", "left_anti")
            if is_empty(others):
                return self.groups()
            nodes = stash(self.children(others.select("node", "code", "n", "sig")), "cps-children")


def largest(named: DataFrame) -> DataFrame:
    """Adds to the documents of each node ``size``, ``out`` (not in its largest component) and ``n_out``."""
    main = named.groupBy("node", "component").count().groupBy("node").agg(
        F.max_by("component", F.struct("count", "component")).alias("main"),
        F.sum(F.col("count")).alias("size"),
        (F.sum(F.col("count")) - F.max("count")).alias("n_out"),
    )
    return named.join(main, "node").withColumn("out", F.col("component") != F.col("main")).drop("main")


def with_component(classes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Adds ``component``; a class without links is its own."""
    if groups is None:
        return classes.withColumn("component", F.col("code"))
    named = classes.join(groups.withColumnRenamed("id", "code"), "code", "left")
    return named.withColumn("component", F.coalesce("component", "code"))


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, print, n_shingles, component, component_id, kept`` for every row of ``docs(doc_id, text)``; ``print`` is xxhash64(text)."""
    join = _Join(docs, words)
    groups = join.run()
    named = with_component(join.sets.select("doc_id", "print", "n_shingles", "code"), groups)
    least = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "print", "n_shingles", "component", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of the smallest id that is not NULL.

    Rows without words stay. Only rows that may go are moved.
    """
    named = stash(near_duplicates(docs, words).filter("component is not null").select("doc_id", "print", "component"), "cps-named")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "print")
    first = named.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    grouped = stash(named.join(first, "component"), "cps-grouped")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("print") == F.col("first.print"))
    rest = without(docs, grouped.filter(~stays).select("doc_id", "print"))
    again = grouped.filter(stays).groupBy("doc_id", "print").count().filter("count > 1")
    told = maybe_in(rest.withColumn("__print", F.xxhash64("text")), "__print", again, "print", "__hit")
    repeated = told.filter("__hit").withColumn("__id", F.col("doc_id").cast("long"))
    once = repeated.dropDuplicates(["__id", "__print"])
    return told.filter(~F.col("__hit")).unionByName(once.drop("__id")).select(*docs.columns)


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4).drop("print", "component")
