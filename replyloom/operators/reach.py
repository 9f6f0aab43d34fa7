"""Reachability over directed links in rounds that grow with the logarithm of a path's length.

Links of which each node has one at most, either out of it (a message names one parent) or into it (a message is listed by one
other), form chains that doubled pointers cross in jumps: table k leads 2**k links on. Jumping once over each table,
longest first, reaches every distance, since any number is a sum of different powers of two. So the nodes above a
set of seeds, or below it, take as many rounds as the longest chain has binary digits.

Links are first followed one by one, as most paths are short. If a path goes on after as many steps as the number of
links has binary digits, jump tables are made and swept over, up and then down, before the next steps. So a path costs in proportion
to how often it turns from up to down, and to links that are second ones of their node, but not to its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyloom.session import RoundTable

BROADCAST_ROWS = 100_000  # fresh rows are single ids

_ID = T.StructType([T.StructField("id", T.StringType())])
_LINK = T.StructType([T.StructField("id", T.StringType()), T.StructField("to", T.StringType())])


class Jumps:
    """Tables of pointers ``(id, to)`` that lead 1, 2, 4, ... links on; ``id`` is unique."""

    def __init__(self, pointers: DataFrame):
        self.table = RoundTable(pointers.sparkSession, "jumps", _LINK)
        rows = {"rows": F.count(F.lit(1))}
        self.links = size = self.table.append(pointers, 0, **rows)["rows"]
        self.rounds = 1 if size else 0
        # a chain has no more links than there are pointers; pointers on a ring go on until then
        while size and 2**self.rounds <= self.links:
            step = self.at(self.rounds - 1)
            on = step.select(F.col("id").alias("to"), F.col("to").alias("_on"))
            size = self.table.append(step.join(on, "to").select("id", F.col("_on").alias("to")), self.rounds, **rows)["rows"]
            self.rounds += 1 if size else 0

    def at(self, k: int) -> DataFrame:
        return self.table.read().filter(F.col("round") == k).select("id", "to")


class Reached:
    """The ids found so far, written round by round, and how far each kind of link has been followed."""

    def __init__(self, seeds: DataFrame):
        self.table = RoundTable(seeds.sparkSession, "reached", _ID)
        self.sizes: list[int] = []
        self.add(seeds.select("id").distinct())

    def add(self, ids: DataFrame) -> None:
        self.sizes.append(self.table.append(ids, len(self.sizes), rows=F.count(F.lit(1)))["rows"])

    def since(self, first: int) -> DataFrame:
        """Ids found in round ``first`` or later; broadcast if few."""
        ids = self.table.read().filter(F.col("round") >= first).select("id")
        return F.broadcast(ids) if self.found_since(first) <= BROADCAST_ROWS else ids

    def found_since(self, first: int) -> int:
        return sum(self.sizes[first:])

    def add_new(self, ids: DataFrame) -> None:
        self.add(ids.distinct().join(self.table.read().select("id"), "id", "left_anti"))

    def all(self) -> DataFrame:
        return self.table.read().select("id")


def _sweep(reached: Reached, jumps: Jumps, first: int, forward: bool) -> None:
    """Adds all that the ids since round ``first`` lead to along the pointers, or that leads to them."""
    source, target = ("id", "to") if forward else ("to", "id")
    for k in reversed(range(jumps.rounds)):
        links = jumps.at(k).select(F.col(source).alias("_s"), F.col(target).alias("_t"))
        fresh = reached.since(first).withColumnRenamed("id", "_s")
        reached.add_new(links.join(fresh, "_s").select(F.col("_t").alias("id")))


def reachable(seeds: DataFrame, ups: DataFrame, downs: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct ``id`` of all nodes that directed links ``(src, dst)`` reach from ``seeds (id)``.

    ``ups`` have, but for exceptions, one link for each ``src``, ``downs`` one for each ``dst``; ``others`` are any.
    All three are read in every round, so they should be stored tables.
    """
    links = ups.union(downs).union(others).filter("src <> dst")
    reached, followed = Reached(seeds), 0
    steps = links.count().bit_length() + 1
    jumps: dict[str, Jumps] = {}
    swept = {"up": 0, "down": 0}
    while True:
        for _ in range(steps):
            if not reached.found_since(followed):
                return reached.all()
            fresh, followed = reached.since(followed).withColumnRenamed("id", "src"), len(reached.sizes)
            reached.add_new(links.join(fresh, "src").select(F.col("dst").alias("id")))
        if not jumps:
            first_up = ups.filter("src <> dst").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("to"))
            first_down = downs.filter("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("to"))
            jumps = {"up": Jumps(first_up), "down": Jumps(first_down)}
        for kind, tables in jumps.items():
            if reached.found_since(swept[kind]):
                _sweep(reached, tables, swept[kind], forward=kind == "up")
            swept[kind] = len(reached.sizes)
