"""Connected components of a link table by alternating star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from replyloom.session import stash


def _linked_to_least(pairs: DataFrame) -> DataFrame:
    """For rows (u, v): u's least neighbour or itself as ``m``, beside every (u, v). The minimum is taken map-side first."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``edges(a, b)``; a component is named by its smallest id.

    Large-star links each larger neighbour to the least one around, small-star links the smaller ones; both keep
    components and end in one star per component. Rounds are logarithmic in practice. A hub's links stay separate rows
    (joins split them), only minima are grouped; each round is written and read again.
    """
    now = stash(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links"
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _linked_to_least(both).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _linked_to_least(large)
        starred = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        # counted while written; a retried task counts twice, which costs a round
        seen = Observation()
        now = stash(starred.filter("u <> v").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "links")
        if seen.get == state:
            break
        state = seen.get
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def spanning_forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[rx] = ry
            out.append((x, y))
    return out
