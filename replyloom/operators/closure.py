"""Closure: every message reachable from one author's messages over reply links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyloom.functions.tables import union_all
from replyloom.operators.reach import reachable
from replyloom.operators.threads import forest_roots, listed_children
from replyloom.session import RoundTable, stash

BROADCAST_ROWS = 100_000  # frontier rows are single ids

_VISIT = T.StructType([T.StructField("id", T.StringType())])


def own_links(messages: DataFrame) -> DataFrame:
    """Directed links ``(src, dst)``: a message leads to its parent and to the children it lists."""
    up = messages.filter(F.col("in_response_to_tweet_id") != "").select(
        F.col("tweet_id").alias("src"), F.col("in_response_to_tweet_id").alias("dst")
    )
    down = listed_children(messages).select(F.col("tweet_id").alias("src"), F.col("child_id").alias("dst"))
    return up.unionByName(down).filter("src <> dst")


def present_links(messages: DataFrame) -> DataFrame:
    """Distinct links between messages of the table."""
    ids = messages.select(F.col("tweet_id").alias("dst"))
    return own_links(messages).distinct().join(ids, "dst", "left_semi").select("src", "dst")


def spread(seeds: DataFrame, links: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, bool]:
    """Breadth-first rounds over ``links`` from ``seeds (id)``: ``(id, round)`` and whether all was reached."""
    table = RoundTable(seeds.sparkSession, "visited", _VISIT)
    rows = {"rows": F.count(F.lit(1))}
    k, size = 0, table.append(seeds.select("id").distinct(), 0, **rows)["rows"]
    while size:
        visited = table.read()
        frontier = visited.filter(F.col("round") == k).select(F.col("id").alias("src"))
        if size <= BROADCAST_ROWS:
            frontier = F.broadcast(frontier)
        reached = links.join(frontier, "src").select(F.col("dst").alias("id")).distinct()
        fresh = reached.join(visited.select("id"), "id", "left_anti")
        if max_rounds is not None and k >= max_rounds:
            return visited, fresh.isEmpty()
        k += 1
        size = table.append(fresh, k, **rows)["rows"]
    return table.read(), True


def declared_pairs(messages: DataFrame) -> DataFrame:
    """``(child, parent, up, down)``: which of the two ends declares the link."""
    up = messages.filter(F.col("in_response_to_tweet_id") != "").select(
        F.col("tweet_id").alias("child"), F.col("in_response_to_tweet_id").alias("parent"), F.lit(True).alias("up")
    )
    down = listed_children(messages).select(
        F.col("child_id").alias("child"), F.col("tweet_id").alias("parent"), F.lit(False).alias("up")
    )
    return (
        up.unionByName(down)
        .filter("child <> parent")
        .groupBy("child", "parent")
        .agg(F.max("up").alias("up"), F.max(~F.col("up")).alias("down"))
    )


def reachable_ids(messages: DataFrame, author: str, both_ways: bool = False) -> DataFrame:
    """Distinct ids of all present messages reachable from the author's.

    Messages joined by links that both ends declare reach each other, so such a group acts as one node; ``both_ways``
    takes every link as one of these. These links form a forest, whose roots take a logarithmic number of rounds
    whatever the length of a thread. Links declared by one end lead from group to group, upwards if the reply declares
    them and downwards if a list does; they are followed by jumps (:mod:`replyloom.operators.reach`), so that a
    table in which no message lists its replies, or none names its parent, takes no more rounds.
    """
    messages = stash(
        messages.select("tweet_id", "author_id", "in_response_to_tweet_id", "response_ids", "file_pos"), "reply-links"
    )
    ids = messages.groupBy(F.col("tweet_id").alias("id")).agg(F.min("file_pos").alias("near"))
    pairs = declared_pairs(messages)
    if both_ways:
        present = pairs.join(ids.select(F.col("id").alias("child")), "child", "left_semi")
        pairs = present.join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").withColumns({"up": F.lit(True), "down": F.lit(True)})
    pairs = stash(pairs, "declared-pairs")
    mutual = pairs.filter("up AND down")
    tree = mutual.groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("parent"), F.count(F.lit(1)).alias("_n"))
    nodes = stash(ids.join(tree, "id", "left"), "two-way-links")
    if mutual.isEmpty():  # every message is a group of its own
        roots = groups = nodes.select("id", F.col("id").alias("comp"))
    else:
        roots = forest_roots(nodes).withColumnRenamed("root", "comp")
        # Messages on a declared cycle have no root; they stay single and their links are followed one by one.
        groups = stash(nodes.join(roots, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")), "groups")

    # Links outside the forest: declared by one end, second parents of repeated ids, and cycles.
    second = mutual.join(nodes.filter("_n > 1").select(F.col("id").alias("child"), F.col("parent").alias("_kept")), "child")
    second = second.filter("parent <> _kept").select("child", "parent")
    ringed = nodes.join(roots, "id", "left_anti").filter("parent IS NOT NULL").select(F.col("id").alias("child"), "parent")
    two_way = second.union(ringed)
    loose = union_all(
        pairs.filter("up AND NOT down").select(F.lit("up").alias("kind"), F.col("child").alias("src"), F.col("parent").alias("dst")),
        pairs.filter("down AND NOT up").select(F.lit("down").alias("kind"), F.col("parent").alias("src"), F.col("child").alias("dst")),
        two_way.select(F.lit("other").alias("kind"), F.col("child").alias("src"), F.col("parent").alias("dst")),
        two_way.select(F.lit("other").alias("kind"), F.col("parent").alias("src"), F.col("child").alias("dst")),
    )
    # The inner join to `groups` drops links to absent messages.
    lifted = (
        loose.join(groups.select(F.col("id").alias("src"), F.col("comp").alias("_from")), "src")
        .join(groups.select(F.col("id").alias("dst"), F.col("comp").alias("_to")), "dst")
        .filter("_from <> _to")
        .select("kind", F.col("_from").alias("src"), F.col("_to").alias("dst"))
    )
    links = stash(lifted.distinct(), "group-links")
    of = lambda kind: links.filter(F.col("kind") == kind).select("src", "dst")
    own = messages.filter(F.col("author_id") == author).select(F.col("tweet_id").alias("id")).distinct()
    seeds = groups.join(own, "id", "left_semi").select(F.col("comp").alias("id"))
    reached = reachable(seeds, of("up"), of("down"), of("other"))
    return groups.join(reached.select(F.col("id").alias("comp")), "comp", "left_semi").select(
        F.col("id").alias("tweet_id")
    )


def thread_closure(messages: DataFrame, author: str, mode: str = "directed") -> DataFrame:
    """All messages of the threads the author took part in; the first record of each id.

    ``directed`` follows a message to its parent and its listed children, as declared. ``component`` follows
    every link both ways, and so also finds replies that their parent does not list.
    """
    both_ways = {"directed": False, "component": True}[mode]
    # A record without an id cannot be referred to; only the author's own leads anywhere.
    messages = messages.filter((F.col("tweet_id") != "") | (F.col("author_id") == author))
    # Membership and "first record" are settled on two narrow columns; the wide rows are then matched once, by a
    # key that is unique whatever the number of copies of an id.
    first = (
        messages.select("tweet_id", "file_pos")
        .join(reachable_ids(messages, author, both_ways), "tweet_id", "left_semi")
        .groupBy("tweet_id")
        .agg(F.min("file_pos").alias("file_pos"))
    )
    return messages.join(first, ["tweet_id", "file_pos"], "left_semi")


def thread_closure_bounded(messages: DataFrame, author: str, max_rounds: int) -> DataFrame:
    """``(tweet_id, round, converged)``: closure within a budget of breadth-first rounds.

    ``round`` is the distance from the author's own messages; ``converged`` is false if more could be reached.
    """
    own = messages.filter(F.col("author_id") == author).select(F.col("tweet_id").alias("id"))
    reached, converged = spread(own, stash(present_links(messages), "links"), max_rounds)
    return reached.select(F.col("id").alias("tweet_id"), "round", F.lit(converged).alias("converged"))


def closure_in_frame(frame: DataFrame, author: str) -> DataFrame:
    """Rows of a frame connected to the author by links within the frame; repeated ids are kept."""
    return frame.join(reachable_ids(frame, author), "tweet_id", "left_semi")


def dangling_refs(messages: DataFrame) -> DataFrame:
    """Distinct ids that messages refer to and the table lacks."""
    wanted = own_links(messages).select(F.col("dst").alias("tweet_id")).distinct()
    return wanted.join(messages.select("tweet_id"), "tweet_id", "left_anti")


def referenced_ids(messages: DataFrame) -> DataFrame:
    """Union of the ids named as parents and the ids listed as children."""
    up = messages.filter(F.col("in_response_to_tweet_id") != "").select(
        F.col("in_response_to_tweet_id").alias("tweet_id")
    )
    down = listed_children(messages).select(F.col("child_id").alias("tweet_id"))
    return up.union(down).distinct()
