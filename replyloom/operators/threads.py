"""Reply trees: edges, diagnostics, and depth-first reading order.

The reading order is found by list ranking. Every message is entered once and, if it has replies, left once;
the walk through a tree visits these steps one after the other, so each step has exactly one step before it.
Doubling those back pointers reaches the tree's first step in log2(steps) rounds, while a running count of
entries gives the turn. Each step is joined by its own unique key, hence no round can be skewed by a message
with very many replies, and a row stays the same size in a chain of any depth.

Replies mostly stand near each other in the file. So steps are first dealt out by file position, once, and each task follows
what it can within ``CHUNK`` neighbouring steps; the rounds move only pointers that lead further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyloom.functions.ranking import rank_in_groups
from replyloom.functions.tables import union_all, unpivot
from replyloom.session import RoundTable, stash

BROADCAST_ROWS = 100_000  # open steps are narrow rows of two short keys, two numbers
CHUNK = 200_000  # steps that a task follows together; some 20 MB

_STEP = T.StructType(
    [
        T.StructField("step", T.StringType()),
        T.StructField("back", T.StringType()),
        T.StructField("entries", T.LongType()),
        T.StructField("root", T.StringType()),
        T.StructField("done", T.BooleanType()),
    ]
)


def reply_edges(messages: DataFrame) -> DataFrame:
    """``(tweet_id, parent_id, parent_present, self_parent)`` for every message that names a parent."""
    ids = messages.select(F.col("tweet_id").alias("parent_id"), F.lit(True).alias("_there"))
    return (
        messages.filter(F.col("in_response_to_tweet_id") != "")
        .select("tweet_id", F.col("in_response_to_tweet_id").alias("parent_id"))
        .join(ids, "parent_id", "left")
        .select(
            "tweet_id",
            "parent_id",
            F.col("_there").isNotNull().alias("parent_present"),
            (F.col("tweet_id") == F.col("parent_id")).alias("self_parent"),
        )
    )


def listed_children(messages: DataFrame) -> DataFrame:
    """``(tweet_id, child_id)`` for every id in a message's child list."""
    return messages.select("tweet_id", F.explode("response_ids").alias("child_id"))


def link_diagnostics(messages: DataFrame) -> DataFrame:
    """Listed children that are absent, or that name another parent, as ``(name, value)``.

    Lists are counted by child id and by (parent, child) before any join, so that an id listed very often
    costs one row.
    """
    listed = listed_children(messages).groupBy("tweet_id", "child_id").agg(F.count(F.lit(1)).alias("_n"))
    ids = messages.select(F.col("tweet_id").alias("child_id"))
    by_child = listed.groupBy("child_id").agg(F.sum("_n").alias("_n"))
    dangling = by_child.join(ids, "child_id", "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("v"))
    present = by_child.join(ids, "child_id", "left_semi").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("v"))
    links = messages.select(
        F.col("in_response_to_tweet_id").alias("tweet_id"), F.col("tweet_id").alias("child_id")
    )
    agreed = listed.join(links, ["tweet_id", "child_id"], "left_semi").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("v")
    )
    return union_all(
        dangling.select(F.lit("dangling_child_links").alias("name"), F.col("v").alias("value")),
        union_all(
            present.select("v"), agreed.select((-F.col("v")).alias("v"))
        ).agg(F.sum("v").alias("value")).select(F.lit("parent_link_mismatches").alias("name"), "value"),
    )


def thread_roots(messages: DataFrame) -> DataFrame:
    """``(tweet_id, partial)``: messages without a parent, or whose parent is absent (``partial``)."""
    whole = messages.filter(F.col("in_response_to_tweet_id") == "").select("tweet_id", F.lit(False).alias("partial"))
    ids = messages.select(F.col("tweet_id").alias("in_response_to_tweet_id"))
    cut = (
        messages.filter(F.col("in_response_to_tweet_id") != "")
        .join(ids, "in_response_to_tweet_id", "left_anti")
        .select("tweet_id", F.lit(True).alias("partial"))
    )
    return whole.unionByName(cut)


def reply_nodes(messages: DataFrame) -> DataFrame:
    """``(id, parent, no_time, ts, file_pos)``; ``parent`` is NULL for roots and never an absent message."""
    nodes = messages.select(
        F.col("tweet_id").alias("id"),
        F.when(F.col("in_response_to_tweet_id") != "", F.col("in_response_to_tweet_id")).alias("_named"),
        F.col("ts").isNull().alias("no_time"),
        "ts",
        "file_pos",
    )
    return (
        nodes.join(nodes.select(F.col("id").alias("parent")), F.col("_named") == F.col("parent"), "left")
        .select("id", "parent", "no_time", "ts", "file_pos")
    )


def sibling_rank(messages: DataFrame) -> DataFrame:
    """Position of every reply among the replies to the same message: by time, unparsed last, then file order."""
    kids = stash(reply_nodes(messages).filter("parent IS NOT NULL AND parent <> id"), "replies")
    return rank_in_groups(kids, "parent", ["no_time", "ts", "file_pos", "id"], carry="id")


def _shortened(rows: pa.Table) -> pa.Table:
    """Steps whose pointers lead on as far as they stay among ``rows`` and pass steps that occur once."""
    step, back = rows["step"].combine_chunks(), rows["back"].combine_chunks()
    own = np.arange(len(step))
    lone = np.flatnonzero(rows["lone"].to_numpy())
    found = pc.index_in(back, value_set=step.take(pa.array(lone)), skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
    to = np.where(found >= 0, np.append(lone, -1)[found], -1)
    end, entries = own.copy(), rows["entries"].to_numpy().copy()
    for _ in range(len(own).bit_length()):
        on = np.flatnonzero(to >= 0)
        if not len(on):
            break
        at = to[on]
        entries[on], end[on], to[on] = entries[on] + entries[at], end[at], to[at]
    ring = to >= 0  # has no end: stays as it is
    entries[ring], end[ring] = rows["entries"].to_numpy()[ring], own[ring]
    ends = pa.array(end)
    return pa.table({"step": step, "back": back.take(ends), "entries": entries, "root": rows["root"].combine_chunks().take(ends)})


def _follow_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield from _shortened(pa.Table.from_batches(held)).to_batches(10_000)
            held, size = [], 0
    if size:
        yield from _shortened(pa.Table.from_batches(held)).to_batches(10_000)


def follow_near(start: DataFrame) -> DataFrame:
    """``(step, back, entries, root, near, lone)`` with pointers moved on past steps at hand, without the last two columns.

    Steps that point to each other should be alike in ``near``, but need not be. ``lone`` tells that no other row has the same step.
    """
    dealt = start.repartitionByRange("near").sortWithinPartitions("near")
    return dealt.mapInArrow(_follow_here, "step string, back string, entries long, root string")


def follow_back(start: DataFrame) -> DataFrame:
    """Follow back pointers to their ends: ``(step, back, entries, root)`` to ``(step, entries, root)``.

    Each round replaces a pointer by its target's pointer and adds up ``entries``, so the distance covered
    doubles. A step whose pointer is NULL is an end and knows its ``root``; steps on a ring never get one and
    are left out.
    """
    table = RoundTable(start.sparkSession, "steps", _STEP, split="done")
    counters = {"open": F.count_if(~F.col("done")), "done": F.count_if("done")}
    start = start.select("step", "back", "entries", "root", F.col("back").isNull().alias("done"))
    k, state = 0, table.append(start, 0, **counters)
    # Distances have no gaps: a round in which nothing gets done leaves only steps without an end.
    while state["open"] and state["done"]:
        steps = table.read()
        waiting = steps.filter(~F.col("done") & (F.col("round") == k)).select("step", "back", "entries")
        known = steps.filter(F.col("done") | (F.col("round") == k)).select(
            F.col("step").alias("back"),
            F.col("back").alias("_back"),
            F.col("entries").alias("_entries"),
            F.col("root").alias("_root"),
        )
        if state["open"] <= BROADCAST_ROWS:
            waiting = F.broadcast(waiting)
        moved = waiting.join(known, "back").select(
            "step",
            F.col("_back").alias("back"),
            (F.col("entries") + F.col("_entries")).alias("entries"),
            F.col("_root").alias("root"),
            F.col("_back").isNull().alias("done"),
        )
        k += 1
        state = table.append(moved, k, **counters)
    return table.read().filter("done").select("step", "entries", "root")


def forest_roots(nodes: DataFrame) -> DataFrame:
    """``(id, root)`` of a forest ``(id, parent, near)``, ``id`` unique; nodes on or below a cycle are left out."""
    start = nodes.select(
        F.col("id").alias("step"),
        F.col("parent").alias("back"),
        F.lit(1).cast("long").alias("entries"),
        F.when(F.col("parent").isNull(), F.col("id")).alias("root"),
        "near",
        F.lit(True).alias("lone"),
    )
    return follow_back(follow_near(start)).select(F.col("step").alias("id"), "root")


def reading_order(nodes: DataFrame) -> DataFrame:
    """``(id, root, turn)`` for every node of a reply forest ``(id, parent, no_time, ts, file_pos)``.

    Nodes on a cycle, and all below one, have no first step and are left out.
    """
    parents = nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
    tagged = stash(
        nodes.join(parents.withColumn("_parent", F.lit(True)), "id", "left").select(
            "*",
            F.concat(F.when(F.col("_parent"), F.lit("-")).otherwise(F.lit("+")), F.col("id")).alias("last_step"),
            (F.count(F.lit(1)).over(Window.partitionBy("id")) == 1).alias("lone"),
        ).drop("_parent"),
        "nodes",
    )
    kids = rank_in_groups(
        tagged.filter("parent IS NOT NULL"),
        "parent",
        ["no_time", "ts", "file_pos", "id"],
        carry="last_step",
    )
    kids = stash(kids.select("id", "parent", "last_step", "rank", "prev", "file_pos", "lone"), "ranked-replies")
    start = union_all(
        tagged.filter("parent IS NULL").select(
            F.concat(F.lit("+"), "id").alias("step"),
            F.lit(None).cast("string").alias("back"),
            F.lit(1).cast("long").alias("entries"),
            F.col("id").alias("root"),
            F.col("file_pos").alias("near"),
            "lone",
        ),
        kids.select(
            F.concat(F.lit("+"), "id").alias("step"),
            F.coalesce(F.col("prev"), F.concat(F.lit("+"), "parent")).alias("back"),
            F.lit(1).cast("long").alias("entries"),
            F.lit(None).cast("string").alias("root"),
            F.col("file_pos").alias("near"),
            "lone",
        ),
        kids.groupBy("parent")
        .agg(F.max_by("last_step", "rank").alias("back"), F.max_by("file_pos", "rank").alias("near"))
        .select(
            F.concat(F.lit("-"), "parent").alias("step"),
            "back",
            F.lit(0).cast("long").alias("entries"),
            F.lit(None).cast("string").alias("root"),
            "near",
            F.lit(True).alias("lone"),
        ),
    )
    return (
        follow_back(follow_near(start))
        .filter(F.startswith("step", F.lit("+")))
        .select(F.substring("step", 2, 1 << 30).alias("id"), "root", F.col("entries").alias("turn"))
    )


def reconstruct_threads(messages: DataFrame) -> DataFrame:
    """Messages with ``conversation_id`` (the root's id) and 1-based ``turn`` in reading order."""
    order = reading_order(reply_nodes(messages))
    return messages.join(
        order.select(F.col("id").alias("tweet_id"), F.col("root").alias("conversation_id"), "turn"), "tweet_id"
    )


def unreachable_messages(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Messages left out of every thread: on a reply cycle, their own parent, or below such a message."""
    return messages.select("tweet_id", "in_response_to_tweet_id").join(
        threads.select("tweet_id"), "tweet_id", "left_anti"
    )


def reconstruction_stats(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """The seven rebuild counters as ``(name, value)``."""
    totals = messages.agg(F.count(F.lit(1)).alias("tweets_in"))
    placed = threads.agg(
        F.count_if(F.col("turn") == 1).alias("conversations"), F.count(F.lit(1)).alias("tweets_in_conversations")
    )
    partial = thread_roots(messages).filter("partial").agg(F.count(F.lit(1)).alias("partial_roots"))
    skipped = unreachable_messages(messages, threads).agg(F.count(F.lit(1)).alias("cyclic_tweets_skipped"))
    return union_all(*[unpivot(t) for t in (totals, placed, partial, skipped)], link_diagnostics(messages))


def convs_with_author(threads: DataFrame, author: str) -> DataFrame:
    """Messages of the threads in which the author wrote at least once."""
    wanted = threads.filter(F.col("author_id") == author).select("conversation_id").distinct()
    return threads.join(wanted, "conversation_id", "left_semi")


def conversation_totals(threads: DataFrame) -> DataFrame:
    """Sizes and the first and last time in reading order, one row per conversation."""
    return threads.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("tweets"),
        F.count_if("inbound").alias("customer_tweets"),
        F.count_if(~F.col("inbound")).alias("support_tweets"),
        F.min_by("created_at", "turn").alias("first_created_at"),
        F.max_by("created_at", "turn").alias("last_created_at"),
    )


def conversation_ids(threads: DataFrame) -> DataFrame:
    """The messages of each conversation in reading order, one row each: ``conversation_id, turn, tweet_id``."""
    return threads.select("conversation_id", "turn", "tweet_id")


def conversations_summary(threads: DataFrame) -> DataFrame:
    """:func:`conversation_totals` with ``tweet_ids``, the ids in reading order: the row of a flat conversation file.

    A row holds all ids of its conversation at any size, as that format has it. Work on :func:`conversation_totals` and
    :func:`conversation_ids` instead, whose rows have a fixed size.
    """
    ids = threads.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn", "tweet_id"))).alias("_ids"))
    listed = ids.select("conversation_id", F.transform("_ids", lambda x: x["tweet_id"]).alias("tweet_ids"))
    return conversation_totals(threads).join(listed, "conversation_id")


def explode_threads(conversations: DataFrame) -> DataFrame:
    """Back from :func:`conversations_summary` to :func:`conversation_ids`."""
    return conversations.select("conversation_id", F.posexplode("tweet_ids").alias("_pos", "tweet_id")).select(
        "conversation_id", (F.col("_pos") + 1).cast("long").alias("turn"), "tweet_id"
    )
