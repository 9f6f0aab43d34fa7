"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a repeatable random order, gone through at most twice. A document's
virtual finish time is the source's cumulative words up to it divided by the source's target, so that all sources
reach their target at time one. All copies are put into one order by finish time, and the mix is cut where its
words would pass the total budget.

Defined results: NULL text has size 0; NULL source is a source of its own, last in order; equal finish times go by
copy, shuffle key, id and size; repeated rows are separate documents; an empty table gives an empty table; other
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.common import running_total, table
from replyloom.session import stash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: ``source, source_size, target, before`` (words of the sources before it).

    A source's first share is its weight's part of the budget. Shares above ``REPEATS`` times the source's size stop
    there, and what is left is shared again, until none is above; each round is one aggregate over the sources.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull().cast("int"))
    order = ["_last", "source"]
    ranked = running_total(totals.withColumn("_one", F.lit(1)), order, "_one", "_rank", "mix-rank")
    ranked = running_total(ranked, order, "source_size", "_through", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    sources = stash(
        ranked.select(
            "source",
            "source_size",
            (F.col("_through") - F.col("source_size")).alias("before"),
            weight.alias("weight"),
            (F.col("source_size") * REPEATS).cast("double").alias("cap"),
        ),
        "mix-weights",
    )
    budget = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = 0.0, None
    while True:
        above = F.lit(False) if full is None else F.col("weight") * F.lit(level) >= F.col("cap")
        row = sources.agg(
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("spent"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(above).alias("full"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], max(0.0, budget - row["spent"]) / row["open"]
    if full is not None and not row["open"]:
        target = F.col("cap")
    else:
        target = F.least(F.col("weight") * F.lit(level), F.col("cap"))
    return sources.select("source", "source_size", "before", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, seed: int = 8) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken`` for every row of ``docs(doc_id, text, source)``."""
    sized = stash(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    sources = source_targets(sized, weights, share)
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long")
    queued = running_total(
        sized.withColumn("_last", F.col("source").isNull().cast("int")).withColumn("_key", key),
        ["_last", "source", "_key", "doc_id", "size"],
        "size",
        "_through",
        "mix-queues",
    )
    own = F.col("_through") - F.col("before")
    finish = lambda epoch: F.when(F.col("target") > 0, (own + epoch * F.col("source_size")) / F.col("target"))
    timed = stash(
        queued.join(sources, queued["source"].eqNullSafe(sources["source"]))
        .select(queued["source"], "doc_id", "size", "source_size", "target", "_key", *[finish(e).alias(f"finish{e}") for e in range(REPEATS)]),
        "mix-times",
    )
    copies = timed.filter((F.col("target") > 0) & (F.col("size") > 0)).select(
        "size", "_key", "doc_id", F.explode(F.array(*[F.struct(F.col(f"finish{e}").alias("finish"), F.lit(e).alias("copy")) for e in range(REPEATS)])).alias("c")
    )
    order = ["finish", "copy", "_key", "doc_id", "size"]
    line = running_total(copies.select("size", "_key", "doc_id", "c.finish", "c.copy"), order, "size", "_mixed", "mix-line")
    budget = sources.agg(F.sum("target")).first()[0] or 0.0
    last = line.filter(F.col("_mixed") <= F.lit(budget + 1e-6)).agg(F.max(F.struct(*order)).alias("last")).first()["last"]
    if last is None:
        taken = F.lit(0).cast("long")
    else:
        cut = F.struct(
            F.lit(last["finish"]).alias("finish"), F.lit(last["copy"]).alias("copy"), F.lit(last["_key"]).cast("long").alias("_key"),
            F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["size"]).cast("long").alias("size"),
        )
        is_in = [
            (F.struct(F.col(f"finish{e}").alias("finish"), F.lit(e).alias("copy"), "_key", F.col("doc_id").cast("long").alias("doc_id"), "size") <= cut)
            for e in range(REPEATS)
        ]
        taken = sum((F.when(F.col("target") > 0, c.cast("int")).otherwise(0) * F.col("size") for c in is_in[1:]), F.when(F.col("target") > 0, is_in[0].cast("int")).otherwise(0) * F.col("size"))
    return timed.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def op8_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with recursive sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), ranked as (
    select source, sum(size)::bigint as source_size, 2.0::double * sum(size) as cap,
        [5, 2, 1][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight
    from sized group by source
), levels as (
    select 0 as round, -1::bigint as done, 0.0::double as level
    union all
    select round + 1, f, l from (
        select round, done,
            (select count(*) from ranked where levels.round > 0 and weight * levels.level >= cap) as f,
            greatest(0.0, 1.5::double * (select sum(source_size) from ranked)
                - (select coalesce(sum(cap), 0.0) from ranked where levels.round > 0 and weight * levels.level >= cap))
            / (select sum(weight) from ranked where levels.round = 0 or weight * levels.level < cap) as l
        from levels
    ) where f <> done
), sources as (
    select source, source_size, least(weight * (select level from levels order by round desc limit 1), cap) as target from ranked
), timed as (
    select doc_id, size, source_size, target, key,
        sum(size) over (partition by s.source order by key, doc_id, size rows unbounded preceding)::bigint as own
    from (select *, ('0x' || substr(md5('8:' || doc_id::varchar), 1, 15))::bigint as key from sized) s
    join sources t on s.source is not distinct from t.source
), line as (
    select *, sum(size) over (order by finish, copy, key, doc_id, size rows unbounded preceding) as mixed
    from (select *, (own + copy * source_size) / target as finish from timed, (values (0), (1)) v(copy)) where size > 0
)
select t.doc_id, t.size, t.source_size, t.target, coalesce(x.taken, 0)::bigint as taken
from timed t left join (
    select doc_id, key, sum(size) as taken from line where mixed <= (select sum(target) from sources) + 1e-6 group by doc_id, key
) x on t.doc_id = x.doc_id
"""
