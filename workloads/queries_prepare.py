"""Queries on sources, cleaning, closure, threads, pairs and checks, each with its SQL."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.constants import LABELS, MESSAGE_COLUMNS
from replyloom.functions.tables import union_all, unpivot
from replyloom.functions.text import clip, split_ids
from replyloom.operators import cleaning, closure, pairs, profile, quality, sampling, threads
from replyloom.operators.taxonomy import signal_flags
from replyloom.plans import ledger
from replyloom.plans.prepare import run_report, stage_status
from replyloom.sources import labels as label_sources
from replyloom.sources import messages as message_sources
from replyloom.session import stash
from replyloom.sources import sinks
from workloads.views import (
    TAXONOMY_SQL,
    V1,
    V1D,
    V2,
    V2T,
    V3,
    V4,
    Tables,
    clean_sql,
    collapse_sql,
    links_sql,
    strip_sql,
    threads_sql,
)

MSG = "tweet_id, author_id, inbound, created_at, text, response_tweet_id, in_response_to_tweet_id"
Q: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = (fn, sql)
        return fn

    return register


# --- Sources and sinks -------------------------------------------------------------------------------------
@query("src_messages", f"with {V1} select {MSG} from v1")
def src_messages(t: Tables) -> DataFrame:
    raw = t.v1.withColumn("inbound", F.initcap(F.col("inbound").cast("string")))
    path, table = t.scratch("csv"), t.scratch("bronze")
    raw.select(*MESSAGE_COLUMNS).write.options(**sinks.CSV_OPTIONS).csv(path)
    return message_sources.ingest_messages(t.spark, path, table).select(*MESSAGE_COLUMNS)


@query("row_limit", f"with {V1} select tweet_id, file_pos from v1 order by file_pos limit 100")
def row_limit(t: Tables) -> DataFrame:
    return message_sources.first_rows(t.v1, 100).select("tweet_id", "file_pos")


@query("row_sample", f"with {V2} select tweet_id from v2 order by md5('42:' || tweet_id), tweet_id limit 150")
def row_sample(t: Tables) -> DataFrame:
    return message_sources.sample_rows(t.v2, 150).select("tweet_id")


@query("src_label_map", f"with {V4} select conversation_id, label from v4")
def src_label_map(t: Tables) -> DataFrame:
    path = t.scratch("label-maps")
    label_sources.write_label_map(t.v4, path)
    return label_sources.read_label_map(t.spark, path)


@query("src_jsonl", f"with {V1} select conversation_id, tweet_id, created_at, author_id, text from t1 where turn = 1 and inbound")
def src_jsonl(t: Tables) -> DataFrame:
    path = t.scratch("worksheet")
    label_sources.write_worksheet(sampling.openers(t.t1), path)
    return label_sources.read_worksheet(t.spark, path)


@query("src_manifest", f"with {V4} select distinct conversation_id from v4")
def src_manifest(t: Tables) -> DataFrame:
    path = t.scratch("manifest")
    label_sources.write_manifest(t.v4, path)
    return label_sources.read_manifest(t.spark, path)


@query(
    "sink_tables",
    f"with {V1} select 'messages' as name, count(*) as rows, sum(length(text))::bigint as chars from t1 "
    "union all select 'conversations', count(*), sum(tweets)::bigint from c1 "
    "union all select 'pairs', count(*), sum(length(customer_message) + length(support_response))::bigint from p1",
)
def sink_tables(t: Tables) -> DataFrame:
    m, c, p = t.scratch("m"), t.scratch("c"), t.scratch("p")
    sinks.write_messages(t.t1, m)
    sinks.write_conversations(threads.conversations_summary(t.t1), c)
    sinks.write_pairs(t.p1, p)
    read = t.spark.read.parquet
    size = lambda name, df, chars: df.agg(
        F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(chars).cast("long").alias("chars")
    )
    return union_all(
        size("messages", read(m), F.length("text")),
        size("conversations", read(c), F.col("tweets")),
        size("pairs", read(p), F.length("customer_message") + F.length("support_response")),
    )


_RUN = f"""{V1D}, {links_sql("v1d")},
reach as (select distinct tweet_id as id from v1d where author_id = 'agent' and tweet_id <> ''
  union (select distinct n.tweet_id from v1d b join v1d n on n.tweet_id in (b.in_response_to_tweet_id, b.response_tweet_id)
    where b.tweet_id = '' and b.author_id = 'agent' and n.tweet_id <> '')
  union select pl.dst from pl join reach on pl.src = reach.id),
col0 as (select * from v1d where tweet_id in (select id from reach) or (tweet_id = '' and author_id = 'agent')),
collected as (select * exclude (n) from (select *, row_number() over (partition by tweet_id order by file_pos) n from col0) where n = 1),
valid as (select * from collected where tweet_id <> '' and author_id <> ''),
cleaned as (select * replace ({clean_sql("text")} as text), null::timestamp as ts from valid where {clean_sql("text")} <> ''),
{threads_sql("cleaned", "rebuilt")},
mine as (select * from rebuilt where conversation_id in (select conversation_id from rebuilt where author_id = 'agent')),
prs as (select r.*, q.text as question from mine r join mine q on r.in_response_to_tweet_id = q.tweet_id
  where r.author_id = 'agent' and q.inbound)"""


def _profile_sql(src: str) -> str:
    return f"""select 'total_rows' as name, count(*) as value from {src}
 union all select 'unique_tweet_ids', count(distinct tweet_id) filter (tweet_id <> '') from {src}
 union all select 'empty_tweet_ids', count(*) filter (tweet_id = '') from {src}
 union all select 'inbound_rows', count(*) filter (lower(inbound_raw) = 'true') from {src}
 union all select 'outbound_rows', count(*) filter (lower(inbound_raw) <> 'true') from {src}
 union all select 'malformed_inbound', count(*) filter (lower(inbound_raw) not in ('true', 'false')) from {src}
 union all select 'conversation_starters', count(*) filter (in_response_to_tweet_id = '') from {src}
 union all select 'duplicate_tweet_ids', count(*) filter (tweet_id <> '') - count(distinct tweet_id) filter (tweet_id <> '') from {src}"""


def _empty_sql(src: str, names) -> str:
    column = lambda c: "inbound_raw" if c == "inbound" else c
    return " union all ".join(
        f"select '{c}' as column_name, count(*) filter ({strip_sql(column(c))} = '') as empty_values from {src}" for c in names
    )


def _cleaning_sql(src: str) -> str:
    v = "tweet_id <> '' and author_id <> ''"
    after = clean_sql("text")
    sp = r"[\t-\r\x1C-\x1F\x85\p{Z}]"
    return rf"""select 'rows_in' as name, count(*) as value from {src}
 union all select 'rows_out', count(distinct tweet_id) from {src} where {v} and {after} <> ''
 union all select 'dropped_missing_tweet_id', count(*) from {src} where tweet_id = ''
 union all select 'dropped_missing_author_id', count(*) from {src} where tweet_id <> '' and author_id = ''
 union all select 'dropped_empty_text', count(*) from {src} where {v} and {after} = ''
 union all select 'decoded_html_entities', count(*) from {src} where {v} and contains(text, '&amp;')
 union all select 'removed_rt_prefix', count(*) from {src} where {v} and regexp_matches(text, '(?i)^RT{sp}+@[\p{{L}}\p{{N}}_]+')
 union all select 'removed_urls', count(*) from {src} where {v} and regexp_matches(text, 'https?://[^\s]|www\.[^\s]')
 union all select 'removed_leading_mention', count(*) from {src} where {v} and text like '@%' and {after} not like '@%'
 union all select 'collapsed_whitespace', count(*) from {src} where {v} and {collapse_sql("text")} <> {strip_sql("text")}
 union all select 'dropped_duplicate_tweet_id', count(*) - count(distinct tweet_id) from {src} where {v} and {after} <> ''"""


def _diag_sql(src: str) -> str:
    return f"""
diag_l as (select tweet_id, unnest(string_split(response_tweet_id, ',')) as child from {src} where response_tweet_id <> ''),
diag as (select count(*) filter (m.tweet_id is null) as dangling,
  count(*) filter (m.tweet_id is not null and m.in_response_to_tweet_id <> l.tweet_id) as mismatches
  from diag_l l left join {src} m on l.child = m.tweet_id)"""


def _rebuild_sql(src: str, thr: str) -> str:
    return f"""select 'tweets_in' as name, count(*) as value from {src}
 union all select 'conversations', count(distinct conversation_id) from {thr}
 union all select 'tweets_in_conversations', count(*) from {thr}
 union all select 'partial_roots', count(*) from {src} where in_response_to_tweet_id <> '' and in_response_to_tweet_id not in (select tweet_id from {src})
 union all select 'cyclic_tweets_skipped', (select count(*) from {src}) - (select count(*) from {thr})
 union all select 'dangling_child_links', dangling from diag union all select 'parent_link_mismatches', mismatches from diag"""


# Names of the checks, in report order.
_CHECKS = (
    "pair_ids_exist_in_tweets",
    "pair_conversations_exist",
    "pair_messages_non_empty",
    "pair_response_ids_unique",
    "pair_responses_by_support_author",
    "conversation_ids_unique",
    "tweets_have_conversation_id",
)


@query(
    "run_report",
    f"""with recursive {_RUN}, {_diag_sql("cleaned")}
 select 'scan' as section, name, value from ({_profile_sql("v1d")})
 union all select 'empty', column_name, empty_values from ({_empty_sql("v1d", MESSAGE_COLUMNS[:5])})
 union all select 'cleaning', name, value from ({_cleaning_sql("collected")})
 union all select 'rebuild', name, value from ({_rebuild_sql("cleaned", "rebuilt")})
 union all select 'outputs', 'messages', count(*) from mine
 union all select 'outputs', 'conversations', count(distinct conversation_id) from mine
 union all select 'outputs', 'pairs', count(*) from prs
 union all select 'violations', unnest({list(_CHECKS)!r}), 0""",
)
def report(t: Tables) -> DataFrame:
    return run_report(t.run)


@query(
    "stage_status",
    f"""with recursive {_RUN} select 'validate_schema' as stage,
  case when count(*) filter (tweet_id = '' or author_id = '' or created_at = '' or text = '') > 0 then 'WARN' else 'OK' end as status from v1d
 union all select 'reconstruct', case when (select count(*) from cleaned) > (select count(*) from rebuilt) then 'WARN' else 'OK' end
 union all select 'validate_outputs', case when count(*) > count(distinct tweet_id) then 'WARN' else 'OK' end from prs""",
)
def status(t: Tables) -> DataFrame:
    return stage_status(run_report(t.run))


_PLANTED = f"""{_RUN}, {_diag_sql("cleaned")},
again as (select tweet_id, turn from prs union all select tweet_id, turn from prs where turn % 3 = 1),
broken as (select count(*) as n from (select 1 from again group by tweet_id having count(*) > 1)),
named as (select id from (select in_response_to_tweet_id as id, tweet_id from collected union all select unnest(string_split(response_tweet_id, ',')), tweet_id from collected) where id <> '' and id <> tweet_id),
entries as (select 'scan' as section, name, value from ({_profile_sql("v1d")})
 union all select 'empty', column_name, empty_values from ({_empty_sql("v1d", MESSAGE_COLUMNS[:5])})
 union all select 'cleaning', name, value from ({_cleaning_sql("collected")})
 union all select 'rebuild', name, value from ({_rebuild_sql("cleaned", "rebuilt")})
 union all select 'outputs', 'messages', count(*) from mine
 union all select 'outputs', 'conversations', count(distinct conversation_id) from mine
 union all select 'outputs', 'pairs', count(*) from again
 union all select 'violations', unnest({[c for c in _CHECKS if c != "pair_response_ids_unique"]!r}), 0
 union all select 'violations', 'pair_response_ids_unique', n from broken
 union all select 'settings', unnest(['random_seed', 'folds', 'closure_both_ways', 'strip_leading_mention']), unnest([42, 5, 0, 1])
 union all select 'input', 'rows', count(*) from v1d
 union all select 'closure', 'author_rows', count(*) from collected where author_id = 'agent'
 union all select 'closure', 'collected_rows', count(*) from collected
 union all select 'closure', 'dangling_references', count(distinct id) from named where id not in (select tweet_id from v1d)
 union all select 'stages', 'load', count(*) from collected
 union all select 'stages', 'validate_schema', count(*) from v1d
 union all select 'stages', 'clean', count(*) from cleaned
 union all select 'stages', 'reconstruct', count(*) from rebuilt
 union all select 'stages', 'filter_author', count(*) from mine
 union all select 'stages', 'extract_pairs', count(*) from again
 union all select 'stages', 'validate_outputs', 7 - (n > 0)::int from broken)"""


def _planted_ledger(t: Tables) -> DataFrame:
    """The ledger of a run in whose pairs some replies are used twice."""
    if "ledger" not in t.memo:
        pairs_ = t.run.pairs.unionByName(t.run.pairs.filter("turn % 3 = 1"))
        written = ledger.write_outputs(dataclasses.replace(t.run, pairs=pairs_), t.scratch("run"))
        t.memo["ledger"] = stash(ledger.ledger(written), "ledger")
    return t.memo["ledger"]


@query("run_ledger", f"with recursive {_PLANTED} select section, name, value from entries")
def run_ledger(t: Tables) -> DataFrame:
    return _planted_ledger(t).filter("not (section = 'input' and name = 'files')")  # SQL does not see files


@query(
    "run_stages",
    f"""with recursive {_PLANTED}, warned as (select unnest([2, 4, 7]) as no, unnest([
  (select max(value) from entries where section = 'empty'), (select value from entries where name = 'cyclic_tweets_skipped'), (select max(value) from entries where section = 'violations')]) as n)
 select no::int as stage_no, name as stage, case when n > 0 then 'WARN' else 'OK' end as status, value as rows from
 (select *, list_position({[s for s, _ in ledger.STAGES]!r}, name) as no from entries where section = 'stages') left join warned using (no)""",
)
def run_stages(t: Tables) -> DataFrame:
    return ledger.stages(_planted_ledger(t))


@query("reload_types", f"with {V1} select tweet_id, inbound, turn, conversation_id, text, length(response_tweet_id) > 0 as has_children from t1")
def reload_types(t: Tables) -> DataFrame:
    path = t.scratch("flat")
    sinks.write_messages(t.t1, path, "csv")
    back = message_sources.read_prepared(t.spark, path, "csv")
    return back.select("tweet_id", "inbound", "turn", "conversation_id", "text", (F.size("response_ids") > 0).alias("has_children"))


@query("row_limit_half", f"with {V2} select tweet_id, file_pos from v2 order by file_pos limit (select count(*) // 2 from v2)")
def row_limit_half(t: Tables) -> DataFrame:
    """A cut too large for one task to merge."""
    return message_sources.first_rows(t.v2, t.v2.count() // 2).select("tweet_id", "file_pos")


@query("row_sample_half", f"with {V2} select tweet_id from v2 order by md5('42:' || tweet_id), tweet_id limit (select count(*) // 2 from v2)")
def row_sample_half(t: Tables) -> DataFrame:
    return message_sources.sample_rows(t.v2, t.v2.count() // 2).select("tweet_id")


# --- Projections and filters -------------------------------------------------------------------------------
@query("parse_children", f"with {V2} select tweet_id, unnest(string_split(response_tweet_id, ',')) as child from v2 where response_tweet_id <> ''")
def parse_children(t: Tables) -> DataFrame:
    return t.v2.select("tweet_id", F.explode(split_ids(F.col("response_tweet_id"))).alias("child"))


@query(
    "parse_ts",
    f"with {V2} select tweet_id, created_at, epoch_us(try_strptime(created_at, '%a %b %d %H:%M:%S %z %Y')) as micros from v2",
)
def parse_ts(t: Tables) -> DataFrame:
    return t.v2.select("tweet_id", "created_at", F.unix_micros("ts").alias("micros"))


@query("clean_text", f"with {V1D} select file_pos, {clean_sql('text')} as text from v1d")
def clean(t: Tables) -> DataFrame:
    return cleaning.clean_messages(t.v1d).select("file_pos", "text")


@query("clean_text_keep_mention", f"with {V1D} select file_pos, {clean_sql('text', mention=False)} as text from v1d")
def clean_keep(t: Tables) -> DataFrame:
    return cleaning.clean_messages(t.v1d, strip_leading_mention=False).select("file_pos", "text")


@query("drop_bad_ids", f"with {V1D} select file_pos, tweet_id, author_id from v1d where tweet_id <> '' and author_id <> ''")
def bad_ids(t: Tables) -> DataFrame:
    return cleaning.drop_bad_ids(t.v1d).select("file_pos", "tweet_id", "author_id")


@query("drop_empty_text", f"with {V1D} select file_pos from v1d where {clean_sql('text')} <> ''")
def empty_text(t: Tables) -> DataFrame:
    return cleaning.drop_empty_text(cleaning.clean_messages(t.v1d)).select("file_pos")


@query("openers", f"with {V1} select conversation_id, tweet_id, text from t1 where turn = 1 and inbound")
def openers(t: Tables) -> DataFrame:
    return sampling.openers(t.t1).select("conversation_id", "tweet_id", "text")


@query("valid_label", f"with {V4} select conversation_id, l as label, list_contains({list(LABELS)!r}, l) as valid from (select conversation_id, unnest([label, lang]) as l from v4 join documents using (doc_id))")
def valid_label(t: Tables) -> DataFrame:
    both = t.v4.join(t.documents.select("doc_id", "lang"), "doc_id")
    stacked = both.select("conversation_id", F.explode(F.array("label", "lang")).alias("label"))
    return quality.valid_label(stacked)


@query("clip_text", "select doc_id, case when length(text) > 160 then substring(text, 1, 160) || '…' else text end as report_clip, case when length(text) > 240 then substring(text, 1, 239) || '…' else text end as display_clip from documents")
def clip_text(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select(
        "doc_id", clip(text, 160).alias("report_clip"), clip(text, 240, keep=239).alias("display_clip")
    )


@query(
    "signal_flags",
    f"with {V3}, {TAXONOMY_SQL} select conversation_id, label, priority, label in ('billing_purchases', 'repair_warranty', 'security_privacy', 'support_process', 'other') as typically_escalated from v3 join tax using (label)",
)
def flags(t: Tables) -> DataFrame:
    return signal_flags(t.v3).select("conversation_id", "label", "priority", "typically_escalated")


# --- Closure and threads -----------------------------------------------------------------------------------
_REACH = f"""{V2}, {links_sql("v2")},
reach as (select tweet_id as id from v2 where author_id = 'purchase' and in_response_to_tweet_id <> ''
  union select pl.dst from pl join reach on pl.src = reach.id)"""


def _asked(t: Tables) -> DataFrame:
    """V2 in which only replies by 'purchase' count as that author's."""
    own = (F.col("author_id") == "purchase") & (F.col("in_response_to_tweet_id") == "")
    return t.v2.withColumn("author_id", F.when(own, "starter").otherwise(F.col("author_id")))


@query("thread_closure", f"with recursive {_REACH} select v2.tweet_id, v2.text from v2 where tweet_id in (select id from reach)")
def thread_closure(t: Tables) -> DataFrame:
    return closure.thread_closure(_asked(t), "purchase").select("tweet_id", "text")


@query(
    "thread_closure_component",
    f"""with recursive {V2}, {links_sql("v2")}, sym as (select src, dst from pl union select dst, src from pl),
 reach as (select tweet_id as id from v2 where author_id = 'purchase' union select sym.dst from sym join reach on sym.src = reach.id)
 select v2.tweet_id from v2 where tweet_id in (select id from reach)""",
)
def thread_closure_component(t: Tables) -> DataFrame:
    return closure.thread_closure(t.v2, "purchase", mode="component").select("tweet_id")


@query(
    "thread_closure_bounded",
    f"""with recursive {V2}, {links_sql("v2")},
 reach as (select tweet_id as id, 0 as d from v2 where author_id = 'purchase'
  union select pl.dst, d + 1 from pl join reach on pl.src = reach.id where d < 3),
 best as (select id, min(d) as d from reach group by 1)
 select id as tweet_id, d as round, not exists (select 1 from best where d = 3) as converged from best where d <= 2""",
)
def thread_closure_bounded(t: Tables) -> DataFrame:
    return closure.thread_closure_bounded(t.v2, "purchase", max_rounds=2)


def _one_way(view: str, author: str) -> str:
    return f"""up_{view} as (select tweet_id as id from {view} where author_id = '{author}'
  union select v.in_response_to_tweet_id from {view} v join up_{view} u on v.tweet_id = u.id
   semi join {view} p on p.tweet_id = v.in_response_to_tweet_id)"""


@query(
    "thread_closure_one_way",
    f"""with recursive {V1}, {V2}, {_one_way("v1", "agent")}, {_one_way("v2", "purchase")}
 select 'v1' as view, tweet_id, text from v1 where tweet_id in (select id from up_v1)
 union all select 'v2', tweet_id, text from v2 where tweet_id in (select id from up_v2)""",
)
def thread_closure_one_way(t: Tables) -> DataFrame:
    """Tables without child lists: every link is declared by the reply alone."""
    unlisted = lambda view: view.withColumn("response_ids", F.expr("cast(array() as array<string>)"))
    found = [closure.thread_closure(unlisted(v), author).select(F.lit(name).alias("view"), "tweet_id", "text") for name, v, author in (("v1", t.v1, "agent"), ("v2", t.v2, "purchase"))]
    return union_all(*found)


@query("dangling_refs", f"with {V2}, {links_sql('v2')} select distinct dst as tweet_id from lk where dst not in (select tweet_id from v2)")
def dangling_refs(t: Tables) -> DataFrame:
    return closure.dangling_refs(t.v2)


@query(
    "closure_in_frame",
    f"""with recursive {V1}, {links_sql("v1")}, reach as (select tweet_id as id from v1 where author_id = 'system'
  union select pl.dst from pl join reach on pl.src = reach.id)
 select tweet_id, file_pos from v1 where tweet_id in (select id from reach)""",
)
def closure_in_frame(t: Tables) -> DataFrame:
    return closure.closure_in_frame(t.v1, "system").select("tweet_id", "file_pos")


@query(
    "reply_edges",
    f"""with {V2} select v.tweet_id, v.in_response_to_tweet_id as parent_id, p.tweet_id is not null as parent_present,
 v.tweet_id = v.in_response_to_tweet_id as self_parent from v2 v left join v2 p on v.in_response_to_tweet_id = p.tweet_id
 where v.in_response_to_tweet_id <> ''""",
)
def reply_edges(t: Tables) -> DataFrame:
    return threads.reply_edges(t.v2)


@query(
    "link_diagnostics",
    f"with {V2}, {_diag_sql('v2')} select 'dangling_child_links' as name, dangling as value from diag union all select 'parent_link_mismatches', mismatches from diag",
)
def link_diagnostics(t: Tables) -> DataFrame:
    return threads.link_diagnostics(t.v2)


@query(
    "thread_roots",
    f"""with {V2} select v.tweet_id, v.in_response_to_tweet_id <> '' as partial from v2 v left join v2 p
 on v.in_response_to_tweet_id = p.tweet_id where p.tweet_id is null""",
)
def thread_roots(t: Tables) -> DataFrame:
    return threads.thread_roots(t.v2)


@query("reconstruct_threads", f"with recursive {V2T} select tweet_id, conversation_id, turn from t2")
def reconstruct(t: Tables) -> DataFrame:
    return threads.reconstruct_threads(t.v2).select("tweet_id", "conversation_id", "turn")


@query("reconstruct_linear", f"with {V1} select tweet_id, conversation_id, turn from t1")
def reconstruct_linear(t: Tables) -> DataFrame:
    return threads.reconstruct_threads(t.v1).select("tweet_id", "conversation_id", "turn")


@query("unreachable_nodes", f"with recursive {V2T} select tweet_id, in_response_to_tweet_id from v2 where tweet_id not in (select tweet_id from t2)")
def unreachable(t: Tables) -> DataFrame:
    return threads.unreachable_messages(t.v2, t.t2)


@query("reconstruction_stats", f"with recursive {V2T}, {_diag_sql('v2')} {_rebuild_sql('v2', 't2')}")
def stats(t: Tables) -> DataFrame:
    return threads.reconstruction_stats(t.v2, t.t2)


@query(
    "sibling_rank",
    f"""with {V2} select v.tweet_id, v.in_response_to_tweet_id as parent_id,
 row_number() over (partition by v.in_response_to_tweet_id order by v.ts nulls last, v.file_pos) as sibling_rank
 from v2 v semi join v2 p on v.in_response_to_tweet_id = p.tweet_id where v.in_response_to_tweet_id <> v.tweet_id""",
)
def sibling_rank(t: Tables) -> DataFrame:
    return threads.sibling_rank(t.v2).select(
        F.col("id").alias("tweet_id"), F.col("parent").alias("parent_id"), F.col("rank").alias("sibling_rank")
    )


@query("turn_number", f"with recursive {V2T} select conversation_id, turn, tweet_id, author_id from t2")
def turn_number(t: Tables) -> DataFrame:
    return t.t2.select("conversation_id", "turn", "tweet_id", "author_id")


@query("id_union", f"with {V2} select distinct id as tweet_id from (select in_response_to_tweet_id as id from v2 union all select unnest(string_split(response_tweet_id, ',')) from v2) where id <> ''")
def id_union(t: Tables) -> DataFrame:
    return closure.referenced_ids(t.v2)


@query("id_except", f"with {V2} select tweet_id from v2 except select unnest(string_split(response_tweet_id, ',')) from v2")
def id_except(t: Tables) -> DataFrame:
    listed = threads.listed_children(t.v2).select(F.col("child_id").alias("tweet_id"))
    return t.v2.select("tweet_id").subtract(listed)


# --- Joins -------------------------------------------------------------------------------------------------
PAIR = (
    "conversation_id, customer_tweet_id, response_tweet_id, tweet_ids, customer_message, support_response, "
    "customer_created_at, response_created_at, created_at, turn"
)


@query("support_pairs", f"with recursive {V2T} select {PAIR} from p2")
def support_pairs(t: Tables) -> DataFrame:
    return pairs.support_pairs(t.t2, "signup")


@query("support_pairs_linear", f"with {V1} select {PAIR} from p1")
def support_pairs_linear(t: Tables) -> DataFrame:
    return pairs.support_pairs(t.t1, "agent")


@query("convs_with_author", f"with recursive {V2T} select tweet_id, conversation_id, turn from t2 where conversation_id in (select conversation_id from t2 where author_id = 'signup')")
def convs_with_author(t: Tables) -> DataFrame:
    return threads.convs_with_author(t.t2, "signup").select("tweet_id", "conversation_id", "turn")


@query("membership_filter", "select doc_id, lang from documents where doc_id in (select doc_id from labels)")
def membership_filter(t: Tables) -> DataFrame:
    return pairs.members(t.documents, t.table("labels"), "doc_id").select("doc_id", "lang")


@query("pair_conv_sizes", f"with recursive {V2T} select response_tweet_id, coalesce(c.tweets, p2.turn) as turns from p2 left join (select * from c2 where support_tweets > 5) c using (conversation_id)")
def pair_conv_sizes(t: Tables) -> DataFrame:
    known = t.c2.filter("support_tweets > 5")
    return pairs.pair_sizes(t.p2, known).select("response_tweet_id", "turns")


@query("attach_labels", f"with {V4} select doc_id::varchar as conversation_id, length(d.text) as chars, v4.label from documents d join v4 using (doc_id)")
def attach_labels(t: Tables) -> DataFrame:
    sheet = t.documents.select(F.col("doc_id").cast("string").alias("conversation_id"), F.length("text").alias("chars"))
    return pairs.attach_labels(sheet, t.v4)


@query("golden_isolation", f"with {V4} select doc_id::varchar as conversation_id, text from documents where doc_id not in (select doc_id from v4)")
def golden_isolation(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").cast("string").alias("conversation_id"), "text")
    return pairs.without(docs, t.v4)


@query(
    "label_coverage",
    f"""with {V3}, d as (select doc_id::varchar as conversation_id from documents)
 select 'missing_label' as problem, conversation_id from d where conversation_id not in (select conversation_id from v3)
 union all select 'unknown_id', conversation_id from v3 where conversation_id not in (select conversation_id from d)""",
)
def label_coverage(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").cast("string").alias("conversation_id"))
    return quality.label_coverage(docs, t.v3)




@query(
    "ref_integrity",
    f"""with recursive {V2T}, known as (select * from t2 where author_id <> 'error')
 select 'customer_message' as kind, customer_tweet_id as id from p2 where customer_tweet_id not in (select tweet_id from known)
 union all select 'support_response', response_tweet_id from p2 where response_tweet_id not in (select tweet_id from known)
 union all select 'conversation', conversation_id from p2 where conversation_id not in (select conversation_id from c2 where tweets > 30)""",
)
def ref_integrity(t: Tables) -> DataFrame:
    return quality.ref_integrity(t.p2, t.t2.filter("author_id <> 'error'"), t.c2.filter("tweets > 30"))


# --- Profile and cleaning counters -------------------------------------------------------------------------
@query("dataset_profile", f"with {V1D} {_profile_sql('v1d')}")
def dataset_profile(t: Tables) -> DataFrame:
    return profile.dataset_profile(t.v1d)


@query("empty_by_column", f"with {V1D} {_empty_sql('v1d', MESSAGE_COLUMNS)}")
def empty_by_column(t: Tables) -> DataFrame:
    return profile.empty_by_column(t.v1d)


@query("top_outbound_authors", f"with {V2} select 'team ' || substring(text, 1, 14) as author_id, count(*) as tweets from v2 where not inbound group by 1 order by 2 desc, 1 limit 25")
def top_outbound_authors(t: Tables) -> DataFrame:
    named = t.v2.withColumn("author_id", F.concat(F.lit("team "), F.substring("text", 1, 14)))
    return profile.top_outbound_authors(named)


@query(
    "author_presence_check",
    f"""with {V2}, c as (select author_id, count(*) as tweets from v2 where not inbound group by 1 order by 2 desc, 1 limit 8)
 select 'nobody' as author_id, count(*) filter (author_id = 'nobody') as tweets, 'wanted' as role from v2
 union all select author_id, tweets, 'candidate' from c where author_id <> 'nobody'""",
)
def author_presence(t: Tables) -> DataFrame:
    return profile.author_presence(t.v2, "nobody")


@query("cleaning_report", f"with {V1D} {_cleaning_sql('v1d')}")
def cleaning_report(t: Tables) -> DataFrame:
    return cleaning.cleaning_report(t.v1d)


@query(
    "dedup_first",
    f"""with {V1D}, c as (select *, {clean_sql('text')} as ct from v1d where tweet_id <> '' and author_id <> ''),
 n as (select *, row_number() over (partition by tweet_id order by file_pos) as rn from c where ct <> '')
 select tweet_id, file_pos, ct as text from n where rn = 1""",
)
def dedup_first(t: Tables) -> DataFrame:
    return cleaning.preprocess(t.v1d).select("tweet_id", "file_pos", "text")


# --- Conversations -----------------------------------------------------------------------------------------
@query(
    "conversations_summary",
    f"""with recursive {V2T} select conversation_id, c2.tweets, customer_tweets, support_tweets, first_created_at, last_created_at,
 (select string_agg(tweet_id, ';' order by turn) from t2 where t2.conversation_id = c2.conversation_id) as tweet_ids from c2""",
)
def conversations_summary(t: Tables) -> DataFrame:
    return threads.conversations_summary(t.t2).withColumn("tweet_ids", F.concat_ws(";", "tweet_ids"))


@query("explode_threads", f"with recursive {V2T} select conversation_id, turn, tweet_id from t2")
def explode_threads(t: Tables) -> DataFrame:
    return threads.explode_threads(threads.conversations_summary(t.t2))


# --- Checks ------------------------------------------------------------------------------------------------
@query(
    "quality_gate",
    f"""with recursive {V2T}, known as (select * from t2 where author_id <> 'error')
 select name, violations = 0 as passed, violations from (
 select 'pair_ids_exist_in_tweets' as name, (select count(*) from p2 where customer_tweet_id not in (select tweet_id from known))
   + (select count(*) from p2 where response_tweet_id not in (select tweet_id from known)) as violations
 union all select 'pair_conversations_exist', (select count(*) from p2 where conversation_id not in (select conversation_id from c2))
 union all select 'pair_messages_non_empty', (select count(*) from p2 where customer_message = '' or support_response = '')
 union all select 'pair_response_ids_unique', (select count(*) from (select 1 from p2 group by response_tweet_id having count(*) > 1))
 union all select 'pair_responses_by_support_author', (select count(*) from p2 where response_tweet_id not in (select tweet_id from known where author_id = 'signup'))
 union all select 'conversation_ids_unique', 0
 union all select 'tweets_have_conversation_id', 0)""",
)
def quality_gate(t: Tables) -> DataFrame:
    known = t.t2.filter("author_id <> 'error'")
    return quality.quality_gate(known, t.c2, t.p2, "signup").drop("detail")


@query(
    "quality_gate_planted",
    f"""with recursive {V2T}, twice as (select conversation_id from c2 union all select conversation_id from c2 where tweets % 5 = 0),
 bad as (select count(*) filter (file_pos % 9 = 0) as lost, count(*) filter (file_pos % 9 = 1) as blank from t2),
 odd as (select * replace (case when turn % 4 = 0 then '' else support_response end as support_response,
  case when turn % 6 = 0 then null else customer_tweet_id end as customer_tweet_id) from p2 union all select * from p2 where turn % 7 = 2)
 select name, n = 0 as passed, n as violations from (
 select 'pair_ids_exist_in_tweets' as name, (select count(*) from odd where customer_tweet_id is null) as n
 union all select 'pair_conversations_exist', 0
 union all select 'pair_messages_non_empty', (select count(*) from odd where customer_message = '' or support_response = '')
 union all select 'pair_response_ids_unique', (select count(*) from (select 1 from odd group by response_tweet_id having count(*) > 1))
 union all select 'pair_responses_by_support_author', 0
 union all select 'conversation_ids_unique', (select count(*) from (select 1 from twice group by conversation_id having count(*) > 1))
 union all select 'tweets_have_conversation_id', (select lost + blank from bad))""",
)
def quality_gate_planted(t: Tables) -> DataFrame:
    """The checks on tables with planted faults: conversations listed twice, messages without one, empty, repeated and dangling pairs."""
    pos, turn = F.col("file_pos") % 9, F.col("turn")
    threads_ = t.t2.withColumn("conversation_id", F.when(pos == 0, None).when(pos == 1, "").otherwise(F.col("conversation_id")))
    odd = t.p2.withColumn("support_response", F.when(turn % 4 == 0, "").otherwise(F.col("support_response")))
    odd = odd.withColumn("customer_tweet_id", F.when(turn % 6 != 0, F.col("customer_tweet_id"))).unionByName(t.p2.filter(turn % 7 == 2))
    return quality.quality_gate(threads_, t.c2.unionByName(t.c2.filter("tweets % 5 = 0")), odd, "signup").drop("detail")


@query(
    "golden_gate",
    f"""with {V3}, {V4}, lab as (select conversation_id, label from v3 union all select conversation_id, 'no such class' from v4 where label = 'general_complaint' and conversation_id not in (select conversation_id from v3)),
 sheet as (select doc_id::varchar as conversation_id from documents)
 select name, n = 0 as passed, n as violations from (
 select 'worksheet_ids_unique' as name, 0 as n
 union all select 'all_labelled', (select count(*) from sheet where conversation_id not in (select conversation_id from lab))
 union all select 'no_unknown_ids', (select count(*) from lab where conversation_id not in (select conversation_id from sheet))
 union all select 'labels_valid', (select count(*) from lab where label = 'no such class'))""",
)
def golden_gate(t: Tables) -> DataFrame:
    sheet = t.documents.select(F.col("doc_id").cast("string").alias("conversation_id"))
    named = t.v3.select("conversation_id", "label")
    odd = t.v4.filter("label = 'general_complaint'").join(named, "conversation_id", "left_anti")
    odd = odd.select("conversation_id", F.lit("no such class").alias("label"))
    return quality.golden_gate(sheet, named.unionByName(odd)).drop("detail")


@query(
    "reconcile",
    f"""with recursive {V2T}, a as (select 'conversations' as name, count(*) as v from c2 union all select 'messages', sum(tweets)::bigint from c2
   union all select 'pairs', count(*) from p2),
 b as (select 'conversations' as name, count(distinct conversation_id) as v from t2 union all select 'messages', count(*) from v2
   union all select 'replies', count(*) from t2 where author_id = 'signup')
 select name, a.v as computed, b.v as expected, coalesce(a.v = b.v, false) as matches from a full join b using (name)""",
)
def reconcile(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    computed = union_all(
        unpivot(t.c2.agg(n.alias("conversations"), F.sum("tweets").alias("messages"))), unpivot(t.p2.agg(n.alias("pairs")))
    )
    expected = union_all(
        unpivot(t.t2.agg(F.count_distinct("conversation_id").alias("conversations"), F.count_if(F.col("author_id") == "signup").alias("replies"))),
        unpivot(t.v2.agg(n.alias("messages"))),
    )
    return quality.reconcile(computed, expected)


@query(
    "sum_consistency",
    f"""with recursive {V2T} select 'inbound' as name, sum(customer_tweets)::bigint as computed, (select count(*) from t2 where inbound) as expected, true as matches from c2
 union all select 'outbound', sum(support_tweets)::bigint, (select count(*) from t2 where not inbound), true from c2""",
)
def sum_consistency(t: Tables) -> DataFrame:
    return quality.sum_consistency(t.t2, t.c2)
