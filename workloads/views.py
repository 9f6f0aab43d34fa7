"""Message, vector and labelled-text views over the benchmark tables, in Spark and in SQL from the same formulas."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.constants import LABELS
from replyloom.operators.threads import conversation_totals, reconstruct_threads
from replyloom.operators.pairs import support_pairs
from replyloom.plans.prepare import Prepared, prepare
from replyloom.session import scratch_path, ship, stash
from replyloom.sources.messages import normalise, with_types

SEED = 42

#: Topics for the invented prose of the documents: (topic, label, keywords).
WORD_TOPICS = (
    ("English", "software_bug", ("the", "and", "of")),
    ("French", "device_hardware", ("de", "le", "la")),
    ("German", "account_icloud", ("der", "die", "und")),
    ("Spanish", "connectivity", ("el", "los", "que")),
    ("Shared", "general_complaint", ("en", "an", "un", "is")),
)

_CACHE: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The views of one session and folder. Rebuilt threads are written once and shared, as a user would do."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        ship(spark, "replyloom", "workloads")
        _CACHE[key] = Tables(spark, sf_dir)
    return _CACHE[key]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.memo: dict[str, object] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        """The documents; a folder of fewer files than cores is spread over them, as one file is read by one task."""
        df, cores = self.table("documents"), self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if len(df.inputFiles()) < cores else df

    # V1: linear threads --------------------------------------------------------------------------------
    def _linear(self) -> DataFrame:
        c = self.table("conversations")
        after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("has_next"))
        before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("has_prev"))
        name = lambda turn: F.concat_ws("_", "conv_id", turn)
        return (
            c.join(after, ["conv_id", "turn"], "left")
            .join(before, ["conv_id", "turn"], "left")
            .select(
                name(F.col("turn")).alias("tweet_id"),
                F.when(F.col("role") == "user", F.concat(F.lit("u"), "conv_id"))
                .when(F.col("role") == "assistant", "agent")
                .otherwise("system")
                .alias("author_id"),
                F.when(F.col("role") == "user", "True").when(F.col("role") == "assistant", "False").otherwise("n/a").alias("inbound"),
                F.lit("").alias("created_at"),
                "text",
                F.when(F.col("has_next"), name(F.col("turn") + 1)).otherwise("").alias("response_tweet_id"),
                F.when(F.col("has_prev"), name(F.col("turn") - 1)).otherwise("").alias("in_response_to_tweet_id"),
                (F.col("conv_id") * 1000 + F.col("turn")).alias("file_pos"),
                "conv_id",
                F.col("turn").alias("_turn"),
            )
        )

    @staticmethod
    def _ingested(raw: DataFrame, name: str) -> DataFrame:
        """The typed message table, written once as an ingest would."""
        return stash(with_types(normalise(raw.withColumn("inbound_raw", F.col("inbound")))), name)

    @cached_property
    def v1(self) -> DataFrame:
        return self._ingested(self._linear().drop("conv_id", "_turn"), "v1")

    # V1d: V1 with planted noise ------------------------------------------------------------------------
    @cached_property
    def v1d(self) -> DataFrame:
        turn, conv = F.col("_turn"), F.col("conv_id")
        body = F.when((conv + turn) % 17 == 0, "").otherwise(F.col("text"))
        prefix = F.when(turn % 5 == 0, "@agent ").when(turn % 5 == 1, "RT @u_1: ").when(turn % 5 == 2, " @agent ").otherwise("")
        suffix = F.when(turn % 3 == 0, " http://e.com/p.png   x").when(turn % 4 == 1, " &amp; more").otherwise("")
        raw = (
            self._linear()
            .withColumn("text", F.concat(prefix, body, suffix))
            .withColumn("author_id", F.when((conv % 29 == 0) & (turn == 1), "").otherwise(F.col("author_id")))
            .withColumn("tweet_id", F.when((conv % 31 == 0) & (turn == 2), "").otherwise(F.col("tweet_id")))
        )
        again = raw.filter(turn % 7 == 3).withColumn("file_pos", F.col("file_pos") + 10**9)
        return self._ingested(raw.unionByName(again).drop("conv_id", "_turn"), "v1d")

    # V2: branching trees with orphans, cycles, one-way and dangling links ------------------------------
    @cached_property
    def v2(self) -> DataFrame:
        e, block = F.col("event_id"), F.floor(F.col("event_id") / 40)
        root = F.when(block % 50 == 7, e + 3).when(block % 50 == 9, e)
        parent = (
            F.when(e % 40 == 0, root)
            .when(e % 397 == 0, e + 10**9)
            .otherwise(F.greatest(block * 40, e - 1 - e % 5))
        )
        named = lambda c: F.concat(F.lit("e"), c.cast("string"))
        ev = self.table("events").withColumn("parent", parent)
        kids = (
            ev.filter((F.col("parent") != e) & (e % 7 != 0))
            .groupBy(F.col("parent").alias("event_id"))
            .agg(F.sort_array(F.collect_list("event_id")).alias("kids"))
        )
        listed = F.concat(
            F.coalesce(F.transform("kids", named), F.array().cast("array<string>")),
            F.when(e % 11 == 0, F.array(named(e + 2 * 10**9))).otherwise(F.array().cast("array<string>")),
            F.when(e % 13 == 0, F.array(named(e + 2))).otherwise(F.array().cast("array<string>")),
        )
        stamp = F.date_format(F.date_trunc("hour", "ts"), "EEE MMM dd HH:mm:ss")
        raw = ev.join(kids, "event_id", "left").select(
            named(e).alias("tweet_id"),
            F.col("event_type").alias("author_id"),
            F.when(F.col("event_type") == "signup", "False").otherwise("True").alias("inbound"),
            F.when(F.col("event_type") == "error", "n/a")
            .otherwise(F.concat(stamp, F.lit(" +0000 "), F.date_format("ts", "yyyy")))
            .alias("created_at"),
            F.concat_ws(" ", "event_type", "props").alias("text"),
            F.array_join(listed, ",").alias("response_tweet_id"),
            F.coalesce(named(F.col("parent")), F.lit("")).alias("in_response_to_tweet_id"),
            (F.lit(10**12) - e).alias("file_pos"),
        )
        return self._ingested(raw, "v2")

    # Rebuilt threads, written once ---------------------------------------------------------------------
    @cached_property
    def t1(self) -> DataFrame:
        return stash(reconstruct_threads(self.v1), "threads-v1")

    @cached_property
    def t2(self) -> DataFrame:
        return stash(reconstruct_threads(self.v2), "threads-v2")

    @cached_property
    def c1(self) -> DataFrame:
        return conversation_totals(self.t1)

    @cached_property
    def c2(self) -> DataFrame:
        return conversation_totals(self.t2)

    @cached_property
    def p1(self) -> DataFrame:
        return support_pairs(self.t1, "agent")

    @cached_property
    def p2(self) -> DataFrame:
        return support_pairs(self.t2, "signup")

    @cached_property
    def run(self) -> Prepared:
        return prepare(self.v1d, "agent")

    # V3: labelled vectors; V4: labelled text -----------------------------------------------------------
    @cached_property
    def v3(self) -> DataFrame:
        names = F.array(*[F.lit(x) for x in LABELS])
        return self.table("embeddings").select(
            F.col("vec_id").cast("string").alias("conversation_id"),
            F.col("embedding").alias("vector"),
            names[F.col("label")].alias("label"),
        )

    @cached_property
    def v4(self) -> DataFrame:
        label = (
            F.when(F.col("toxic") == 1, "security_privacy")
            .when(F.col("quality") == 0, "general_complaint")
            .when(F.col("lang") == "en", "software_bug")
            .when(F.col("lang") == "fr", "device_hardware")
            .when(F.col("lang") == "de", "account_icloud")
            .otherwise("connectivity")
        )
        return (
            self.documents.join(self.table("labels"), "doc_id")
            .select("doc_id", F.col("doc_id").cast("string").alias("conversation_id"), "text", label.alias("label"))
        )

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)


# --- The same views for the checker -----------------------------------------------------------------------
_LINEAR = """
lin as (select c.conv_id, c.turn as t, c.conv_id || '_' || c.turn as tweet_id,
  case c.role when 'user' then 'u' || c.conv_id when 'assistant' then 'agent' else 'system' end as author_id,
  case c.role when 'user' then 'True' when 'assistant' then 'False' else 'n/a' end as inbound_raw,
  c.role = 'user' as inbound, '' as created_at, c.text,
  case when n.turn is not null then c.conv_id || '_' || (c.turn + 1) else '' end as response_tweet_id,
  case when p.turn is not null then c.conv_id || '_' || (c.turn - 1) else '' end as in_response_to_tweet_id,
  c.conv_id * 1000 + c.turn as file_pos
 from conversations c left join conversations n on n.conv_id = c.conv_id and n.turn = c.turn + 1
 left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1)"""

V1 = _LINEAR + """,
v1 as (select * from lin),
t1 as (select *, conv_id || '_0' as conversation_id, t + 1 as turn from lin),
c1 as (select conversation_id, count(*) as tweets, count(*) filter (inbound) as customer_tweets,
  count(*) filter (not inbound) as support_tweets, '' as first_created_at, '' as last_created_at from t1 group by 1),
p1 as (select r.conversation_id, q.tweet_id as customer_tweet_id, r.tweet_id as response_tweet_id,
  q.tweet_id || ';' || r.tweet_id as tweet_ids, q.text as customer_message, r.text as support_response,
  q.created_at as customer_created_at, r.created_at as response_created_at, q.created_at, r.turn
  from t1 r join t1 q on r.in_response_to_tweet_id = q.tweet_id where r.author_id = 'agent' and q.inbound)"""

SPACE = r"[\t-\r\x1C-\x1F\x85\p{Z}]"
NONSPACE = r"[^\t-\r\x1C-\x1F\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+\z', '', 'g')"


def collapse_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def clean_sql(x: str, mention: bool = True) -> str:
    """Cleaning for texts whose only entity is ``&amp;``, as in V1d."""
    out = f"replace({x}, '&amp;', '&')"
    out = rf"regexp_replace({out}, '(?i)^RT{SPACE}+@{WORD}+{SPACE}*:?{SPACE}*', '')"
    out = rf"regexp_replace({out}, 'https?://{NONSPACE}+|www\.{NONSPACE}+', ' ', 'g')"
    if mention:
        out = rf"regexp_replace({out}, '^@{WORD}+{SPACE}*', '')"
    return collapse_sql(out)


V1D = _LINEAR + """,
dec as (select * replace (
  (case t % 5 when 0 then '@agent ' when 1 then 'RT @u_1: ' when 2 then ' @agent ' else '' end)
   || (case when (conv_id + t) % 17 = 0 then '' else text end)
   || (case when t % 3 = 0 then ' http://e.com/p.png   x' when t % 4 = 1 then ' &amp; more' else '' end) as text,
  case when conv_id % 29 = 0 and t = 1 then '' else author_id end as author_id,
  case when conv_id % 31 = 0 and t = 2 then '' else tweet_id end as tweet_id) from lin),
v1d as (select * from dec union all
  select * replace (file_pos + 1000000000 as file_pos) from dec where t % 7 = 3)"""

V2 = """
ev as (select *, event_id // 40 as block, case when event_id % 40 = 0 then
    case when (event_id // 40) % 50 = 7 then event_id + 3 when (event_id // 40) % 50 = 9 then event_id end
  when event_id % 397 = 0 then event_id + 1000000000
  else greatest((event_id // 40) * 40, event_id - 1 - event_id % 5) end as par from events),
kids as (select par, string_agg('e' || event_id, ',' order by event_id) as l from ev
  where par <> event_id and event_id % 7 <> 0 group by 1),
v2 as (select 'e' || e.event_id as tweet_id, e.event_type as author_id, e.event_type <> 'signup' as inbound,
  case when e.event_type = 'signup' then 'False' else 'True' end as inbound_raw,
  case when e.event_type = 'error' then 'n/a'
   else strftime(date_trunc('hour', e.ts), '%a %b %d %H:%M:%S +0000 %Y') end as created_at,
  case when e.event_type = 'error' then null else date_trunc('hour', e.ts) end as ts,
  e.event_type || ' ' || e.props as text,
  concat_ws(',', k.l, case when e.event_id % 11 = 0 then 'e' || (e.event_id + 2000000000) end,
   case when e.event_id % 13 = 0 then 'e' || (e.event_id + 2) end) as response_tweet_id,
  coalesce('e' || e.par, '') as in_response_to_tweet_id, 1000000000000 - e.event_id as file_pos
  from ev e left join kids k on k.par = e.event_id)"""


def threads_sql(source: str, name: str) -> str:
    """Reading order by recursive descent over a table with ``ts`` and ``file_pos``."""
    return f"""
{name}_e as (select v.*, q.tweet_id as p from {source} v left join {source} q on v.in_response_to_tweet_id = q.tweet_id),
{name}_k as (select *, row_number() over (partition by p order by ts nulls last, file_pos) as rk from {name}_e),
{name}_t as (select tweet_id, tweet_id as conversation_id, []::bigint[] as path from {name}_k where p is null
  union all select k.tweet_id, t.conversation_id, list_append(t.path, k.rk) from {name}_k k join {name}_t t on k.p = t.tweet_id),
{name} as (select v.*, t.conversation_id,
  row_number() over (partition by t.conversation_id order by t.path) as turn
  from {name}_t t join {source} v using (tweet_id))"""


V2T = V2 + "," + threads_sql("v2", "t2") + """,
c2 as (select conversation_id, count(*) as tweets, count(*) filter (inbound) as customer_tweets,
  count(*) filter (not inbound) as support_tweets, min_by(created_at, turn) as first_created_at,
  max_by(created_at, turn) as last_created_at from t2 group by 1),
p2 as (select r.conversation_id, q.tweet_id as customer_tweet_id, r.tweet_id as response_tweet_id,
  q.tweet_id || ';' || r.tweet_id as tweet_ids, q.text as customer_message, r.text as support_response,
  q.created_at as customer_created_at, r.created_at as response_created_at, q.created_at, r.turn
  from t2 r join t2 q on r.in_response_to_tweet_id = q.tweet_id and r.conversation_id = q.conversation_id
  where r.author_id = 'signup' and q.inbound)"""


def links_sql(source: str) -> str:
    return f"""
lk as (select distinct src, dst from (
   select tweet_id as src, in_response_to_tweet_id as dst from {source}
   union all select tweet_id, unnest(string_split(response_tweet_id, ',')) from {source}) where dst <> '' and src <> dst),
pl as (select lk.* from lk semi join {source} s on lk.dst = s.tweet_id)"""


_LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
V3 = f"""
v3 as (select vec_id::varchar as conversation_id, embedding::double[] as vector,
  ({_LABEL_LIST})[label + 1] as label from embeddings)"""
V4 = """
v4 as (select d.doc_id, d.doc_id::varchar as conversation_id, d.text, case when toxic = 1 then 'security_privacy'
  when quality = 0 then 'general_complaint' when lang = 'en' then 'software_bug' when lang = 'fr' then 'device_hardware'
  when lang = 'de' then 'account_icloud' else 'connectivity' end as label
  from documents d join labels using (doc_id))"""
TAXONOMY_SQL = "tax as (select unnest(range(10)) as priority, unnest(" + _LABEL_LIST + ") as label)"
