"""Queries on statistics, sampling, metrics and classifiers, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.constants import DISPLAY_STOPWORDS, MESSAGE_BUCKETS, TEXT_GRID, TOKEN_EDGE_CHARS, VECTOR_GRID
from replyloom.functions.text import content_key, content_tokens, decode_entities, keyword_label, tokens, topic_hits
from replyloom.functions.vectors import cosine, softmax
from replyloom.operators import embeddings, heads, metrics, phrases, profile, retrieval, sampling, selection, sketches, text_grid
from replyloom.operators import text_stats as ts
from replyloom.operators.features import term_counts, tfidf_weights, vocabulary
from replyloom.operators.pairs import without
from replyloom.operators.taxonomy import labels_present
from replyloom.operators.threads import conversation_totals, convs_with_author
from replyloom.plans import evaluate
from replyloom.session import stash
from replyloom.sources import labels as label_sources
from workloads.views import SPACE, TAXONOMY_SQL, V1, V1D, V2, V2T, V3, V4, WORD, WORD_TOPICS, Tables

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        Q[name] = (fn, sql)
        return fn

    return register


def _r(col: str, digits: int = 6):
    return F.round(col, digits).alias(col)


# --- Text functions ----------------------------------------------------------------------------------------
def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _tokens_sql(x: str) -> str:
    edge = TOKEN_EDGE_CHARS.replace("'", "''")
    return (
        rf"list_filter(list_transform(string_split_regex(lower({x}), '{SPACE}+'), lambda w: trim(w, '{edge}')), "
        r"lambda w: regexp_full_match(w, '\p{L}{3,}'))"
    )


def _content_sql(x: str) -> str:
    return f"list_filter({_tokens_sql(x)}, lambda w: w not in ({_quoted(DISPLAY_STOPWORDS)}))"


def _hit_sql(x: str, keywords, insensitive: bool = False) -> str:
    flag = "(?i)" if insensitive else ""
    return rf"regexp_matches({x}, '{flag}(^|[^\p{{L}}\p{{N}}_])({'|'.join(keywords)})($|[^\p{{L}}\p{{N}}_])')"


_HITS = (
    "list_filter(["
    + ", ".join(f"case when {_hit_sql('text', k)} then '{name}' end" for name, _, k in WORD_TOPICS)
    + "], lambda h: h is not null)"
)
_KEYWORD_LABEL = (
    "case " + " ".join(f"when {_hit_sql('text', k, True)} then '{label}'" for _, label, k in WORD_TOPICS) + " else 'other' end"
)
HITS = f"hits as (select doc_id, {_HITS} as h from documents)"
_WORDS = rf"len(list_filter(string_split_regex(text, '{SPACE}+'), lambda w: w <> ''))"


@query("tokenize", f"select doc_id, array_to_string({_tokens_sql('text')}, ' ') as tokens from documents")
def tokenize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat_ws(" ", tokens(F.col("text"))).alias("tokens"))


@query("stop_word_removal", f"select doc_id, array_to_string({_content_sql('text')}, ' ') as tokens from documents")
def stop_word_removal(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat_ws(" ", content_tokens(F.col("text"))).alias("tokens"))


@query("decode_entities", f"with {V1D} select file_pos, replace(text, '&amp;', '&') as text from v1d")
def decode(t: Tables) -> DataFrame:
    return t.v1d.select("file_pos", decode_entities(F.col("text")).alias("text"))


@query("keyword_topics", f"with {HITS} select doc_id, array_to_string(h, '|') as topics from hits")
def keyword_topics(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.concat_ws("|", topic_hits(F.col("text"), WORD_TOPICS)).alias("topics"))


@query("topic_match", f"with {HITS} select doc_id, unnest(h) as topic from hits")
def topic_match(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(topic_hits(F.col("text"), WORD_TOPICS)).alias("topic"))


@query("phrase_match", f"with {HITS} select doc_id, unnest(h) as topic from hits")
def phrase_match(t: Tables) -> DataFrame:
    """The rows of ``topic_match`` by a table of phrases instead of patterns."""
    return phrases.phrase_matches(t.documents, phrases.phrase_table(t.spark, WORD_TOPICS), "doc_id")


@query("keyword_label", f"select doc_id, {_KEYWORD_LABEL} as label from documents")
def label_by_keyword(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", keyword_label(F.col("text"), WORD_TOPICS).alias("label"))


@query("content_key", "select doc_id, substring(sha256(text || chr(0) || 'm1'), 1, 16) as key from documents")
def key_of_content(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", content_key(F.col("text"), "m1").alias("key"))


@query("date_format", f"with {V2} select tweet_id, strftime(ts, '%Y-%m-%d') as day from v2")
def date_format(t: Tables) -> DataFrame:
    return t.v2.select("tweet_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


# --- Corpus statistics -------------------------------------------------------------------------------------
@query(
    "corpus_summary",
    f"""with recursive {V2T}, m as (select count(*) n, count(*) filter (inbound) i, count(*) filter (not inbound) o, round(avg(length(text)), 1) ac,
   round(avg({_WORDS}), 1) aw, min_by(created_at, (ts, file_pos)) filter (ts is not null) ds,
   max_by(created_at, (ts, -file_pos)) filter (ts is not null) de from t2),
 c as (select count(*) n, round(avg(tweets), 2) a, max(tweets) mx, median(tweets) md from c2)
 select 'messages' as name, n::varchar as value from m union all select 'inbound', i::varchar from m
 union all select 'outbound', o::varchar from m union all select 'avg_message_chars', ac::varchar from m
 union all select 'avg_message_words', aw::varchar from m union all select 'date_start', ds from m union all select 'date_end', de from m
 union all select 'conversations', n::varchar from c union all select 'avg_conversation_turns', a::varchar from c
 union all select 'max_conversation_turns', mx::varchar from c union all select 'median_conversation_turns', md::varchar from c
 union all select 'support_pairs', count(*)::varchar from p2""",
)
def corpus_summary(t: Tables) -> DataFrame:
    return ts.corpus_summary(t.t2, t.c2, t.p2)


@query("inbound_distribution", f"with {V1} select 'inbound' as name, count(*) filter (inbound) as value from t1 union all select 'outbound', count(*) filter (not inbound) from t1")
def inbound_distribution(t: Tables) -> DataFrame:
    return profile.inbound_distribution(t.t1)


@query("thread_len_hist", f"with {V1}, n as (select least(tweets, 20) as turns, count(*) as c from c1 group by 1) select s.turns::int as turns, coalesce(c, 0) as count from (select unnest(range(1, 21)) as turns) s left join n using (turns) where coalesce(c, 0) > 0 or s.turns < 3")
def thread_len_hist(t: Tables) -> DataFrame:
    return ts.thread_length_histogram(t.c1)


@query(
    "msg_len_hist",
    " union all ".join(
        f"select {i} as position, '{name}' as bucket, count(*) filter (length(text) >= {low} {'' if high is None else f'and length(text) <= {high}'}) as count from conversations"
        for i, (name, low, high) in enumerate(MESSAGE_BUCKETS)
    ),
)
def msg_len_hist(t: Tables) -> DataFrame:
    return ts.message_length_histogram(t.table("conversations"))


_QLIST = "[0.25::double, 0.5::double, 0.75::double, 0.9::double, 0.95::double, 0.99::double]"


@query(
    "quantiles",
    f"""with recursive {V2T}, d as (select length(text) as n, {_WORDS} as w from documents),
 q as (select 'thread_length' as measure, unnest({_QLIST}) as q, unnest(quantile_cont(tweets::double, {_QLIST})) as value from c2
 union all select 'chars', unnest({_QLIST}), unnest(quantile_cont(n::double, {_QLIST})) from d
 union all select 'words', unnest({_QLIST}), unnest(quantile_cont(w::double, {_QLIST})) from d)
 select measure, q, round(value, 6) as value from q""",
)
def quantiles(t: Tables) -> DataFrame:
    return ts.length_quantiles(t.documents, t.c2).select("measure", "q", _r("value"))


@query("time_quantiles", "select unnest([0.1::double, 0.9::double]) as q, unnest(list_transform(quantile_cont(epoch_us(ts)::double, [0.1::double, 0.9::double]), lambda x: round(x / 1000))) as value from events")
def time_quantiles(t: Tables) -> DataFrame:
    moments = t.table("events").select(F.col("ts").cast("timestamp").alias("ts"))
    return ts.time_quantiles(moments).select("q", F.round(F.col("value") / 1000).alias("value"))


@query(
    "threshold_shares",
    f"""with recursive {V2T}, x as (
 select 'turns = 1' as name, count(*) filter (tweets = 1) as n, count(*) as t from c2 union all select 'turns = 2', count(*) filter (tweets = 2), count(*) from c2
 union all select 'turns <= 4', count(*) filter (tweets <= 4), count(*) from c2 union all select 'turns >= 5', count(*) filter (tweets >= 5), count(*) from c2
 union all select 'turns >= 20', count(*) filter (tweets >= 20), count(*) from c2
 union all select 'chars <= 200', count(*) filter (length(text) <= 200), count(*) from documents
 union all select 'chars > 200', count(*) filter (length(text) > 200), count(*) from documents)
 select name, n as count, round(n / t, 6) as share from x""",
)
def threshold_shares(t: Tables) -> DataFrame:
    return ts.threshold_shares(t.c2, t.documents).select("name", "count", _r("share"))


@query(
    "author_mix",
    f"""with {V1}, m as (select count(*) n, count(*) filter (inbound) i, count(*) filter (author_id = 'agent') a,
   count(*) filter (not inbound and author_id <> 'agent') b, count(distinct author_id) filter (inbound) c from t1)
 select 'messages' as name, n::double as value from m union all select 'inbound', i from m union all select 'outbound', n - i from m
 union all select 'by_support_author', a from m union all select 'by_other_outbound', b from m union all select 'customers', c from m
 union all select 'inbound_per_customer', round(i / c, 6) from m""",
)
def author_mix(t: Tables) -> DataFrame:
    return profile.author_mix(t.t1, "agent").select("name", _r("value"))


@query(
    "funnel",
    f"""with recursive {V2T}, kept as (select * from t2 where conversation_id in (select conversation_id from t2 where author_id = 'signup')),
 s as (select count(*) m, count(*) filter (in_response_to_tweet_id = '') st from v2),
 x as (select 1 as step, 'messages scanned' as name, m as n from s union all select 2, 'conversation starters', st from s
 union all select 3, 'corpus messages', count(*) from kept union all select 4, 'corpus conversations', count(distinct conversation_id) from kept
 union all select 5, 'support pairs', count(*) from p2)
 select step, name, n as count, round(n / m, 6) as share_of_messages, round(n / st, 6) as share_of_starters from x, s""",
)
def funnel(t: Tables) -> DataFrame:
    kept = convs_with_author(t.t2, "signup")
    out = profile.funnel(t.v2, kept, conversation_totals(kept), t.p2)
    return out.select("step", "name", "count", _r("share_of_messages"), _r("share_of_starters"))


@query(
    "pair_lengths",
    f"""with {V1}, s as (select 'customer message' as side, customer_message as text from p1 union all select 'support response', support_response from p1)
 select side, round(avg(length(text)), 6) as mean_chars, median(length(text))::double as median_chars, round(avg({_WORDS}), 6) as mean_words,
 median({_WORDS})::double as median_words from s group by 1""",
)
def pair_lengths(t: Tables) -> DataFrame:
    out = ts.pair_lengths(t.p1)
    return out.select("side", _r("mean_chars"), "median_chars", _r("mean_words"), "median_words")


@query("top_terms", f"select term, count(*) as count from (select unnest({_content_sql('text')}) as term from documents) group by 1 order by 2 desc, 1 limit 15")
def top_terms(t: Tables) -> DataFrame:
    return ts.top_terms(t.documents)


_BIGRAMS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"


@query("top_bigrams", f"with d as (select {_content_sql('text')} as w from documents) select term, count(*) as count from (select unnest({_BIGRAMS}) as term from d) group by 1 order by 2 desc, 1 limit 10")
def top_bigrams(t: Tables) -> DataFrame:
    return ts.top_bigrams(t.documents)


def _sketches(t: Tables) -> sketches.SketchStore:
    """Sketches of the documents, a part for each language."""
    if "sketches" not in t.memo:
        t.memo["sketches"] = sketches.SketchStore(t.spark, t.scratch("sketches"))
        for lang in ("de", "en", "es", "fr"):
            t.memo["sketches"].add(lang, t.documents.filter(F.col("lang") == lang), "doc_id")
    return t.memo["sketches"]


_SKETCHED = [0.25, 0.5, 0.75, 0.9, 0.99]


@query(
    "sketch_profile",
    f"""select 'rows' as name, count(*) as exact, true as within from documents where lang in ('de', 'en', 'es', 'fr')
 union all select 'distinct_ids', count(distinct doc_id), true from documents where lang in ('de', 'en', 'es', 'fr')
 union all select unnest({[f'length_{q}' for q in _SKETCHED]!r}), count(text), true from documents where lang in ('de', 'en', 'es', 'fr')""",
)
def sketch_profile(t: Tables) -> DataFrame:
    """Sketched sizes and quantiles against exact ones: whether each lies in its bound."""
    store, docs = _sketches(t), t.documents.filter(F.col("lang").isin("de", "en", "es", "fr"))
    exact = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids"), F.count("text").alias("texts")).first()
    guess = store.totals().first()
    near = abs(guess["distinct_ids"] - exact["ids"]) <= sketches.IDS_ERROR * exact["ids"]
    found = store.quantiles(_SKETCHED).collect()
    size = F.length("text")
    ranks = docs.agg(*[F.struct((F.count_if(size < r["value"]) / exact["texts"]).alias("low"), (F.count_if(size <= r["value"]) / exact["texts"]).alias("high")).alias(f"q{i}") for i, r in enumerate(found)]).first()
    rows = [("rows", exact["rows"], guess["rows"] == exact["rows"]), ("distinct_ids", exact["ids"], near)]
    for i, r in enumerate(found):
        inside = ranks[f"q{i}"]["low"] - sketches.RANK_ERROR <= r["q"] <= ranks[f"q{i}"]["high"] + sketches.RANK_ERROR
        rows.append((f"length_{r['q']}", exact["texts"], inside))
    return t.spark.createDataFrame(rows, "name string, exact long, within boolean")


@query("sketch_terms", f"select term, count(*) as count, true as within from (select unnest({_content_sql('text')}) as term from documents where lang in ('de', 'en', 'es', 'fr')) group by 1 order by 2 desc, 1 limit 10")
def sketch_terms(t: Tables) -> DataFrame:
    """The ten most frequent terms with their exact count, and whether the sketch has them with a range that holds it."""
    exact = ts.top_terms(t.documents.filter(F.col("lang").isin("de", "en", "es", "fr")), n=10)
    known = _sketches(t).top_terms(50).join(exact, "term", "right")
    return known.select("term", "count", F.coalesce(F.col("count").between(F.col("low"), F.col("high")), F.lit(False)).alias("within"))


@query("topk_ties", f"with {V1} select term, count(*) as count from (select unnest({_content_sql('customer_message')}) as term from p1) group by 1 order by 2 desc, 1 limit 40")
def topk_ties(t: Tables) -> DataFrame:
    return ts.top_terms(t.p1, "customer_message", n=40)


def _topic_rows(total: str) -> str:
    return " union all ".join(
        f"select {i} as priority, '{name}' as topic, count(*) filter (list_contains(h, '{name}')) as matched, "
        f"round(count(*) filter (list_contains(h, '{name}')) / {total}, 6) as share from hits"
        for i, (name, _, _) in enumerate(WORD_TOPICS)
    )


@query(
    "topic_shares",
    f"with {HITS}, x as ({_topic_rows('count(*)')}) select x.*, (select round(count(*) filter (len(h) >= 2) / count(*), 6) from hits) as multi_topic_share from x",
)
def topic_shares(t: Tables) -> DataFrame:
    out = ts.topic_shares(t.documents, topics=WORD_TOPICS)
    return out.select("priority", "topic", "matched", _r("share"), _r("multi_topic_share"))


@query("topic_order", f"with {HITS}, x as ({_topic_rows('count(*)')}) select row_number() over (order by matched desc, priority) as position, topic from x")
def topic_order(t: Tables) -> DataFrame:
    ordered = ts.topic_shares(t.documents, topics=WORD_TOPICS)
    listed = ordered.agg(F.array_sort(F.collect_list(F.struct((-F.col("matched")).alias("m"), "priority", "topic"))).alias("l"))
    return listed.select(F.posexplode("l").alias("p", "x")).select((F.col("p") + 1).alias("position"), F.col("x.topic").alias("topic"))


@query("topic_count_hist", f"with {HITS} select least(len(h), 4)::int as topics, count(*) as count from hits group by 1")
def topic_count_hist(t: Tables) -> DataFrame:
    return ts.topic_count_histogram(t.documents, topics=WORD_TOPICS)


@query(
    "topic_cooccurrence",
    f"""with {HITS}, e as (select doc_id, unnest(h) as x from hits)
 select a.x as topic_a, b.x as topic_b, count(*) as count, round(count(*) / (select count(*) from hits where len(h) >= 2), 6) as share_of_multi
 from e a join e b on a.doc_id = b.doc_id and a.x < b.x group by 1, 2 order by 3 desc, 1, 2 limit 8""",
)
def topic_cooccurrence(t: Tables) -> DataFrame:
    out = ts.topic_pairs(t.documents, topics=WORD_TOPICS)
    return out.select("topic_a", "topic_b", "count", _r("share_of_multi"))


@query("date_range", f"with {V2} select strftime(min(ts), '%Y-%m-%d') as start, strftime(max(ts), '%Y-%m-%d') as end from v2")
def date_range(t: Tables) -> DataFrame:
    return ts.date_range(t.v2)


# --- Samples, splits, folds --------------------------------------------------------------------------------
@query("sample_openers", f"with {V1}, o as (select * from t1 where turn = 1 and inbound) select conversation_id, tweet_id from o order by md5('42:' || conversation_id), conversation_id limit 5")
def sample_openers(t: Tables) -> DataFrame:
    return sampling.sample_openers(t.t1, 5).select("conversation_id", "tweet_id")


@query("sampling_frame", f"with {V1} select '{sampling.FRAME}' as sampling_frame, count(*) as sampling_frame_size, 5 as sample_size, 42 as random_seed from t1 where turn = 1 and inbound")
def sampling_frame(t: Tables) -> DataFrame:
    path = t.scratch("frame")
    label_sources.write_frame_record(sampling.sampling_frame(t.t1, 5), path)
    return t.spark.read.schema("sampling_frame string, sampling_frame_size long, sample_size int, random_seed int").json(path)


@query(
    "sample_by_size",
    f"""with recursive {V2T}, s as (select p2.*, tweets as turns, md5('42:' || response_tweet_id) as h from p2 join c2 using (conversation_id)),
 o as (select * from (select *, row_number() over (partition by conversation_id order by h) as a from s) where a = 1),
 b as (select *, case when turns <= 3 then 'short' when turns <= 8 then 'medium' else 'long' end as bucket from o)
 select conversation_id, bucket, turns, created_at, customer_message, support_response, response_tweet_id from
 (select *, row_number() over (partition by bucket order by h) as k from b) where k <= 2""",
)
def sample_by_size(t: Tables) -> DataFrame:
    return sampling.sample_by_size(t.p2, t.c2)


def _split_sql(src: str) -> str:
    return f"""
rk as (select *, row_number() over (partition by label order by md5('42:' || conversation_id), conversation_id) as rn,
  count(*) over (partition by label) as n from {src}),
sz as (select *, round_even(n * 0.15::double, 0)::bigint as k from rk),
split as (select *, case when n - 2 * k <= 0 or rn <= n - 2 * k then 'train' when rn <= n - k then 'val' else 'test' end as split from sz)"""


@query("stratified_split", f"with {V4}, {_split_sql('v4')} select conversation_id, label, split from split")
def stratified_split(t: Tables) -> DataFrame:
    return sampling.stratified_split(t.v4).select("conversation_id", "label", "split")


@query("split_select", f"with {V3}, {_split_sql('v3')} select conversation_id, label from split where split = 'val'")
def split_select(t: Tables) -> DataFrame:
    return sampling.split_rows(sampling.stratified_split(t.v3), "val").select("conversation_id", "label")


@query("class_split_counts", f"with {V4}, {_split_sql('v4')}, {TAXONOMY_SQL} select tax.priority::int as priority, tax.label, count(split) as total, count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val, count(*) filter (split = 'test') as test from tax left join split using (label) group by 1, 2")
def class_split_counts(t: Tables) -> DataFrame:
    return metrics.class_split_counts(sampling.stratified_split(t.v4))


@query("kfold_assign", f"with {V3}, {_split_sql('v3')} select conversation_id, label, ((rn - 1) % 5)::int as fold from split")
def kfold_assign(t: Tables) -> DataFrame:
    return sampling.kfold_assign(t.v3).select("conversation_id", "label", "fold")


# --- Vectors and the centroid classifier -------------------------------------------------------------------
_CENTROIDS = f"""{V3}, {_split_sql('v3')}, train as (select * from split where split = 'train'),
means as (select label, list(m order by i) as m from (select label, i, avg(x) as m from
  (select label, unnest(range(1, 65)) as i, unnest(vector) as x from train) group by 1, 2) group by 1),
cen as (select label as class, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) as c from means),
sims as (select s.conversation_id, s.label, s.split, class, list_dot_product(vector, c) / sqrt(list_dot_product(vector, vector)) as score
  from split s cross join cen),
prob as (select *, exp(score) / sum(exp(score)) over (partition by conversation_id) as p,
  row_number() over (partition by conversation_id order by score desc, class) as rk from sims),
pred as (select a.conversation_id, a.label, a.split, a.class as predicted, a.p as confidence, b.class as runner_up,
  b.p as runner_up_confidence from prob a join prob b on a.conversation_id = b.conversation_id and a.rk = 1 and b.rk = 2)"""


def _split3(t: Tables) -> DataFrame:
    if "split3" not in t.memo:
        t.memo["split3"] = stash(sampling.stratified_split(t.v3), "golden-vectors")
    return t.memo["split3"]


def _prototype(t: Tables) -> heads.PrototypeModel:
    if "prototype" not in t.memo:
        t.memo["prototype"] = heads.PrototypeModel.fit(sampling.split_rows(_split3(t), "train"))
    return t.memo["prototype"]


def _predicted(t: Tables) -> DataFrame:
    return _prototype(t).predict(_split3(t))


@query("class_centroids", f"with {_CENTROIDS} select class as label, i - 1 as pos, round(c[i], 6) as value from cen, range(1, 65) r(i)")
def class_centroids(t: Tables) -> DataFrame:
    out = heads.class_centroids(sampling.split_rows(_split3(t), "train"))
    return out.select("label", F.posexplode("centroid").alias("pos", "value")).select("label", "pos", _r("value"))


@query("prototype_fit", f"with {_CENTROIDS} select class as label, len(c)::int as dim, round(list_sum(c), 6) as total from cen")
def prototype_fit(t: Tables) -> DataFrame:
    out = heads.PrototypeModel.fit(sampling.split_rows(_split3(t), "train")).centroids
    total = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x)
    return out.select("label", F.size("centroid").alias("dim"), F.round(total, 6).alias("total"))


@query("centroid_scores", f"with {_CENTROIDS} select conversation_id, class, round(score, 6) as score from sims")
def centroid_scores(t: Tables) -> DataFrame:
    out = heads.centroid_scores(_split3(t), _prototype(t).centroids)
    return out.select("conversation_id", "class", _r("score"))


@query("prototype_predict", f"with {_CENTROIDS} select conversation_id, label, predicted, round(confidence, 6) as confidence from pred")
def prototype_predict(t: Tables) -> DataFrame:
    return _predicted(t).select("conversation_id", "label", "predicted", _r("confidence"))


@query("top2_classes", f"with {_CENTROIDS} select conversation_id, predicted, runner_up, round(confidence, 6) as confidence, round(runner_up_confidence, 6) as runner_up_confidence from pred")
def top2_classes(t: Tables) -> DataFrame:
    return _predicted(t).select("conversation_id", "predicted", "runner_up", _r("confidence"), _r("runner_up_confidence"))


@query("argmax_class", f"with {_CENTROIDS} select conversation_id, arg_max(class, score) as predicted from sims group by 1")
def argmax_class(t: Tables) -> DataFrame:
    return _predicted(t).select("conversation_id", "predicted")


@query("cosine", f"with {V3} select a.conversation_id, round(list_cosine_similarity(a.vector, b.vector), 6) as cosine from v3 a join v3 b on b.conversation_id::bigint = a.conversation_id::bigint + 1")
def cosine_next(t: Tables) -> DataFrame:
    other = t.v3.select((F.col("conversation_id").cast("long") - 1).cast("string").alias("conversation_id"), F.col("vector").alias("next"))
    return t.v3.join(other, "conversation_id").select("conversation_id", F.round(cosine(F.col("vector"), F.col("next")), 6).alias("cosine"))


@query("softmax", f"with {V3}, e as (select conversation_id, list_transform(vector, lambda x: exp(x)) as e from v3) select conversation_id, round(list_max(e) / list_sum(e), 6) as top, round(list_min(e) / list_sum(e), 6) as low from e")
def softmax_of_vector(t: Tables) -> DataFrame:
    s = softmax(F.transform("vector", lambda x: x.cast("double")))
    return t.v3.select("conversation_id", F.round(F.array_max(s), 6).alias("top"), F.round(F.array_min(s), 6).alias("low"))


# --- Baselines and metrics ---------------------------------------------------------------------------------
_KW = f"{V4}, {_split_sql('v4')}, kw as (select conversation_id, split, label, {_KEYWORD_LABEL} as predicted from split)"
_MAJ = f"""{V4}, {_split_sql('v4')}, best as (select label, count(*) as count from split where split = 'train' group by 1 order by 2 desc, 1 limit 1),
maj as (select conversation_id, split.label, split, best.label as predicted from split, best)"""


def _headline_sql(src: str, by: str = "", labels: str = "tax") -> str:
    """Accuracy and F1 averages over the taxonomy (or the labels seen) for rows (label, predicted)."""
    g = f"{by}, " if by else ""
    on = f"using ({by})" if by else "on true"
    grp = f"group by {by}" if by else ""
    return f"""
hl_e as (select {g} unnest([label, predicted]) as class, label = predicted as hit, unnest([1, 0]) as tru, unnest([0, 1]) as gue from {src}),
hl_c as (select {g} class, sum(case when hit then tru else 0 end) as tp, sum(tru) as support, sum(gue) as guessed from hl_e group by {g} class),
hl_f as (select *, 2.0::double * tp / (support + guessed) as f1 from hl_c {'where class in (select label from tax)' if labels == 'tax' else ''}),
hl_m as (select {g} sum(f1) / {'10' if labels == 'tax' else 'count(*)'} as macro_f1, sum(f1 * support) / sum(support) as weighted_f1 from hl_f {grp}),
hl_a as (select {g} count(*) as rows, avg(case when label = predicted then 1.0::double else 0.0::double end) as accuracy from {src} {grp}),
hl as (select * from hl_a join hl_m {on})"""


@query("keyword_baseline", f"with {_KW}, {TAXONOMY_SQL}, {_headline_sql('kw', 'split')} select split, rows, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1, round(weighted_f1, 6) as weighted_f1 from hl")
def keyword_baseline(t: Tables) -> DataFrame:
    done = evaluate.keyword_baseline(sampling.stratified_split(t.v4), WORD_TOPICS)
    return metrics.headline(done, by=("split",)).select("split", "rows", _r("accuracy"), _r("macro_f1"), _r("weighted_f1"))


@query("majority_class", f"with {_MAJ} select label, count from best")
def majority_class(t: Tables) -> DataFrame:
    return metrics.majority_class(sampling.split_rows(sampling.stratified_split(t.v4), "train"))


@query("majority_baseline", f"with {_MAJ}, {TAXONOMY_SQL}, {_headline_sql('maj', 'split')} select split, rows, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1, round(weighted_f1, 6) as weighted_f1 from hl")
def majority_baseline(t: Tables) -> DataFrame:
    done = evaluate.majority_baseline(sampling.stratified_split(t.v4))
    return metrics.headline(done, by=("split",)).select("split", "rows", _r("accuracy"), _r("macro_f1"), _r("weighted_f1"))


@query(
    "classification_report",
    f"""with {_CENTROIDS}, {TAXONOMY_SQL}, tst as (select * from pred where split = 'test'), {_headline_sql('tst')},
 k as (select tax.label, coalesce(tp / nullif(guessed, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, coalesce(f1, 0) as f1,
   coalesce(support, 0) as support from tax left join hl_f on class = tax.label)
 select '' as label, 'accuracy' as metric, round(accuracy, 6) as value from hl union all select '', 'macro_f1', round(macro_f1, 6) from hl
 union all select '', 'weighted_f1', round(weighted_f1, 6) from hl
 union all select label, 'precision', round(precision, 6) from k union all select label, 'recall', round(recall, 6) from k
 union all select label, 'f1', round(f1, 6) from k union all select label, 'support', support::double from k""",
)
def classification_report(t: Tables) -> DataFrame:
    done = sampling.split_rows(_predicted(t), "test")
    return metrics.classification_report(done).select("label", "metric", _r("value"))


@query("confusion_matrix", f"with {_KW}, {TAXONOMY_SQL} select a.priority::int as priority, b.priority::int as predicted_priority, a.label, b.label as predicted, count(kw.label) as count from tax a cross join tax b left join kw on kw.label = a.label and kw.predicted = b.label group by all")
def confusion_matrix(t: Tables) -> DataFrame:
    return metrics.confusion_matrix(evaluate.keyword_baseline(sampling.stratified_split(t.v4), WORD_TOPICS))


@query("labels_present", f"with {_KW}, {TAXONOMY_SQL} select priority::int as priority, label from tax where label in (select label from kw union select predicted from kw)")
def present(t: Tables) -> DataFrame:
    return labels_present(evaluate.keyword_baseline(sampling.stratified_split(t.v4), WORD_TOPICS))


@query(
    "cv_fold_scores",
    f"""with {_KW}, {TAXONOMY_SQL}, f as (select kw.*, (rn - 1) % 5 as fold from kw join split using (conversation_id)), {_headline_sql('f', 'fold', labels='seen')}
 select count(*) as folds, round(avg(macro_f1), 6) as macro_f1_mean, round(stddev_pop(macro_f1), 6) as macro_f1_std from hl""",
)
def cv_fold_scores(t: Tables) -> DataFrame:
    done = evaluate.keyword_baseline(sampling.kfold_assign(t.v4), WORD_TOPICS)
    return metrics.cv_fold_scores(done).select("folds", _r("macro_f1_mean"), _r("macro_f1_std"))


@query(
    "model_deltas",
    f"""with {_MAJ}, {TAXONOMY_SQL}, both_ as (select 'majority' as model, label, predicted from maj
   union all select 'keyword_rules', label, {_KEYWORD_LABEL} from split), {_headline_sql('both_', 'model')},
 m as (select model, 'accuracy' as metric, accuracy as v from hl union all select model, 'macro_f1', macro_f1 from hl union all select model, 'weighted_f1', weighted_f1 from hl)
 select a.model, b.model as baseline, metric, round(a.v - b.v, 6) as delta from m a join m b using (metric) where a.model = 'keyword_rules' and b.model = 'majority'""",
)
def model_deltas(t: Tables) -> DataFrame:
    golden = sampling.stratified_split(t.v4)
    done = evaluate.compare(
        {"majority": evaluate.majority_baseline(golden), "keyword_rules": evaluate.keyword_baseline(golden, WORD_TOPICS)}
    )
    deltas = metrics.model_deltas(metrics.model_scores(done), [("keyword_rules", "majority")])
    return deltas.select("model", "baseline", "metric", _r("delta"))


@query(
    "confidence_preview",
    f"""with {_CENTROIDS}, s as (select *, round_even(confidence, 4) as c, label = predicted as ok from pred)
 select round(avg(c) filter (ok), 5) as mean_confidence_correct, round(avg(c) filter (not ok), 5) as mean_confidence_wrong,
 round(avg((c >= 0.125)::int), 6) as share_above_threshold, round(avg(ok::int) filter (c >= 0.125), 6) as accuracy_above_threshold from s""",
)
def confidence_preview(t: Tables) -> DataFrame:
    out = metrics.confidence_preview(_predicted(t), 0.125)
    return out.select(_r("mean_confidence_correct", 5), _r("mean_confidence_wrong", 5), _r("share_above_threshold"), _r("accuracy_above_threshold"))


@query(
    "error_analysis",
    f"with {_CENTROIDS} select conversation_id, label as true_label, predicted as predicted_label, runner_up, round_even(confidence, 4) as confidence, round_even(runner_up_confidence, 4) as runner_up_confidence, case when length(text) > 160 then substring(text, 1, 160) || '…' else text end as text from pred join documents on conversation_id = doc_id::varchar where label <> predicted",
)
def error_analysis(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").cast("string").alias("conversation_id"), "text")
    return metrics.error_analysis(_predicted(t).join(docs, "conversation_id"))


# --- Retrieval and routing -----------------------------------------------------------------------------------
_NEAR = f"""{V3}, {_split_sql('v3')}, near as (select q.conversation_id as query_id, q.label as asked, c.conversation_id as id, c.label,
  round(list_dot_product(q.vector, c.vector) / sqrt(list_dot_product(q.vector, q.vector)) / sqrt(list_dot_product(c.vector, c.vector)), 9) as score
  from split q join split c on q.split = 'test' and c.split = 'train'),
found as (select *, row_number() over (partition by query_id order by score desc, id) as rank from near),
firsts as (select s.conversation_id, min(rank) as rank from split s left join found on query_id = s.conversation_id and asked = found.label where s.split = 'test'
  and s.label in (select x.label from split x where x.split = 'train') group by 1)"""


def _retrieved(t: Tables) -> DataFrame:
    """The five nearest training rows of each test row: evidence is isolated from what is asked."""
    if "retrieved" not in t.memo:
        rows = _split3(t)
        asked = sampling.split_rows(rows, "test").select(F.col("conversation_id").alias("query_id"), "vector")
        evidence = without(rows.select(F.col("conversation_id").alias("id"), "vector"), sampling.split_rows(rows, "test").unionByName(sampling.split_rows(rows, "val")).select(F.col("conversation_id").alias("id")), "id")
        t.memo["retrieved"] = stash(retrieval.topk_retrieval(asked, evidence, 5), "retrieved")
    return t.memo["retrieved"]


@query("topk_retrieval", f"with {_NEAR} select query_id, rank::int as rank, id, round(score, 6) as score from found where rank <= 5")
def topk_retrieval(t: Tables) -> DataFrame:
    return _retrieved(t).select("query_id", "rank", "id", _r("score"))


@query(
    "recall_at_k",
    f"""with {_NEAR} select k, count(*) as queries, count(*) filter (rank <= k) as hits, round(count(*) filter (rank <= k) / count(*), 6) as recall,
 round(coalesce(sum(1 / rank) filter (rank <= k), 0) / count(*), 6) as mean_reciprocal_rank from firsts, (select unnest([1, 3, 5])::int as k) group by k""",
)
def recall_at_k(t: Tables) -> DataFrame:
    """A test row's relevant evidence is what shares its label."""
    rows = _split3(t)
    asked = sampling.split_rows(rows, "test").select(F.col("conversation_id").alias("query_id"), "label")
    evidence = sampling.split_rows(rows, "train").select(F.col("conversation_id").alias("id"), "label")
    hits, answerable = retrieval.same_label(_retrieved(t), asked, evidence)
    return retrieval.recall_at_k(hits, answerable).select("k", "queries", "hits", _r("recall"), _r("mean_reciprocal_rank"))


_CURVE = f"""{_CENTROIDS}, sure as (select *, round_even(confidence, 4) as threshold, (label <> predicted)::int as bad from pred),
curve as (select t.threshold, count(*) as auto, sum(bad)::bigint as wrong from (select distinct threshold from sure) t join sure on sure.threshold >= t.threshold group by 1)"""


@query("false_auto_curve", f"with {_CURVE} select threshold, auto, wrong, round(auto / (select count(*) from sure), 6) as auto_share, round(wrong / auto, 6) as false_auto_rate from curve")
def false_auto_curve(t: Tables) -> DataFrame:
    return retrieval.false_auto_curve(_predicted(t)).select("threshold", "auto", "wrong", _r("auto_share"), _r("false_auto_rate"))


@query(
    "route_decision",
    f"""with {_CURVE} select conversation_id, predicted, case when threshold > coalesce((select max(threshold) from curve where wrong / auto > 0.05), -1)
  and predicted <> 'security_privacy' then 'auto' else 'human' end as route from sure""",
)
def route_decision(t: Tables) -> DataFrame:
    done = _predicted(t)
    routed = retrieval.route_decision(done, retrieval.false_auto_curve(done), 0.05, ("security_privacy",))
    return routed.select("conversation_id", "predicted", "route")


# --- Text features and fitted heads ------------------------------------------------------------------------
def tfidf_sql() -> str:
    words = rf"list_filter(regexp_extract_all(lower(text), '{WORD}{{2,}}'), lambda w: w not in ({_quoted(DISPLAY_STOPWORDS)}))"
    return f"""with {V4}, w as (select doc_id, {words} as w from v4),
 e as (select doc_id, unnest(list_concat(w, {_BIGRAMS})) as term from w),
 tf as (select doc_id, term, count(*) as tf from e group by 1, 2),
 df as (select term, count(*) as df from tf group by 1 having count(*) >= 1),
 x as (select doc_id, term, (1 + ln(tf)) * (ln((1.0::double + (select count(*) from v4)) / (1.0::double + df)) + 1) as raw from tf join df using (term))
 select doc_id, term, round(raw / sqrt(sum(raw * raw) over (partition by doc_id)), 6) as weight from x"""


@query("tfidf_weights", tfidf_sql())
def tfidf(t: Tables) -> DataFrame:
    counts = term_counts(t.v4, DISPLAY_STOPWORDS)
    return tfidf_weights(counts, vocabulary(t.v4, counts, min_df=1)).select("doc_id", "term", _r("weight"))


@query("tfidf_logreg")
def tfidf_logreg(t: Tables) -> DataFrame:
    done = evaluate.tfidf_head(sampling.stratified_split(t.v4), {"C": 10.0, "class_weight": "balanced", "min_df": 1})
    return metrics.headline(done, by=("split",))


# --- The text grid: folds, designs, pooling and ties ---------------------------------------------------------
_FOLDED = rf"""{V4}, {_split_sql('v4')},
fd as (select *, ((row_number() over (partition by label order by md5('42:' || conversation_id), conversation_id) - 1) % 5)::int as fold
  from split where split = 'train'),
fw as (select conversation_id, fold, label, list_filter(regexp_extract_all(lower(text), '{WORD}{{2,}}'), lambda w: w not in ({_quoted(DISPLAY_STOPWORDS)})) as w from fd),
fe as (select conversation_id, fold, unnest(list_concat(w, {_BIGRAMS})) as term from fw),
ftf as (select conversation_id, fold, term, count(*) as tf from fe group by all),
held as (select distinct fold as held_out from fd),
fdf as (select held_out, term, count(*) as df, ln((1.0::double + (select count(*) from fd where fold <> held_out)) / (1.0::double + count(*))) + 1 as idf
  from ftf join held on fold <> held_out group by held_out, term)"""

_POOLED = f"""{_FOLDED}, {TAXONOMY_SQL},
cuts as (select unnest([1, 2]) as min_df),
raw as (select held_out, min_df, conversation_id, term, (1 + ln(tf)) * idf as x from ftf join fdf using (term) join cuts on df >= min_df),
wt as (select *, x / sqrt(sum(x * x) over (partition by held_out, min_df, conversation_id)) as weight from raw),
members as (select held_out, label, count(*) as n from fd join held on fold <> held_out group by all),
mean as (select held_out, min_df, label, term, sum(weight) / any_value(members.n) as m from wt join fd using (conversation_id) join members using (held_out, label)
  where fold <> held_out group by all),
size as (select held_out, min_df, label, sqrt(sum(m * m)) as len from mean group by all),
near as (select w.held_out, w.min_df, w.conversation_id, m.label, sum(w.weight * m.m) as s from wt w join fd on fd.conversation_id = w.conversation_id and fd.fold = w.held_out
  join mean m on m.held_out = w.held_out and m.min_df = w.min_df and m.term = w.term group by all),
cand as (select fd.fold as held_out, min_df, fd.conversation_id, fd.label as truth, members.label from fd join members on members.held_out = fd.fold cross join cuts),
whole as (select cand.*, round(coalesce(near.s / size.len, 0), 9) as score from cand left join near using (held_out, min_df, conversation_id, label) left join size using (held_out, min_df, label)),
guess as (select min_df, truth as label, label as predicted from
  (select *, row_number() over (partition by held_out, min_df, conversation_id order by score desc, label) as k from whole) where k = 1),
cfg as (select i::int as position, [0.01, 0.1, 1.0, 10.0][i // 4 + 1]::double as c, case when i // 2 % 2 = 1 then 'balanced' end as class_weight, (i % 2 + 1)::int as min_df from range(16) t(i)),
pool as (select position, label, predicted from guess join cfg using (min_df)),
{_headline_sql('pool', 'position')},
grid as (select position, c, class_weight, min_df, round_even(accuracy, 4) as accuracy, round_even(macro_f1, 4) as macro_f1,
  round_even((round_even(accuracy, 4) + round_even(macro_f1, 4)) / 2, 4) as mean_score from cfg join hl using (position))"""


def _folded(t: Tables) -> DataFrame:
    return sampling.kfold_assign(sampling.split_rows(sampling.stratified_split(t.v4), "train"))


def _grid_fits(t: Tables, head: str) -> DataFrame:
    if f"grid-{head}" not in t.memo:
        t.memo[f"grid-{head}"] = stash(text_grid.fit_grid(_folded(t), TEXT_GRID, DISPLAY_STOPWORDS, head=head), "grid-fits")
    return t.memo[f"grid-{head}"]


@query("fold_frequencies", f"with {_FOLDED} select held_out, term, df, round(idf, 6) as idf from fdf where df >= 2")
def fold_frequencies(t: Tables) -> DataFrame:
    rows = stash(_folded(t), "folded")
    counts = term_counts(rows, DISPLAY_STOPWORDS, "conversation_id").join(rows.select("conversation_id", "fold"), "conversation_id")
    return text_grid.fold_frequencies(counts, rows).filter("df >= 2").select("held_out", "term", "df", _r("idf"))


@query("text_grid_search")
def text_grid_search(t: Tables) -> DataFrame:
    """All 16 configurations, logistic regression, pooled out of fold."""
    return text_grid.pooled_scores(_grid_fits(t, "logreg"), TEXT_GRID)


@query(
    "text_grid_certificate",
    f"""with {_FOLDED} select position::int as position, held_out as fold, count(*) as rows, count(distinct label) as classes, true as at_minimum
 from range(16) p(position), held join fd on fold <> held_out group by position, held_out""",
)
def text_grid_certificate(t: Tables) -> DataFrame:
    return text_grid.fit_certificate(_grid_fits(t, "logreg"))


@query("text_grid_pooled", f"with {_POOLED} select *, position = (select position from grid order by mean_score desc, macro_f1 desc, position desc limit 1) as best from grid")
def text_grid_pooled(t: Tables) -> DataFrame:
    """The grid with a head that SQL can fit: configurations that differ in C and weighting alone tie."""
    scores = stash(text_grid.pooled_scores(_grid_fits(t, "centroid"), TEXT_GRID), "pooled")
    best = metrics.best_config(scores).select(F.col("position").alias("_best"))
    return scores.join(F.broadcast(best), F.col("position") == F.col("_best"), "left").withColumn("best", F.col("_best").isNotNull()).drop("_best")


@query(
    "weighting_ties",
    f"""with {_POOLED} select * exclude (k) from (select *, coalesce(class_weight, 'none') as weighting,
  row_number() over (partition by coalesce(class_weight, 'none') order by mean_score desc, position) as k from grid) where k = 1""",
)
def weighting_ties(t: Tables) -> DataFrame:
    return metrics.weighting_comparison(text_grid.pooled_scores(_grid_fits(t, "centroid"), TEXT_GRID))


@query(
    "logreg_certificate",
    f"""with {V3}, {_split_sql('v3')}, train as (select * from split where split = 'train')
 select label, count(*) as rows, round((select count(*) from train) / (select count(distinct label) from train)::double, 6) as weighted_size, true as at_minimum from train group by label""",
)
def logreg_certificate(t: Tables) -> DataFrame:
    """The head of ``embed_logreg``: per class its weighted size, and whether both conditions of the minimum hold."""
    train = sampling.split_rows(_split3(t), "train").withColumn("features", array_to_vector("vector"))
    rows = stash(train.select("label", "vector"), "certified").withColumn("features", array_to_vector("vector"))
    head = heads.LogRegHead(100.0, "balanced", tol=1e-9).fit(rows)
    held = (F.col("gap") <= 1e-3 * F.col("rows")) & (F.col("slope") <= 1e-3)
    return head.certificate(rows).select("label", "rows", _r("weighted_size"), held.alias("at_minimum"))


@query("embed_logreg")
def embed_logreg(t: Tables) -> DataFrame:
    done = evaluate.vector_head(_split3(t), {"C": 100.0, "class_weight": "balanced"})
    return done.select("conversation_id", "split", "label", "predicted", "confidence", "runner_up", "runner_up_confidence")


def _grid(t: Tables) -> DataFrame:
    if "grid" not in t.memo:
        train = sampling.split_rows(_split3(t), "train").withColumn("features", array_to_vector("vector"))
        folded = sampling.kfold_assign(train).withColumn("features", array_to_vector("vector"))
        rows = stash(folded.select("conversation_id", "label", "fold", "features"), "folds")
        t.memo["grid"] = stash(selection.grid_search(rows, VECTOR_GRID, selection.vector_fit_predict), "grid")
    return t.memo["grid"]


@query("oof_grid_search")
def oof_grid_search(t: Tables) -> DataFrame:
    return _grid(t)


@query("weighting_comparison")
def weighting_comparison(t: Tables) -> DataFrame:
    return metrics.weighting_comparison(_grid(t))


@query("model_store", f"with {_CENTROIDS} select conversation_id, predicted, round(confidence, 6) as confidence from pred")
def model_store(t: Tables) -> DataFrame:
    path = t.scratch("model")
    _prototype(t).save(path)
    done = heads.PrototypeModel.load(t.spark, path).predict(_split3(t))
    return done.select("conversation_id", "predicted", _r("confidence"))


@query("model_store_logreg", f"with {V3}, {_split_sql('v3')} select conversation_id, true as same from split where split <> 'train'")
def model_store_logreg(t: Tables) -> DataFrame:
    """A fitted head, saved and loaded, predicts what it predicted before, to the last digit."""
    rows = _split3(t).withColumn("features", array_to_vector("vector"))
    path, asked = t.scratch("logreg"), rows.filter("split <> 'train'").select("conversation_id", "features")
    head = heads.LogRegHead(1.0, "balanced").fit(sampling.split_rows(rows, "train"))
    head.save(path)
    told = ["predicted", "confidence", "runner_up", "runner_up_confidence"]
    before = head.predict(asked).select("conversation_id", F.struct(*told).alias("before"))
    after = heads.LogRegHead.load(t.spark, path).predict(asked).select("conversation_id", F.struct(*told).alias("after"))
    return before.join(after, "conversation_id").select("conversation_id", (F.col("before") == F.col("after")).alias("same"))


def letter_encoder(texts) -> list[list[float]]:
    """A stand-in encoder that SQL can repeat: a text's length and its first seven characters as numbers."""
    return [[float(len(x)), *[float(ord(c)) for c in x[:7].ljust(7, "\0")]] for x in texts]


@query(
    "embedding_refresh",
    """with k as (select distinct text from documents), s as (select distinct text from documents join labels using (doc_id) where toxic = 0)
 select case when s.text is null then 'miss' else 'hit' end as name, count(*) as value from k left join s using (text) group by 1""",
)
def embedding_refresh(t: Tables) -> DataFrame:
    """The store holds the labelled documents; vectors of toxic ones have a wrong length and do not count."""
    docs = t.documents
    wanted = embeddings.keyed(docs, "m1")
    known = docs.join(t.table("labels"), "doc_id")
    stored = embeddings.encode(embeddings.keyed(known, "m1").dropDuplicates(["key", "toxic"]), letter_encoder)
    flags = embeddings.keyed(known, "m1").groupBy("key").agg(F.min("toxic").alias("toxic"))
    cut = stored.join(flags, "key").select("key", F.when(F.col("toxic") == 1, F.slice("vector", 1, 3)).otherwise(F.col("vector")).alias("vector"))
    path = t.scratch("vectors")
    cut.write.parquet(path)
    before = stash(embeddings.refresh_counts(wanted, t.spark.read.parquet(path), 8), "refresh-counts")
    full = embeddings.embedding_refresh(docs, path, letter_encoder, "m1", 8)
    assert full.filter("vector IS NULL").isEmpty()
    return before


@query("vector_store", "select text, length(text) as chars, 1 as rows from documents group by text")
def vector_store(t: Tables) -> DataFrame:
    """Two refreshes at once of a store, and one that is never committed: each text has one vector."""
    store, docs = embeddings.VectorStore(t.spark, t.scratch("versions")), t.documents
    keyed_docs = embeddings.keyed(docs, "m1")
    todo = stash(embeddings.missing(keyed_docs, store.read(8), 8), "todo")  # read three times
    first, second, lost = (store.write(embeddings.encode(rows, letter_encoder)) for rows in (todo, todo, todo.withColumn("text", F.lit("wrong"))))
    store.commit(second)
    store.commit(first)
    assert lost not in store.versions()
    full = store.refresh(docs.select("text").distinct(), letter_encoder, "m1", 8)
    return full.groupBy("text").agg(F.max(F.get("vector", F.lit(0))).cast("long").alias("chars"), F.count(F.lit(1)).cast("int").alias("rows"))


@query(
    "embedded_texts",
    "select doc_id, length(text) || ',' || array_to_string([case when length(text) >= i then unicode(substr(text, i, 1)) else 0 end for i in [1, 2, 3, 4, 5, 6, 7]], ',') as vector from documents",
)
def embedded_texts(t: Tables) -> DataFrame:
    path = t.scratch("vectors")
    t.spark.createDataFrame([], "key string, vector array<float>").write.parquet(path)
    full = embeddings.embedding_refresh(t.documents, path, letter_encoder, "m1", 8)
    return full.select("doc_id", F.concat_ws(",", F.transform("vector", lambda v: v.cast("int").cast("string"))).alias("vector"))
