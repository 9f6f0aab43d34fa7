"""Length, word and topic statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replyloom.constants import (
    DISPLAY_STOPWORDS,
    MESSAGE_BUCKETS,
    THREAD_HISTOGRAM_MAX,
    TOP_BIGRAMS,
    TOP_TERMS,
    TOP_TOPIC_PAIRS,
    TOPICS,
)
from replyloom.functions.ranking import exact_quantiles
from replyloom.functions.tables import union_all, unpivot
from replyloom.functions.text import bigrams, content_tokens, tokens, topic_hits, word_count

LENGTH_QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def top_values(rows: DataFrame, column: str, n: int, name: str = "term") -> DataFrame:
    """Most frequent values; equal counts in value order, since a distributed table has no first-seen row."""
    return (
        rows.groupBy(F.col(column).alias(name))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), name)
        .limit(n)
    )


def top_terms(texts: DataFrame, column: str = "text", n: int = TOP_TERMS, stopwords: Sequence[str] = DISPLAY_STOPWORDS):
    words = texts.select(F.explode(tokens(F.col(column))).alias("term")).filter(~F.col("term").isin(*stopwords))
    return top_values(words, "term", n)


def top_bigrams(
    texts: DataFrame, column: str = "text", n: int = TOP_BIGRAMS, stopwords: Sequence[str] = DISPLAY_STOPWORDS
):
    """Most frequent adjacent words after stop words are out; pairs never span two messages."""
    words = texts.select(content_tokens(F.col(column), stopwords).alias("w"))
    return top_values(words.select(F.explode(bigrams(F.col("w"))).alias("term")), "term", n)


def corpus_summary(threads: DataFrame, conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Headline counts and means of the prepared corpus as ``(name, value)`` text rows."""
    chars = F.length("text")
    when = F.struct("ts", "file_pos", "created_at")
    messages = threads.agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if("inbound").alias("inbound"),
        F.count_if(~F.col("inbound")).alias("outbound"),
        F.round(F.avg(chars), 1).alias("avg_message_chars"),
        F.round(F.avg(word_count(F.col("text"))), 1).alias("avg_message_words"),
        F.coalesce(F.min(F.when(F.col("ts").isNotNull(), when))["created_at"], F.lit("")).alias("date_start"),
        F.coalesce(
            F.max_by("created_at", F.when(F.col("ts").isNotNull(), F.struct("ts", -F.col("file_pos")))), F.lit("")
        ).alias("date_end"),
    )
    sizes = conversations.agg(
        F.count(F.lit(1)).alias("conversations"),
        F.round(F.coalesce(F.avg("tweets"), F.lit(0.0)), 2).alias("avg_conversation_turns"),
        F.coalesce(F.max("tweets"), F.lit(0)).alias("max_conversation_turns"),
    )
    median = exact_quantiles(conversations, "tweets", [0.5]).agg(
        F.coalesce(F.max("value"), F.lit(0.0)).alias("median_conversation_turns")
    )
    counted = pairs.agg(F.count(F.lit(1)).alias("support_pairs"))
    return union_all(*[unpivot(t, "string") for t in (messages, sizes, median, counted)])


def thread_length_histogram(conversations: DataFrame, top: int = THREAD_HISTOGRAM_MAX) -> DataFrame:
    """Conversations by size; the last bin takes all larger ones. Empty bins are hidden, except the first two."""
    spark = conversations.sparkSession
    counts = conversations.groupBy(F.least("tweets", F.lit(top)).cast("int").alias("turns")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    bins = spark.range(1, top + 1).select(F.col("id").cast("int").alias("turns"))
    return (
        bins.join(counts, "turns", "left")
        .select("turns", F.coalesce("_n", F.lit(0)).alias("count"))
        .filter((F.col("count") > 0) | (F.col("turns") < 3))
    )


def message_length_histogram(texts: DataFrame, column: str = "text", buckets=MESSAGE_BUCKETS) -> DataFrame:
    """Messages by number of characters, every bucket shown; empty texts fall in none."""
    n = F.length(column)
    row = texts.agg(
        *[F.count_if((n >= low) & (n <= high) if high is not None else n >= low).alias(name) for name, low, high in buckets]
    )
    pairs = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("bucket"), F.col(f"`{name}`").alias("count"))
        for i, (name, _, _) in enumerate(buckets)
    ]
    return row.select(F.inline(F.array(*pairs)))


def length_quantiles(texts: DataFrame, conversations: DataFrame, points: Sequence[float] = LENGTH_QUANTILES) -> DataFrame:
    """Exact quantiles of thread length, characters and words as ``(measure, q, value)``.

    Each table is read once; quantiles come from the counts of distinct lengths, which stay few.
    """
    measure = lambda name, v: F.struct(F.lit(name).alias("measure"), v.cast("long").alias("v"))
    of_texts = F.array(measure("chars", F.length("text")), measure("words", word_count(F.col("text"))))
    lengths = conversations.select(F.lit("thread_length").alias("measure"), F.col("tweets").cast("long").alias("v"))
    counted = texts.select(F.inline(of_texts)).unionByName(lengths).groupBy("measure", "v").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.array(*[F.lit(float(q)) for q in points])
    values = counted.filter("v is not null").groupBy("measure").agg(F.percentile("v", wanted, F.col("n")).alias("_values"))
    return values.select("measure", F.inline(F.arrays_zip(wanted.alias("q"), F.col("_values").alias("value"))).alias("q", "value"))


def time_quantiles(messages: DataFrame, points: Sequence[float] = (0.1, 0.9)) -> DataFrame:
    """Exact quantiles of the message time in epoch microseconds; ranked within hours."""
    micros = messages.select(F.unix_micros("ts").alias("v"))
    return exact_quantiles(micros, "v", points, width=3_600_000_000)


def threshold_shares(conversations: DataFrame, texts: DataFrame) -> DataFrame:
    """Number and share of conversations and messages at the reported cut points."""
    n, c = F.col("tweets"), F.length("text")

    def measured(df, cuts):
        total = F.count(F.lit(1))
        cells = [F.struct(F.lit(k).alias("name"), F.count_if(v).alias("count"), F.try_divide(F.count_if(v), total).alias("share")) for k, v in cuts]
        return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))

    return union_all(
        measured(
            conversations,
            [("turns = 1", n == 1), ("turns = 2", n == 2), ("turns <= 4", n <= 4), ("turns >= 5", n >= 5), ("turns >= 20", n >= 20)],
        ),
        measured(texts, [("chars <= 200", c <= 200), ("chars > 200", c > 200)]),
    )


def pair_lengths(pairs: DataFrame) -> DataFrame:
    """Mean and median characters and words on both sides of the pairs."""
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.lit("customer message").alias("side"), F.col("customer_message").alias("text")),
                F.struct(F.lit("support response").alias("side"), F.col("support_response").alias("text")),
            )
        )
    ).select("side", F.length("text").alias("chars"), word_count(F.col("text")).alias("words"))
    # Medians come from the counts of distinct lengths, which stay few however many pairs there are.
    counted = sides.groupBy("side", "chars", "words").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("side").agg(
        (F.sum(F.col("chars") * F.col("n")) / F.sum("n")).alias("mean_chars"),
        F.percentile("chars", F.lit(0.5), F.col("n")).alias("median_chars"),
        (F.sum(F.col("words") * F.col("n")) / F.sum("n")).alias("mean_words"),
        F.percentile("words", F.lit(0.5), F.col("n")).alias("median_words"),
    )


def topic_shares(texts: DataFrame, column: str = "text", topics=TOPICS) -> DataFrame:
    """Matched texts and share per topic, most frequent first, with the share of multi-topic texts.

    Texts are first counted by their set of topics, so every text is matched once.
    """
    hits = (
        texts.select(topic_hits(F.col(column), topics).alias("h"))
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    total = F.sum("c")

    def matching(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("c"))), F.lit(0))

    cells = [
        F.struct(
            F.lit(i).alias("priority"),
            F.lit(name).alias("topic"),
            matching(F.array_contains("h", name)).alias("matched"),
            F.coalesce(F.try_divide(matching(F.array_contains("h", name)), total), F.lit(0.0)).alias("share"),
        )
        for i, (name, _, _) in enumerate(topics)
    ]
    multi = F.coalesce(F.try_divide(matching(F.size("h") >= 2), total), F.lit(0.0))
    return (
        hits.agg(F.array(*cells).alias("cells"), multi.alias("multi_topic_share"))
        .select(F.inline("cells"), "multi_topic_share")
        .orderBy(F.desc("matched"), "priority")
    )


def topic_count_histogram(texts: DataFrame, column: str = "text", topics=TOPICS, top: int = 4) -> DataFrame:
    """Texts by number of matched topics; the last bin takes all larger numbers."""
    n = F.least(F.size(topic_hits(F.col(column), topics)), F.lit(top))
    return texts.groupBy(n.alias("topics")).agg(F.count(F.lit(1)).alias("count"))


def topic_pairs(texts: DataFrame, column: str = "text", topics=TOPICS, n: int = TOP_TOPIC_PAIRS) -> DataFrame:
    """Most frequent topic pairs of one text, with their share of the multi-topic texts.

    Texts are first counted by their set of topics, so pairs are formed once per distinct set.
    """
    sets = (
        texts.select(F.array_sort(topic_hits(F.col(column), topics)).alias("h"))
        .groupBy("h")
        .agg(F.count(F.lit(1)).alias("c"), F.max(F.size("h")).alias("_k"))
        .filter("_k >= 2")  # on an aggregate, so that the matching is not repeated below it
        .withColumn("_multi", F.sum("c").over(Window.partitionBy()))  # at most one row per set of topics
    )
    first = sets.select("h", "c", "_multi", F.posexplode("h").alias("i", "topic_a"))
    pairs = first.select("topic_a", "c", "_multi", F.explode(F.expr("slice(h, i + 2, size(h))")).alias("topic_b"))
    return (
        pairs.groupBy("topic_a", "topic_b")
        .agg(F.sum("c").alias("count"), (F.sum("c") / F.max("_multi")).alias("share_of_multi"))
        .orderBy(F.desc("count"), "topic_a", "topic_b")
        .limit(n)
    )


def date_range(rows: DataFrame) -> DataFrame:
    """First and last day of the parsed times."""
    return rows.agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("start"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("end")
    )

