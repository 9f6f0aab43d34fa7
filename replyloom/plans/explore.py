"""The statistics of a prepared corpus, each as its own table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from replyloom.operators import text_stats as ts
from replyloom.operators.profile import author_mix, funnel, inbound_distribution
from replyloom.operators.sampling import sample_by_size
from replyloom.plans.prepare import Prepared


def explore(run: Prepared) -> dict[str, DataFrame]:
    """Word and topic tables look at the customer side of pairs, so a message answered twice counts twice."""
    asked = run.pairs.select("customer_message")
    return {
        "summary": ts.corpus_summary(run.threads, run.conversations, run.pairs),
        "inbound_distribution": inbound_distribution(run.threads),
        "author_mix": author_mix(run.threads, run.author),
        "funnel": funnel(run.source, run.threads, run.conversations, run.pairs),
        "thread_length_histogram": ts.thread_length_histogram(run.conversations),
        "message_length_histogram": ts.message_length_histogram(run.threads),
        "length_quantiles": ts.length_quantiles(run.threads, run.conversations),
        "time_quantiles": ts.time_quantiles(run.threads),
        "threshold_shares": ts.threshold_shares(run.conversations, run.threads),
        "pair_lengths": ts.pair_lengths(run.pairs),
        "top_terms": ts.top_terms(asked, "customer_message"),
        "top_bigrams": ts.top_bigrams(asked, "customer_message"),
        "topic_shares": ts.topic_shares(asked, "customer_message"),
        "topic_counts": ts.topic_count_histogram(asked, "customer_message"),
        "topic_pairs": ts.topic_pairs(asked, "customer_message"),
        "samples": sample_by_size(run.pairs, run.conversations),
    }
