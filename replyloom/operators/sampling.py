"""Repeatable samples, splits and folds. Random order is the md5 of the seed and a unique id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from replyloom.constants import FOLDS, SEED, TEST_RATIO, VAL_RATIO
from replyloom.functions.ranking import hash_order, hash_rank, hash_sample
from replyloom.operators.pairs import pair_sizes


#: What :func:`openers` are, as the record of a sample names them.
FRAME = "first messages of conversations started by a customer"


class SampleTooSmallError(ValueError):
    """The sampling frame has fewer rows than asked for."""


def openers(threads: DataFrame) -> DataFrame:
    """First messages of conversations started by a customer."""
    return threads.filter((F.col("turn") == 1) & F.col("inbound"))


def sample_openers(threads: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` openers by conversation id; refuses if there are fewer."""
    frame = openers(threads)
    found = frame.count()
    if found < n:
        raise SampleTooSmallError(f"only {found} openers; cannot sample {n}")
    return hash_sample(frame, n, "conversation_id", seed).orderBy("conversation_id")


def sampling_frame(threads: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """The record beside a worksheet of ``n`` openers: what was sampled from, how many there were, and how."""
    size = openers(threads).agg(F.count(F.lit(1)).alias("sampling_frame_size"))
    return size.select(
        F.lit(FRAME).alias("sampling_frame"), "sampling_frame_size", F.lit(n).alias("sample_size"), F.lit(seed).alias("random_seed")
    )


def sample_by_size(pairs: DataFrame, sizes: DataFrame, seed: int = SEED, per_bucket: int = 2) -> DataFrame:
    """One pair each of two short (<= 3), medium (4-8) and long (> 8) conversations."""
    sized = pair_sizes(pairs, sizes).withColumn("_hash", hash_order(F.col("response_tweet_id"), seed))
    one_each = sized.groupBy("conversation_id").agg(
        F.min_by(
            F.struct("turns", "created_at", "customer_message", "support_response", "response_tweet_id", "_hash"),
            F.struct("_hash", "response_tweet_id"),
        ).alias("p")
    ).select("conversation_id", "p.*")
    bucket = F.when(F.col("turns") <= 3, "short").when(F.col("turns") <= 8, "medium").otherwise("long")
    # Spark limits each task to the first rows per bucket before the shuffle.
    window = Window.partitionBy("bucket").orderBy("_hash", "response_tweet_id")
    return (
        one_each.withColumn("bucket", bucket)
        .withColumn("_n", F.row_number().over(window))
        .filter(F.col("_n") <= per_bucket)
        .drop("_n", "_hash")
    )


def stratified_split(
    rows: DataFrame,
    unique: str = "conversation_id",
    label: str = "label",
    seed: int = SEED,
    val: float = VAL_RATIO,
    test: float = TEST_RATIO,
) -> DataFrame:
    """Add ``split``: per label, half-even rounded shares for val and test, the rest for train."""
    ranked = hash_rank(rows, [label], unique, "_rank", seed, total="_n")
    n_val = F.bround(F.col("_n") * F.lit(float(val))).cast("long")
    n_test = F.bround(F.col("_n") * F.lit(float(test))).cast("long")
    n_train = F.col("_n") - n_val - n_test
    split = (
        F.when((n_train <= 0) | (F.col("_rank") <= n_train), "train")
        .when(F.col("_rank") <= n_train + n_val, "val")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).drop("_rank", "_n")


def kfold_assign(
    rows: DataFrame, unique: str = "conversation_id", label: str = "label", folds: int = FOLDS, seed: int = SEED
) -> DataFrame:
    """Add ``fold`` (0-based): the members of every class are dealt out in turn."""
    ranked = hash_rank(rows, [label], unique, "_rank", seed)
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")).drop("_rank")


def split_rows(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(F.col("split") == name)
