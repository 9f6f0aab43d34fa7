"""Approximate statistics from sketches that are stored per part of a table and merged on demand.

A part (a day, a file) is read once, when it is added; later questions read the sketches alone. Distinct ids come from
HyperLogLog, quantiles of lengths from KLL, frequent terms from the most frequent ones of each part. Each answer has a bound:
a share for the first two (at 99 %), and for a term's count the range that the parts in which it was not kept leave open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replyloom.constants import DISPLAY_STOPWORDS
from replyloom.functions.text import tokens

#: Size of the HyperLogLog (2**14 registers) and its error bound, three standard errors of 0.83 / sqrt(2**14).
LG_IDS = 14
IDS_ERROR = 0.02
#: Size of the KLL sketch and its error in rank.
KLL_SIZE = 400
RANK_ERROR = 0.01
#: Terms kept of a part.
TERMS = 1000


class SketchStore:
    """Sketches below ``path``: a folder per part; adding a part again replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, part: str, rows: DataFrame, unique: str, text: str = "text", terms: int = TERMS, stopwords: Sequence[str] = DISPLAY_STOPWORDS) -> None:
        """Sketch the rows of one part, which are all that is read."""
        sizes = rows.agg(
            F.count(F.lit(1)).alias("rows"),
            F.hll_sketch_agg(F.col(unique).cast("string"), LG_IDS).alias("ids"),
            F.kll_sketch_agg_bigint(F.length(text).cast("long"), F.lit(KLL_SIZE)).alias("lengths"),
        )
        sizes.write.mode("overwrite").parquet(f"{self.path}/sizes/part={part}")
        words = rows.select(F.explode(tokens(F.col(text))).alias("term")).filter(~F.col("term").isin(*stopwords))
        counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("count"))
        # one more than is kept: its count bounds those that are not
        first = counts.orderBy(F.desc("count"), "term").limit(terms + 1)
        ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "term")))
        ranked.write.mode("overwrite").parquet(f"{self.path}/terms/part={part}")

    def _sizes(self) -> DataFrame:
        return self.spark.read.schema("rows long, ids binary, lengths binary, part string").parquet(f"{self.path}/sizes")

    def totals(self) -> DataFrame:
        """``(rows, distinct_ids)``: exact rows, estimated distinct ids."""
        return self._sizes().agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("distinct_ids"))

    def quantiles(self, points: Sequence[float]) -> DataFrame:
        """``(q, value)`` of text lengths: values whose rank is within ``RANK_ERROR`` of q."""
        merged = self._sizes().agg(F.kll_merge_agg_bigint("lengths").alias("k"))
        found = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_bigint("k", F.lit(float(q))).alias("value")) for q in points])
        return merged.select(F.inline(found))

    def top_terms(self, n: int, terms: int = TERMS) -> DataFrame:
        """``(term, low, high)`` of the ``n`` terms with the highest known count: the true count lies in this range.

        A part that did not keep a term holds it no more often than the first term it left out.
        """
        stored = self.spark.read.schema("term string, count long, rank int, part string").parquet(f"{self.path}/terms")
        cuts = stored.filter(F.col("rank") > terms).select("part", F.col("count").alias("cut"))
        whole = cuts.agg(F.coalesce(F.sum("cut"), F.lit(0)).alias("whole"))
        kept = stored.filter(F.col("rank") <= terms).join(cuts, "part", "left")
        known = kept.groupBy("term").agg(F.sum("count").alias("low"), F.sum(F.coalesce("cut", F.lit(0))).alias("_own"))
        ranges = known.select("term", "low", (F.col("low") + whole.scalar() - F.col("_own")).alias("high"))
        return ranges.orderBy(F.desc("low"), "term").limit(n)
