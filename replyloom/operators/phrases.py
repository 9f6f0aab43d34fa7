"""Topics by a table of phrases: an equi-join, whose cost does not grow with the number of topics or phrases.

A phrase of k words occurs in a text as a whole if k neighbouring words of the text, with what stands between them, equal it. So
each text's different stretches of k words, for the lengths that the table has, are joined with the phrases by equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.constants import TOPICS
from replyloom.functions.text import NONWORD, WORD

#: Words of the longest phrase that a table may hold.
LONGEST = 12


def phrase_table(spark: SparkSession, topics=TOPICS) -> DataFrame:
    """``(priority, topic, phrase)`` of topics ``(topic, label, keywords)``."""
    rows = [(i, topic, phrase) for i, (topic, _, keywords) in enumerate(topics) for phrase in keywords]
    return spark.createDataFrame(rows, "priority int, topic string, phrase string")


def stretches(text: Column, lengths: Sequence[int]) -> Column:
    """The different stretches of neighbouring words of the given lengths, with all that stands between the words."""
    words = F.regexp_extract_all(text, F.lit(rf"{WORD}+"), F.lit(0))
    # what stands between the words; before the first and behind the last there may be more
    between = F.regexp_extract_all(F.regexp_replace(text, rf"^{NONWORD}+", ""), F.lit(rf"{NONWORD}+"), F.lit(0))
    parts = F.array(F.struct(words.alias("w"), between.alias("b")))

    def of_length(x: Column, k: int) -> Column:
        places = F.sequence(F.lit(0), F.size(x["w"]) - k)
        piece = lambda i: F.concat(*[y for j in range(k) for y in ((F.get(x["b"], i + j - 1), F.get(x["w"], i + j)) if j else (F.get(x["w"], i),))])
        return F.when(F.size(x["w"]) >= k, F.transform(places, piece)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(parts, lambda x: F.concat(*[of_length(x, k) for k in lengths]))))


def phrase_matches(texts: DataFrame, phrases: DataFrame, unique: str, text: str = "text", case_sensitive: bool = True) -> DataFrame:
    """``(unique, topic)`` for each topic of ``phrases (topic, phrase)`` with a phrase in the text; phrases begin and end with a word."""
    fold = (lambda c: c) if case_sensitive else F.lower
    whole = rf"^{WORD}(.*{WORD})?$"
    known = phrases.select("topic", fold(F.col("phrase")).alias("phrase")).distinct()
    odd = known.filter(~F.col("phrase").rlike(whole)).take(1)
    if odd:
        raise ValueError(f"a phrase must begin and end with a word character: {odd[0]['phrase']!r}")
    n_words = F.size(F.regexp_extract_all("phrase", F.lit(rf"{WORD}+"), F.lit(0)))
    lengths = sorted(r["n"] for r in known.select(n_words.alias("n")).distinct().collect())
    if lengths and lengths[-1] > LONGEST:
        raise ValueError(f"a phrase has {lengths[-1]} words, more than {LONGEST}")
    said = texts.select(unique, F.explode(stretches(fold(F.col(text)), lengths or [1])).alias("phrase"))
    return said.join(known, "phrase").select(unique, "topic").distinct()
