"""Text expressions. Character classes are spelled out so that they mean the same on every Java version."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyloom.constants import DISPLAY_STOPWORDS, OTHER, TOKEN_EDGE_CHARS, TOPICS

SPACE = r"[\t-\r\x1C-\x1F\x85\p{Z}]"
NONSPACE = r"[^\t-\r\x1C-\x1F\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NONWORD = r"[^\p{L}\p{N}_]"

#: The members of SPACE: controls, separators of lines and paragraphs, and all Unicode spaces.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                           0x202F, 0x205F, 0x3000)))

URL = rf"https?://{NONSPACE}+|www\.{NONSPACE}+"
REPEAT_PREFIX = rf"(?i)^RT{SPACE}+@{WORD}+{SPACE}*:?{SPACE}*"
LEADING_MENTION = rf"^@{WORD}+{SPACE}*"

#: ``Tue Oct 31 21:00:00 +0000 2017``; the weekday is checked by name only and then left out.
WEEKDAY = r"(?i)^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) "
TIMESTAMP_FORMAT = "MMM d HH:mm:ss Z yyyy"


def strip(col: Column) -> Column:
    """Remove every kind of blank at both ends (SQL ``trim`` removes spaces only)."""
    return F.btrim(col, F.lit(BLANKS))


def collapse(col: Column) -> Column:
    """Each run of blanks becomes one space; none are left at the ends."""
    return F.trim(F.regexp_replace(col, rf"{SPACE}+", " "))


def split_ids(col: Column) -> Column:
    """Comma-separated id list to an array, blanks dropped."""
    return F.filter(F.transform(F.split(col, ","), strip), lambda x: x != "")


def parse_created_at(col: Column) -> Column:
    """Message timestamp, or NULL when it does not parse."""
    parsed = F.try_to_timestamp(F.substring(col, 5, 100), F.lit(TIMESTAMP_FORMAT))
    return F.when(col.rlike(WEEKDAY), parsed)


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def decode_entities(col: Column) -> Column:
    """HTML entities to characters. Only texts holding ``&`` are sent to Python; all others travel as NULL."""
    return F.coalesce(_unescape(F.when(F.contains(col, F.lit("&")), col)), col)


def clean_text(col: Column, strip_leading_mention: bool = True, decode: bool = True) -> Column:
    """Decode, drop a repeat prefix, blank out URLs, drop one leading mention, collapse blanks."""
    out = decode_entities(col) if decode else col
    out = F.regexp_replace(out, REPEAT_PREFIX, "")
    out = F.regexp_replace(out, URL, " ")
    if strip_leading_mention:
        out = F.regexp_replace(out, LEADING_MENTION, "")
    return collapse(out)


def word_count(col: Column) -> Column:
    """Number of blank-separated words."""
    return F.regexp_count(col, F.lit(rf"{NONSPACE}+"))


def tokens(col: Column, min_chars: int = 3) -> Column:
    """Lower-cased words that are purely alphabetic once punctuation at their edges is off.

    One pattern finds them in a single pass; the blank behind a word is left for the next match.
    """
    edge = "[" + re.escape(TOKEN_EDGE_CHARS) + "]"
    word = rf"(?:^|{SPACE}){edge}*+(\p{{L}}{{{min_chars},}}+){edge}*+(?={SPACE}|\z)"
    return F.regexp_extract_all(F.lower(col), F.lit(word), F.lit(1))


def content_tokens(col: Column, stopwords: Sequence[str] = DISPLAY_STOPWORDS) -> Column:
    """Tokens that are not stop words; order and repeats are kept."""
    return F.filter(tokens(col), lambda x: ~x.isin(*stopwords))


def bigrams(words: Column) -> Column:
    """Adjacent pairs of an array of words, joined by a space."""
    following = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    return F.array_compact(F.zip_with(words, following, lambda a, b: F.concat(a, F.lit(" "), b)))


def keyword_pattern(keywords: Sequence[str], case_sensitive: bool = True) -> str:
    """One search pattern for whole-word hits on any of the keywords."""
    flags = "" if case_sensitive else "(?iu)"
    return rf"{flags}(^|{NONWORD})({'|'.join(re.escape(k) for k in keywords)})($|{NONWORD})"


def topic_hits(col: Column, topics=TOPICS, case_sensitive: bool = True) -> Column:
    """Array of the topics whose keywords occur in the text, in topic order."""
    return F.array_compact(
        F.array(
            *[
                F.when(col.rlike(keyword_pattern(keywords, case_sensitive)), F.lit(topic))
                for topic, _, keywords in topics
            ]
        )
    )


def keyword_label(col: Column, topics=TOPICS, case_sensitive: bool = False, default: str = OTHER) -> Column:
    """Label of the first topic with a keyword in the text."""
    return F.coalesce(
        *[
            F.when(col.rlike(keyword_pattern(keywords, case_sensitive)), F.lit(label))
            for _, label, keywords in topics
        ],
        F.lit(default),
    )


def clip(col: Column, limit: int, keep: int | None = None) -> Column:
    """Cut long texts and mark the cut. ``keep`` is the number of characters kept (default: the limit)."""
    kept = limit if keep is None else keep
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, kept), F.lit("…"))).otherwise(col)


def content_key(text: Column, model: str, chars: int = 16) -> Column:
    """Stable key of one text under one encoder: the first characters of a SHA-256."""
    return F.substring(F.sha2(F.concat(text, F.lit("\0" + model)), 256), 1, chars)
