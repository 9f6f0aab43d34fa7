import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from replyloom.session import local_session  # noqa: E402
from replyloom.sources.messages import normalise, with_types  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8)


RAW = (
    "tweet_id string, author_id string, inbound string, created_at string, text string, "
    "response_tweet_id string, in_response_to_tweet_id string, file_pos long"
)


@pytest.fixture(scope="session")
def messages(spark):
    """Messages from rows ``(id, author, parent, children, text, minute)``; numeric authors are customers."""

    def build(rows):
        full = []
        for pos, row in enumerate(rows):
            tid, author, parent, children, text, minute = (*row, *("", "", "hello", None)[len(row) - 2 :])
            created = "n/a" if minute is None else f"Tue Oct 31 21:{minute:02d}:00 +0000 2017"
            inbound = "True" if author.isdigit() else "False"
            full.append((tid, author, inbound, created, text, children, parent, pos))
        raw = spark.createDataFrame(full, RAW)
        return with_types(normalise(raw.withColumn("inbound_raw", raw["inbound"])))

    return build


def as_dict(metrics):
    return {r["name"]: r["value"] for r in metrics.collect()}
