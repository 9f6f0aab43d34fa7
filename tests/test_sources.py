import pytest
from pyspark.sql import functions as F

from replyloom.functions.text import parse_created_at
from replyloom.operators.profile import UnknownAuthorError, dataset_profile, empty_by_column, require_author
from replyloom.sources import labels, messages as ms
from tests.conftest import as_dict

HEADER = "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"


def test_csv(spark, tmp_path):
    d = tmp_path / "dump"
    d.mkdir()
    (d / "b.csv").write_text(HEADER + '3,Brand,yes,x,"NA",,\n')
    (d / "a.csv").write_text(
        HEADER
        + '902000000000000001,7, TRUE ,Tue Oct 31 21:00:00 +0000 2017,"say ""hi"", then\nbye","2, 3",\n'
        + " 2 ,Brand,False,bad,plain,,902000000000000001\n"
    )
    table = ms.with_types(ms.ingest_messages(spark, str(d), str(tmp_path / "bronze")))
    rows = table.orderBy("file_pos").collect()
    assert [r["tweet_id"] for r in rows] == ["902000000000000001", "2", "3"]
    assert rows[0]["text"] == 'say "hi", then\nbye'
    assert rows[0]["response_ids"] == ["2", "3"] and rows[1]["response_ids"] == []
    assert [r["inbound"] for r in rows] == [True, False, False]
    assert rows[2]["text"] == "NA" and rows[2]["in_response_to_tweet_id"] == ""
    assert [r["ts"] is None for r in rows] == [False, True, True]
    assert as_dict(dataset_profile(table)) == {
        "total_rows": 3, "unique_tweet_ids": 3, "empty_tweet_ids": 0, "inbound_rows": 1, "outbound_rows": 2,
        "malformed_inbound": 1, "conversation_starters": 2, "duplicate_tweet_ids": 0,
    }
    empties = {r[0]: r[1] for r in empty_by_column(table).collect()}
    assert empties["response_tweet_id"] == 2 and empties["text"] == 0
    assert [r["tweet_id"] for r in ms.first_rows(table, 2).collect()] == ["902000000000000001", "2"]


def test_first_rows_beyond_one_task(spark):
    table = spark.range(0, 400_000, 7).withColumnRenamed("id", "file_pos").repartition(5)
    out = ms.first_rows(table, 20_000)
    assert (out.count(), out.agg(F.max("file_pos")).first()[0]) == (20_000, 19_999 * 7)


def test_missing_column(spark, tmp_path):
    (tmp_path / "x.csv").write_text("tweet_id,text\n1,a\n")
    with pytest.raises(ms.SchemaError, match="author_id"):
        ms.read_raw_csv(spark, str(tmp_path / "x.csv"))


def test_unknown_author(messages):
    table = messages([("1", "Brand"), ("2", "Brand"), ("3", "Other")])
    require_author(table, "Brand")
    with pytest.raises(UnknownAuthorError, match=r"Brand \(2\), Other \(1\)"):
        require_author(table, "Nobody")


def test_timestamps(spark):
    cases = {
        "Tue Oct 31 21:00:00 +0000 2017": 1509483600,
        "Tue Oct 31 21:00:00 +0200 2017": 1509476400,
        "Tue Oct 3 01:02:03 +0000 2017": 1506992523,
        "Xyz Oct 31 21:00:00 +0000 2017": None,
        "2017-10-31": None,
        "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "c string")
    out = {r[0]: r[1] for r in rows.select("c", F.unix_timestamp(parse_created_at(F.col("c")))).collect()}
    assert out == cases


def test_label_files(spark, tmp_path):
    (tmp_path / "l.json").write_text('{\n "10": "other",\n "11": "software_bug"\n}')
    expected = {("10", "other"), ("11", "software_bug")}
    assert {tuple(r) for r in labels.read_label_map(spark, str(tmp_path / "l.json"), "object").collect()} == expected
    labels.write_label_map(spark.createDataFrame(sorted(expected), "conversation_id string, label string"), str(tmp_path / "lines"))
    assert {tuple(r) for r in labels.read_label_map(spark, str(tmp_path / "lines")).collect()} == expected
    (tmp_path / "m.json").write_text('{"purpose": "p",\n "conversation_ids": ["3", "1"], "count": 2}')
    assert {r[0] for r in labels.read_manifest(spark, str(tmp_path / "m.json"), "object").collect()} == {"1", "3"}
    ids = spark.range(25_000).selectExpr("cast(id as string) conversation_id")
    labels.write_manifest(ids, str(tmp_path / "out"))
    assert labels.read_manifest(spark, str(tmp_path / "out")).count() == 25_000


@pytest.mark.parametrize("read", [labels.read_label_map, labels.read_manifest])
def test_second_object_of_a_file_is_an_error(spark, tmp_path, read):
    (tmp_path / "two.json").write_text('{"a": "x"}\n{"b": "y"}')
    with pytest.raises(Exception, match="MALFORMED|one JSON object"):
        read(spark, str(tmp_path / "two.json"), "object").collect()
