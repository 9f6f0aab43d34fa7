"""The ledger of a run and the record beside a worksheet."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from replyloom.operators import sampling
from replyloom.plans import ledger
from replyloom.plans.prepare import prepare
from replyloom.sources.labels import write_frame_record

ROWS = [
    ("1", "7", "", "2", "@Brand my phone", 0), ("2", "agent", "1", "3", "@7 hello", 1), ("3", "7", "2", "4", "@agent ", 2),
    ("4", "agent", "3", "99", "@7 still there?", 3), ("5", "8", "", "", "@Other lonely", 4),
]


@pytest.fixture
def run(messages):
    return prepare(messages(ROWS), "agent")


def told(entries):
    return {(r["section"], r["name"]): r["value"] for r in entries.collect()}


def test_seven_stages_of_a_sound_run(run, tmp_path):
    written = ledger.write_outputs(run, f"{tmp_path}/out")
    entries = ledger.ledger(written)
    values = told(entries)
    assert values["closure", "collected_rows"] == 4 and values["closure", "author_rows"] == 2
    assert values["closure", "dangling_references"] == 1  # 99
    assert values["input", "rows"] == 5 and values["settings", "random_seed"] == 42
    assert values["outputs", "messages"] == values["stages", "filter_author"] == 3
    got = [(r["stage_no"], r["stage"], r["status"], r["rows"]) for r in ledger.stages(entries).orderBy("stage_no").collect()]
    assert [g[:2] for g in got] == list(enumerate([s for s, _ in ledger.STAGES], 1))
    assert {g[2] for g in got} == {"OK"} and [g[3] for g in got] == [4, 5, 3, 3, 3, 1, 7]
    ledger.write_ledger(entries, f"{tmp_path}/ledger")
    assert run.source.sparkSession.read.json(f"{tmp_path}/ledger").count() == len(values)


def test_a_planted_fault_warns(run, tmp_path):
    broken = dataclasses.replace(run, pairs=run.pairs.unionByName(run.pairs))
    entries = ledger.ledger(ledger.write_outputs(broken, f"{tmp_path}/out"), mode="component")
    assert told(entries)["violations", "pair_response_ids_unique"] == 1 and told(entries)["settings", "closure_both_ways"] == 1
    assert {r["stage"]: r["status"] for r in ledger.stages(entries).collect() if r["status"] == "WARN"} == {"validate_outputs": "WARN"}


def test_outputs_are_counted_from_written_files(run, tmp_path):
    written = ledger.write_outputs(run, f"{tmp_path}/out")
    plan = written.threads.agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan


def test_frame_record(run, tmp_path):
    write_frame_record(sampling.sampling_frame(run.threads, 1, 7), f"{tmp_path}/frame")
    lines = [x for p in tmp_path.glob("frame/part-*") for x in p.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"sampling_frame": sampling.FRAME, "sampling_frame_size": 1, "sample_size": 1, "random_seed": 7}]
