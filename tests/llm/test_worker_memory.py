"""What Python workers hold, and how often signatures move."""

import tracemalloc

import numpy as np
import pyarrow as pa

from replyloom.llm import op3_toxicity as op3
from replyloom.llm import op4_chosen_path as op4
from replyloom.llm import op6_hmm as op6


def test_counting_expressions_holds_little_beside_its_batch():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{x:x}" for x in rng.integers(0, 2**28, 12_000)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0, 1] * 10, pa.int32())], names=["text", "toxic"])
    tracemalloc.start()
    seen = 0
    for part in op3._count_expressions(iter([batch])):
        seen += part.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen and peak < 120e6


def test_a_counting_task_sends_one_sum():
    texts = ["a bb ccc dddd " * 30, "bb a eeeee", "ccc a a", None]
    rows = {"doc_id": [1, 2, 3, 4], "text": texts, "held_out": [False, True, False, False]}
    chunks = [next(op6._chunks(iter([pa.RecordBatch.from_pydict({k: v[a:b] for k, v in rows.items()})]))) for a, b in ((0, 2), (2, 4))]
    start = np.full(2, 0.5)

    class Params:
        value = (start, np.full((2, 2), 0.5), np.random.default_rng(1).dirichlet(np.ones(op6.CLASSES), 2))

    run = lambda some: [np.frombuffer(b.column(0)[0].as_py()) for b in op6._counting_pass(Params)(iter(some))]
    alone, both = [run([c])[0] for c in chunks], run(chunks)
    assert len(both) == 1 and np.array_equal(both[0], alone[0] + alone[1])


def test_no_task_of_a_fit_keeps_two_python_workers(spark, monkeypatch):
    """Two steps of a tree of sums have a shuffle between them."""
    seen, real = [], type(spark.range(1)).first

    def first(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(type(spark.range(1)), "first", first)
    parts = spark.range(4).selectExpr("cast(repeat('a', 8) as binary) AS c")
    assert len(op6._tree_sum(parts, ["c"], np.int64)[0]) == 1
    nodes = [line.split("- ")[-1].split()[0] for line in seen[0].splitlines() if "InArrow" in line or "Exchange" in line]
    assert nodes and all(not ("InArrow" in a and "InArrow" in b) for a, b in zip(nodes[:-1], nodes[1:], strict=True))


def test_open_documents_take_their_signatures_along(spark):
    """Only a round's open documents are joined with signatures, once."""
    rows = [(1, c, 5, 1, [c] * op4.POSITIONS) for c in range(3)]
    named = spark.createDataFrame(rows, "node long, code long, n long, leader long, sig array<int>")
    join = op4._Join.__new__(op4._Join)
    for df in (join.children(named), join.centres(named)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "code" in plan and not any("Join" in line and "code" in line for line in plan.splitlines())
    assert join.children(named).count() == 3 * op4.BRANCHES and join.centres(named).first()["n_centre"] == 5
