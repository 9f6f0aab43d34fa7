"""What a refresh moves and what its encoder is handed."""

import pyarrow as pa

from replyloom.operators import embeddings
from workloads import queries_analyse


def test_missing_texts_are_looked_up_once(spark, tmp_path, monkeypatch):
    plans, real = [], embeddings.encode

    def seen(rows, encoder, batch=256):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return real(rows, encoder, batch)

    class View:
        documents = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one")], "doc_id long, text string")

        def scratch(self, name):
            return f"{tmp_path}/{name}"

    View.spark = spark
    monkeypatch.setattr(embeddings, "encode", seen)
    got = queries_analyse.Q["vector_store"][0](View()).collect()
    assert sorted(tuple(r) for r in got) == [("one", 3, 1), ("two", 3, 1)]
    assert not any("Aggregate" in p for p in plans[:3])


def test_texts_become_python_objects_a_batch_at_a_time(spark, monkeypatch):
    held = []

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            def parts():
                yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(1000)]), pa.array(["t"] * 1000)], names=["key", "text"])

            return [b.num_rows for b in run(parts())]

    sizes = embeddings.encode(Frame(), lambda texts: held.append(len(texts)) or [[1.0]] * len(texts))
    assert sizes == held == [256, 256, 256, 232]
