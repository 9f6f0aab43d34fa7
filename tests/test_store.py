"""The vector store: versions that appear whole or not at all."""

import threading

import pytest

from replyloom.operators import embeddings

TEXTS = [(k, f"text {k % 40}") for k in range(60)]


def encoder(texts):
    return [[float(len(x)), 1.0] for x in texts]


def failing(texts):
    if any(x.endswith("39") for x in texts):
        raise RuntimeError("killed")
    return encoder(texts)


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, text string")


def test_a_killed_refresh_leaves_nothing(spark, texts, tmp_path):
    store = embeddings.VectorStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    with pytest.raises(Exception, match="killed"):
        store.refresh(texts.repartition(8), failing, "m", 2)
    assert store.versions() == [] and store.read().count() == 0
    written = store.write(embeddings.encode(embeddings.missing(embeddings.keyed(texts, "m"), store.read(2), 2), encoder))
    assert store.read().count() == 0  # killed between data and marker
    assert store.refresh(texts, encoder, "m", 2).filter("vector is null").isEmpty()
    assert len(store.versions()) == 1 and written not in store.versions() and store.read().count() == 40


def test_two_refreshes_at_once(spark, texts, tmp_path):
    store, gate, errors = embeddings.VectorStore(spark, str(tmp_path / "store")), threading.Barrier(2), []

    def run():
        try:
            todo = embeddings.missing(embeddings.keyed(texts, "m"), store.read(2), 2)
            gate.wait()
            version = store.write(embeddings.encode(todo, encoder))
            gate.wait()
            store.commit(version)
        except Exception as e:  # shown below
            errors.append(e)

    threads = [threading.Thread(target=run) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and len(store.versions()) == 2
    assert store.read().count() == 40
    assert store.refresh(texts, encoder, "m", 2).count() == len(TEXTS)


def test_wrong_vectors_and_older_files_count_as_before(spark, texts, tmp_path):
    path = str(tmp_path / "store")
    keyed = embeddings.keyed(texts, "m").dropDuplicates(["key"])
    keyed.filter("id < 10").selectExpr("key", "array(cast(7 as float), cast(7 as float)) as vector").write.parquet(path)
    keyed.filter("id between 10 and 12").selectExpr("key", "array(cast(1 as float)) as vector").write.mode("append").parquet(path)
    got = {r["id"]: list(r["vector"]) for r in embeddings.embedding_refresh(texts, path, encoder, "m", 2).collect()}
    assert got[3] == [7.0, 7.0] and got[11] == [7.0, 1.0] and len(got) == len(TEXTS)
    again = embeddings.VectorStore(spark, path)
    again.refresh(texts, failing, "m", 2).count()  # nothing is left to encode
    assert again.read(2).count() == 40
