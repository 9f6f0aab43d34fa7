import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from replyloom.constants import LABELS, VECTOR_GRID
from replyloom.operators import embeddings, features, heads, metrics, quality, sampling, selection
from replyloom.plans import evaluate
from replyloom.plans.evaluate import build_golden

# --- Fixed values: published confusion matrices (rows = true, in label order) with their headline metrics ----
MATRICES = {
    "keyword_rules": (
        (0.4828, 0.3906, 0.5298),
        [[9, 3, 0, 0, 0, 0, 0, 0, 0, 7], [0, 0, 0, 0, 0, 0, 0, 0, 0, 2], [0, 0, 1, 0, 0, 0, 0, 0, 0, 0],
         [0, 0, 0, 1, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0, 0, 0, 0, 0],
         [0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 0, 0, 1],
         [0, 0, 0, 0, 0, 0, 0, 0, 0, 2]],
    ),
    "majority": (
        (0.6552, 0.0792, 0.5187),
        [[n] + [0] * 9 for n in (19, 2, 1, 1, 1, 1, 0, 1, 1, 2)],
    ),
    "tfidf_logreg": (
        (0.6207, 0.0783, 0.5127),
        [[18, 0, 0, 0, 0, 0, 0, 0, 0, 1], [1, 0, 0, 0, 0, 0, 0, 0, 0, 1]] + [[n] + [0] * 9 for n in (1, 1, 1, 1, 0, 1, 1, 2)],
    ),
    "logreg_head": (
        (0.6552, 0.3032, 0.6586),
        [[16, 1, 1, 1, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 2, 0, 0], [0, 0, 1, 0, 0, 0, 0, 0, 0, 0],
         [0, 0, 0, 0, 0, 0, 0, 1, 0, 0], [0, 1, 0, 0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 0, 0, 1],
         [0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 0, 1, 0],
         [1, 0, 0, 0, 0, 0, 0, 0, 0, 1]],
    ),
    "prototype": (
        (0.5517, 0.3894, 0.6029),
        [[12, 1, 1, 2, 0, 0, 0, 2, 0, 1], [0, 0, 0, 0, 0, 0, 0, 2, 0, 0], [0, 0, 1, 0, 0, 0, 0, 0, 0, 0],
         [0, 0, 0, 0, 0, 0, 0, 1, 0, 0], [0, 1, 0, 0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 1, 0, 0, 0, 0],
         [0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [1, 0, 0, 0, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0, 0, 1, 0],
         [1, 0, 0, 0, 0, 0, 0, 0, 0, 1]],
    ),
}
# --- Fixed values: published selection grid (accuracy, macro-F1), in the order of VECTOR_GRID -----------------
GRID_SCORES = [
    (0.6338, 0.0776), (0.4155, 0.3666), (0.6338, 0.0776), (0.6338, 0.4202),
    (0.6831, 0.2642), (0.7042, 0.4114), (0.7113, 0.3495), (0.7113, 0.4288),
]
# --- Fixed values: published class sizes and splits (total, train, val, test) --------------------------------
SPLITS = {
    "software_bug": (128, 90, 19, 19), "device_hardware": (11, 7, 2, 2), "account_icloud": (9, 7, 1, 1),
    "connectivity": (9, 7, 1, 1), "billing_purchases": (5, 3, 1, 1), "repair_warranty": (6, 4, 1, 1),
    "security_privacy": (2, 2, 0, 0), "general_complaint": (9, 7, 1, 1), "support_process": (6, 4, 1, 1),
    "other": (15, 11, 2, 2),
}


def expand(spark, name):
    rows = [
        (name, LABELS[i], LABELS[j])
        for i, row in enumerate(MATRICES[name][1])
        for j, n in enumerate(row)
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "model string, label string, predicted string")


@pytest.mark.parametrize("name", list(MATRICES))
def test_published_metrics(spark, name):
    preds = expand(spark, name)
    row = metrics.headline(preds).first()
    assert (round(row["accuracy"], 4), round(row["macro_f1"], 4), round(row["weighted_f1"], 4)) == MATRICES[name][0]
    cells = metrics.confusion_matrix(preds).orderBy("priority", "predicted_priority").collect()
    assert np.array([c["count"] for c in cells]).reshape(10, 10).tolist() == MATRICES[name][1]
    unseen = {r["label"]: r for r in metrics.class_report(preds).collect()}["security_privacy"]
    assert (unseen["precision"], unseen["recall"], unseen["f1"], unseen["support"]) == (0, 0, 0, 0)


def test_deltas(spark):
    preds = expand(spark, "logreg_head").union(expand(spark, "majority"))
    out = metrics.model_deltas(metrics.model_scores(preds), [("logreg_head", "majority")]).collect()
    assert {r["metric"]: round(r["delta"], 4) for r in out}["macro_f1"] == 0.224


def test_grid_rules(spark):
    rows = [
        (i, g["C"], g["class_weight"], a, f, round((a + f) / 2, 4))
        for i, (g, (a, f)) in enumerate(zip(VECTOR_GRID, GRID_SCORES))
    ]
    grid = spark.createDataFrame(
        rows, "position int, c double, class_weight string, accuracy double, macro_f1 double, mean_score double"
    )
    best = metrics.best_config(grid).first()
    assert (best["c"], best["class_weight"]) == (100.0, "balanced")
    best_of = {r["weighting"]: (r["c"], r["macro_f1"]) for r in metrics.weighting_comparison(grid).collect()}
    assert best_of == {"none": (100.0, 0.3495), "balanced": (100.0, 0.4288)}
    tied = grid.withColumn("mean_score", F.lit(0.5)).withColumn("macro_f1", F.lit(0.1))
    assert metrics.best_config(tied).first()["position"] == 7


def labelled(spark, sizes):
    rows = [(f"{label}-{i}", label) for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "conversation_id string, label string").repartition(5)


def test_published_split_counts(spark):
    rows = labelled(spark, {k: v[0] for k, v in SPLITS.items()})
    out = metrics.class_split_counts(sampling.stratified_split(rows)).collect()
    assert {r["label"]: (r["total"], r["train"], r["val"], r["test"]) for r in out} == SPLITS


@pytest.mark.parametrize("n,expected", [(1, (1, 0, 0)), (2, (2, 0, 0)), (10, (6, 2, 2)), (30, (22, 4, 4))])
def test_split_rounding(spark, n, expected):
    out = sampling.stratified_split(labelled(spark, {"other": n})).groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in out}
    assert tuple(counts.get(s, 0) for s in ("train", "val", "test")) == expected


def test_folds(spark):
    out = sampling.kfold_assign(labelled(spark, {"a": 12, "b": 2})).groupBy("label", "fold").count().collect()
    assert sorted(r["count"] for r in out if r["label"] == "a") == [2, 2, 2, 3, 3]
    assert sum(r["count"] for r in out if r["label"] == "b") == 2


def test_golden_gate(spark):
    sheet = spark.createDataFrame([(str(i), str(i), "", "7", "t") for i in range(6)], "conversation_id string, tweet_id string, created_at string, author_id string, text string")
    good = spark.createDataFrame([(str(i), "other") for i in range(6)], "conversation_id string, label string")
    assert build_golden(sheet, good).count() == 6
    bad = spark.createDataFrame([("0", "nonsense"), ("1", "other"), ("99", "other")], "conversation_id string, label string")
    twice = sheet.union(sheet.limit(1))
    out = {r["name"]: r["violations"] for r in quality.golden_gate(twice, bad).collect()}
    assert out["no_unknown_ids"] == 1 and out["labels_valid"] == 1 and out["all_labelled"] == 4
    assert out["worksheet_ids_unique"] == 1
    with pytest.raises(quality.GateError, match="labels_valid"):
        build_golden(sheet, bad)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.RandomState(0)
    rows = [(i, LABELS[i % 3], [float(x) for x in rng.normal(i % 3, 1.5, 4)]) for i in range(120) if i % 3 or i % 2]
    return spark.createDataFrame(rows, "conversation_id int, label string, vector array<float>").withColumn(
        "features", array_to_vector("vector")
    )


@pytest.mark.parametrize("weighting", [None, "balanced"])
def test_logistic_optimum(spark, cloud, weighting, tmp_path):
    """The gradient of C * sum(w * loss) + |W|^2 / 2 vanishes at the fitted coefficients."""
    c = 2.0
    head = heads.LogRegHead(c, weighting, tol=1e-12).fit(cloud)
    rows = cloud.collect()
    x = np.array([r["vector"] for r in rows])
    y = np.array([head.classes.index(r["label"]) for r in rows])
    w = np.bincount(y)
    weights = (len(y) / (3 * w))[y] if weighting else np.ones(len(y))
    coef, icpt = head.model.coefficientMatrix.toArray(), head.model.interceptVector.toArray()
    z = x @ coef.T + icpt
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    residual = (p - np.eye(3)[y]) * weights[:, None]
    assert np.abs(c * residual.T @ x + coef).max() < 1e-3
    head.save(str(tmp_path / "head"))
    again = heads.LogRegHead.load(spark, str(tmp_path / "head"))
    cols = ["conversation_id", "predicted", "runner_up"]
    assert again.predict(cloud).select(cols).exceptAll(head.predict(cloud).select(cols)).isEmpty()
    first = head.predict(cloud).first()
    assert first["confidence"] >= first["runner_up_confidence"]


def test_prototype(spark, tmp_path):
    train = spark.createDataFrame(
        [("b", [0.0, 2.0]), ("b", [0.0, 4.0]), ("a", [3.0, 0.0]), ("z", [0.0, 0.0])], "label string, vector array<float>"
    )
    model = heads.PrototypeModel.fit(train)
    assert {r["label"]: r["centroid"] for r in model.centroids.collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0], "z": [0.0, 0.0]}
    rows = spark.createDataFrame(
        [(1, [0.0, 9.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [-1.0, 0.0])], "id int, vector array<float>"
    )
    out = {r["id"]: r for r in model.predict(rows).collect()}
    assert out[1]["predicted"] == "b" and out[1]["runner_up"] == "a"
    assert out[1]["confidence"] == pytest.approx(math.e / (math.e + 2))
    assert out[2]["predicted"] == "a" and out[2]["confidence"] == pytest.approx(1 / 3)
    assert out[3]["predicted"] is None and out[4]["predicted"] is None
    assert out[5]["predicted"] == "b"
    assert heads.centroid_scores(rows, model.centroids).filter("score IS NOT NULL").count() == 9
    model.save(str(tmp_path / "p"))
    again = heads.PrototypeModel.load(spark, str(tmp_path / "p"))
    assert again.predict(rows).exceptAll(model.predict(rows)).isEmpty()


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "red hen"), (3, "the a")], "doc_id int, text string")
    vectorizer = features.TfidfVectorizer(["the"]).fit(docs)
    counts = features.term_counts(docs, ["the"])
    out = {(r["doc_id"], r["term"]): r["weight"] for r in features.tfidf_weights(counts, vectorizer.vocab.drop("index")).collect()}
    idf = lambda df: math.log(4 / (1 + df)) + 1
    raw = {"red": (1 + math.log(2)) * idf(2), "fox": idf(1), "red red": idf(1), "red fox": idf(1)}
    length = math.sqrt(sum(v * v for v in raw.values()))
    for term, v in raw.items():
        assert out[1, term] == pytest.approx(v / length)
    vectors = {r["doc_id"]: r["features"] for r in vectorizer.transform(docs).collect()}
    assert vectors[3].numNonzeros() == 0 and vectors[1].numNonzeros() == 4
    assert features.vocabulary(docs, counts, min_df=2).count() == 1


def test_pooled_grid_search(spark, cloud):
    rows = sampling.kfold_assign(cloud, folds=3)
    grid = [{"C": 1.0, "class_weight": None}, {"C": 1.0, "class_weight": "balanced"}]
    preds = selection.out_of_fold(rows, grid, selection.vector_fit_predict)
    assert preds.count() == 2 * cloud.count()
    out = selection.grid_scores(preds, grid).orderBy("position").collect()
    assert [r["class_weight"] for r in out] == [None, "balanced"]
    for r in out:
        assert r["mean_score"] == pytest.approx((r["accuracy"] + r["macro_f1"]) / 2, abs=1e-4)


def test_models_side_by_side(spark, cloud):
    golden = sampling.stratified_split(cloud.withColumn("text", F.concat(F.lit("my ios "), "label")))
    grid = ({"C": 1.0, "class_weight": None}, {"C": 10.0, "class_weight": "balanced"})
    done = {
        "keyword": evaluate.keyword_baseline(golden),
        "majority": evaluate.majority_baseline(golden),
        "text": evaluate.tfidf_head(golden, {"C": 10.0}),
        "vector": evaluate.vector_head(golden, grid=grid),
        "centroid": evaluate.prototype_head(golden),
    }
    # Fifteen test rows of three overlapping clouds say little, so the vector head is judged on its training rows.
    compared = evaluate.compare(done)
    scores = metrics.model_scores(sampling.split_rows(compared, "test"))
    fitted = metrics.model_scores(sampling.split_rows(compared, "train")).filter("metric = 'accuracy'")
    accuracy = {r["model"]: r["value"] for r in scores.filter("metric = 'accuracy'").collect()}
    assert set(accuracy) == set(done)
    assert {r["model"]: r["value"] for r in fitted.collect()}["vector"] > 0.6
    assert accuracy["text"] == 1.0
    assert accuracy["keyword"] == pytest.approx(3 / 15)  # the keyword rule names one of the classes


def test_embedding_refresh(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def encoder(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb"), (4, "ccc")], "id int, text string")
    path = str(tmp_path / "store")
    known = embeddings.keyed(texts.filter("id in (1, 4)"), "m").withColumn(
        "vector", F.when(F.col("id") == 1, F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0))).cast("array<float>")
    )
    known.select("key", "vector").write.parquet(path)
    out = {r["id"]: r["vector"] for r in embeddings.embedding_refresh(texts, path, encoder, "m", 2).collect()}
    assert out == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [2.0, 1.0], 4: [3.0, 1.0]}
    assert calls.value == 2
    embeddings.embedding_refresh(texts, path, encoder, "m", 2).count()
    assert calls.value == 2
