"""Intent classifiers on vectors: multinomial logistic regression and nearest class centroid."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyloom.functions.vectors import NORM_FLOOR, let, unit


def label_counts(rows: DataFrame) -> list[tuple[str, int]]:
    """Classes in name order with their sizes; a model holds its classes, so they fit the driver by definition."""
    found = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()
    return [(r["label"], r["n"]) for r in found]


def top_two(scores: Column, labels: list[str]) -> Column:
    """Struct of the best and second label with their scores; ties go to the first label by name."""
    names = F.array(*[F.lit(x) for x in labels])
    ranked = F.array_sort(
        F.zip_with(scores, names, lambda s, n: F.struct((-s).alias("s"), n.alias("n")))
    )
    return let(
        ranked,
        lambda r: F.struct(
            r[0]["n"].alias("predicted"),
            (-r[0]["s"]).alias("confidence"),
            F.get(r, F.lit(1))["n"].alias("runner_up"),
            (-F.get(r, F.lit(1))["s"]).alias("runner_up_confidence"),
        ),
    )


class LogRegHead:
    """Logistic regression with the usual ``C`` and class weighting."""

    kind = "logreg_head"

    def __init__(self, c: float = 1.0, class_weight: str | None = None, max_iter: int = 5000, tol: float = 1e-6):
        self.c = c
        self.class_weight = class_weight
        self.max_iter = max_iter
        self.tol = tol
        self.classes: list[str] = []
        self.model: LogisticRegressionModel | None = None

    def fit(self, rows: DataFrame, features: str = "features") -> LogRegHead:
        """Rows need ``label`` and a vector column.

        Minimising ``C * sum(w * loss) + |W|^2 / 2`` equals Spark's mean-loss form with
        ``regParam = 1 / (C * sum(w))``; balanced weights ``n / (k * n_c)`` sum to ``n``.
        """
        counts = label_counts(rows)
        self.classes = [label for label, _ in counts]
        n, k = sum(size for _, size in counts), len(counts)
        names = F.array(*[F.lit(x) for x in self.classes])
        data = rows.select(
            F.col(features).alias("features"), (F.array_position(names, F.col("label")) - 1).cast("double").alias("y")
        )
        if self.class_weight == "balanced":
            weights = F.array(*[F.lit(n / (k * size)) for _, size in counts])
            data = data.withColumn("w", weights[F.col("y").cast("int")])
        else:
            data = data.withColumn("w", F.lit(1.0))
        trainer = LogisticRegression(
            featuresCol="features",
            labelCol="y",
            weightCol="w",
            family="binomial" if k == 2 else "multinomial",
            standardization=False,
            elasticNetParam=0.0,
            regParam=1.0 / (self.c * n),
            maxIter=self.max_iter,
            tol=self.tol,
        )
        self.model = trainer.fit(data)
        return self

    def predict(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """Add ``predicted, confidence, runner_up, runner_up_confidence``."""
        scored = self.model.setFeaturesCol(features).transform(rows)
        best = top_two(vector_to_array("probability"), self.classes)
        return scored.withColumn("_best", best).select(*rows.columns, "_best.*")

    def certificate(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """``(label, rows, weighted_size, gap, slope)`` for each class of the training ``rows``: how near the fit is to its minimum.

        There, a class's probabilities add up to its weighted size (``gap`` is 0), and the weighted sum of vectors times
        residuals is balanced by the penalty (``slope``, the largest component for each of the ``n`` rows, is 0).
        """
        counts = dict(label_counts(rows))
        n, k = sum(counts.values()), len(self.classes)
        weight = {c: n / (k * counts[c]) if self.class_weight == "balanced" else 1.0 for c in self.classes}
        scored = self.model.setFeaturesCol(features).transform(rows.select("label", features))
        own = F.create_map(*[F.lit(x) for c in self.classes for x in (c, weight[c])])[F.col("label")]
        p = vector_to_array("probability")
        residual = F.array(*[own * (p[j] - (F.col("label") == c).cast("double")) for j, c in enumerate(self.classes)])
        cells = scored.select(F.col("label"), residual.alias("r"), F.posexplode(vector_to_array(features)).alias("i", "x"))
        per_index = cells.groupBy("i").agg(*[F.sum(F.col("x") * F.col("r")[j]).alias(f"s{j}") for j in range(k)])
        sums = scored.select(residual.alias("r")).agg(*[F.sum(F.col("r")[j]).alias(f"g{j}") for j in range(k)]).first()
        # the model's weights, one row per component; two classes share one set
        matrix = self.model.coefficientMatrix.toArray()
        matrix = np.vstack([-matrix[0], matrix[0]]) if k == 2 else matrix
        spark = rows.sparkSession
        model = spark.createDataFrame([(i, [float(x) for x in column]) for i, column in enumerate(matrix.T)], "i int, w array<double>")
        slope = [F.max(F.abs(self.c * F.col(f"s{j}") + F.col("w")[j]) / n).alias(f"m{j}") for j in range(k)]
        largest = per_index.join(model, "i").agg(*slope).first()
        table = [(c, counts[c], weight[c] * counts[c], abs(float(sums[f"g{j}"])), float(largest[f"m{j}"])) for j, c in enumerate(self.classes)]
        return spark.createDataFrame(table, "label string, rows long, weighted_size double, gap double, slope double")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        meta = [(self.kind, self.classes, float(self.c), self.class_weight)]
        spark.createDataFrame(meta, "kind string, classes array<string>, c double, class_weight string").coalesce(
            1
        ).write.mode("overwrite").json(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LogRegHead:
        meta = read_metadata(spark, path)
        head = cls(meta["c"], meta["class_weight"])
        head.classes = list(meta["classes"])
        head.model = LogisticRegressionModel.load(f"{path}/model")
        return head


def read_metadata(spark: SparkSession, path: str) -> dict:
    """Fields of a saved head; empty where they do not apply."""
    schema = "kind string, classes array<string>, c double, class_weight string"
    return spark.read.schema(schema).json(f"{path}/metadata").first().asDict()


def class_centroids(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """``(label, centroid)``: mean vector per class, scaled to length 1 (a zero mean stays zero).

    The mean is a map-side combined aggregate over whole vectors, so a class of any size reduces to one vector
    per task.
    """
    means = rows.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector(vector))).alias("_mean"))
    return means.select("label", unit(F.col("_mean")).alias("centroid"))


def _matrix(centroids: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model on the driver: classes in name order and their vectors."""
    found = centroids.orderBy("label").collect()
    if not found:
        raise ValueError("no classes")
    matrix = np.array([r["centroid"] for r in found], dtype=np.float64)
    return [r["label"] for r in found], matrix


def _cosines(matrix: np.ndarray, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have the model's length, and the cosines of those to every class."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    dim = matrix.shape[1]
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
    flat = vectors.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    lengths = np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), NORM_FLOOR)
    return fits.to_numpy(zero_copy_only=False), (flat / lengths) @ matrix.T


def centroid_scores(rows: DataFrame, centroids: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows times classes: each row once per class with its cosine ``score``."""
    labels, matrix = _matrix(centroids)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scores(vectors: pa.Array) -> pa.Array:
        fits, sims = _cosines(matrix, vectors)
        ends = np.concatenate([[0], np.cumsum(np.where(fits, len(labels), 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(sims.ravel()), mask=pa.array(~fits))

    names = F.array(*[F.lit(x) for x in labels])
    pairs = F.zip_with(names, scores(F.col(vector)), lambda n, s: F.struct(n.alias("class"), s.alias("score")))
    return rows.select("*", F.inline(pairs))


class PrototypeModel:
    """Nearest class centroid; confidence is a softmax over the cosines."""

    kind = "prototype"

    def __init__(self, centroids: DataFrame):
        self.centroids = centroids
        self.classes, self._vectors = _matrix(centroids)

    @classmethod
    def fit(cls, rows: DataFrame, vector: str = "vector") -> PrototypeModel:
        return cls(class_centroids(rows, vector))

    def predict(self, rows: DataFrame, vector: str = "vector", temperature: float = 1.0) -> DataFrame:
        """Add ``predicted, confidence, runner_up, runner_up_confidence``; NULL where the vector does not fit."""
        classes, matrix = self.classes, self._vectors
        fields = ["predicted", "confidence", "runner_up", "runner_up_confidence"]

        @F.arrow_udf("predicted string, confidence double, runner_up string, runner_up_confidence double")
        def best(vectors: pa.Array) -> pa.Array:
            fits, sims = _cosines(matrix, vectors)
            exps = np.exp((sims - sims.max(axis=1, keepdims=True)) / temperature)
            probs = exps / exps.sum(axis=1, keepdims=True)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :2]
            # Row of the result for each input row; NULL where the vector does not fit.
            place = pa.array(np.cumsum(fits) - 1, mask=~fits)
            names, rows_at = pa.array(classes, pa.string()), np.arange(len(order))
            columns = []
            for rank in range(2):
                if rank < order.shape[1]:
                    at = order[:, rank]
                    columns += [names.take(pa.array(at)).take(place), pa.array(probs[rows_at, at]).take(place)]
                else:
                    columns += [pa.nulls(len(vectors), pa.string()), pa.nulls(len(vectors), pa.float64())]
            return pa.StructArray.from_arrays(columns, fields)

        return rows.withColumn("_best", best(F.col(vector))).select(*rows.columns, "_best.*")

    def save(self, path: str) -> None:
        spark = self.centroids.sparkSession
        table = [(label, [float(x) for x in row]) for label, row in zip(self.classes, self._vectors)]
        spark.createDataFrame(table, "label string, centroid array<double>").write.mode("overwrite").parquet(
            f"{path}/centroids"
        )
        spark.createDataFrame([(self.kind, self.classes)], "kind string, classes array<string>").coalesce(
            1
        ).write.mode("overwrite").json(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PrototypeModel:
        return cls(spark.read.parquet(f"{path}/centroids"))
