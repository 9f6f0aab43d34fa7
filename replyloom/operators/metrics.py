"""Classification metrics over ``(label, predicted)`` rows. All are computed from the confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replyloom.constants import CONFIDENCE_THRESHOLD, ERROR_TEXT_CHARS, LABELS
from replyloom.functions.text import clip
from replyloom.operators.taxonomy import label_table


def confusion_counts(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return predictions.groupBy(*by, "label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, labels=LABELS) -> DataFrame:
    """``(label, predicted, count)`` for every pair of labels, zeros included."""
    spark = predictions.sparkSession
    grid = label_table(spark, labels).select(
        "priority", "label", F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("predicted_priority", "predicted")
    )
    return grid.join(confusion_counts(predictions), ["label", "predicted"], "left").select(
        "priority", "predicted_priority", "label", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("count")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every label seen, from confusion counts."""
    ends = F.array(
        F.struct(F.col("label").alias("label"), F.lit(1).alias("true"), F.lit(0).alias("guess")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).alias("true"), F.lit(1).alias("guess")),
    )
    hit = F.col("label") == F.col("predicted")
    sums = (
        counts.select(*by, F.when(hit, F.col("n")).otherwise(0).alias("hit"), "n", F.explode(ends).alias("e"))
        .groupBy(*by, F.col("e.label").alias("label"))
        .agg(
            F.sum(F.col("hit") * F.col("e.true")).alias("tp"),
            F.sum(F.col("n") * F.col("e.true")).alias("support"),
            F.sum(F.col("n") * F.col("e.guess")).alias("guessed"),
        )
    )
    return sums.select(
        *by,
        "label",
        _ratio(F.col("tp"), F.col("guessed")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("guessed")).alias("f1"),
        "support",
        "tp",
    )


def class_report(predictions: DataFrame, labels=LABELS) -> DataFrame:
    """Precision, recall, F1 and support of every label of the taxonomy; unseen ones score 0."""
    seen = per_class(confusion_counts(predictions))
    return (
        label_table(predictions.sparkSession, labels)
        .join(seen.drop("tp"), "label", "left")
        .na.fill(0, ["precision", "recall", "f1", "support"])
    )


def headline(predictions: DataFrame, labels=LABELS, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, macro-F1 and weighted-F1 over the taxonomy, per group of ``by``.

    With ``labels=None`` the macro average runs over the labels seen in each group instead.
    """
    return per_class(confusion_counts(predictions, tuple(by)), tuple(by)).groupBy(*by).agg(*_averages(labels))


def _averages(labels) -> list[Column]:
    """Aggregates over all per-class rows. Every row of the data is in the support of exactly one label."""
    counted = F.lit(True) if labels is None else F.col("label").isin(*labels)
    size = F.count(F.lit(1)) if labels is None else F.lit(len(labels))
    weighted = F.sum(F.when(counted, F.col("f1") * F.col("support")))
    return [
        F.coalesce(F.sum("support"), F.lit(0)).alias("rows"),
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        (F.coalesce(F.sum(F.when(counted, F.col("f1"))), F.lit(0.0)) / size).alias("macro_f1"),
        _ratio(weighted, F.sum(F.when(counted, F.col("support")))).alias("weighted_f1"),
    ]


def classification_report(predictions: DataFrame, labels=LABELS) -> DataFrame:
    """Headline and per-class metrics in long form: ``(label, metric, value)``; label ``''`` is the whole set.

    Both come from one row that holds the averages and the taxonomy's classes, so predictions are read once.
    """
    fields = ("precision", "recall", "f1", "support")
    known = F.when(F.col("label").isin(*labels), F.struct("label", F.struct(*fields).alias("scores")))
    row = per_class(confusion_counts(predictions)).agg(
        *_averages(labels), F.map_from_entries(F.collect_list(known)).alias("_classes")
    )

    def cell(label: str, metric: str, value: Column) -> Column:
        value = F.coalesce(value.cast("double"), F.lit(0.0))
        return F.struct(F.lit(label).alias("label"), F.lit(metric).alias("metric"), value.alias("value"))

    whole = [cell("", m, F.col(m)) for m in ("accuracy", "macro_f1", "weighted_f1")]
    classes = [cell(x, m, F.try_element_at("_classes", F.lit(x))[m]) for x in labels for m in fields]
    return row.select(F.inline(F.array(*whole, *classes)))


def fold_scores(predictions: DataFrame, labels=None, fold: str = "fold") -> DataFrame:
    """Macro-F1 of each fold; by default over the labels seen in the fold."""
    return headline(predictions, labels, by=(fold,)).select(fold, "macro_f1")


def cv_fold_scores(predictions: DataFrame, labels=None, fold: str = "fold") -> DataFrame:
    """Number of folds, mean and population deviation of the fold scores."""
    return fold_scores(predictions, labels, fold).agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("macro_f1").alias("macro_f1_mean"),
        F.stddev_pop("macro_f1").alias("macro_f1_std"),
    )


def model_scores(predictions: DataFrame, labels=LABELS) -> DataFrame:
    """``(model, metric, value)`` from rows ``(model, label, predicted)``."""
    scores = headline(predictions, labels, by=("model",))
    cells = [
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "macro_f1", "weighted_f1")
    ]
    return scores.select("model", F.inline(F.array(*cells)))


def model_deltas(scores: DataFrame, comparisons) -> DataFrame:
    """Metric differences for the given (model, baseline) pairs; pairs with an unknown model are left out.

    A metric's values of all models come together in one row, so the scores are computed once.
    """
    values = scores.groupBy("metric").agg(F.map_from_entries(F.collect_list(F.struct("model", "value"))).alias("_values"))
    value = lambda model: F.try_element_at("_values", F.lit(model))
    pairs = [F.struct(F.lit(m).alias("model"), F.lit(b).alias("baseline"), (value(m) - value(b)).alias("delta")) for m, b in comparisons]
    return values.select("metric", F.inline(F.array(*pairs))).filter("delta IS NOT NULL").select("model", "baseline", "metric", "delta")


def confidence_preview(predictions: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Mean confidence of right and wrong rows; share and accuracy at or above the threshold."""
    sure = F.bround("confidence", 4)
    right = F.col("label") == F.col("predicted")
    above = sure >= F.lit(float(threshold))
    return predictions.agg(
        F.avg(F.when(right, sure)).alias("mean_confidence_correct"),
        F.avg(F.when(~right, sure)).alias("mean_confidence_wrong"),
        F.avg(F.when(above, 1.0).otherwise(0.0)).alias("share_above_threshold"),
        F.avg(F.when(above, F.when(right, 1.0).otherwise(0.0))).alias("accuracy_above_threshold"),
    )


def error_analysis(predictions: DataFrame, chars: int = ERROR_TEXT_CHARS) -> DataFrame:
    """Wrong rows with both best classes and a clipped text."""
    return predictions.filter(F.col("label") != F.col("predicted")).select(
        "conversation_id",
        clip(F.col("text"), chars).alias("text"),
        F.col("label").alias("true_label"),
        F.col("predicted").alias("predicted_label"),
        F.bround("confidence", 4).alias("confidence"),
        "runner_up",
        F.bround("runner_up_confidence", 4).alias("runner_up_confidence"),
    )


def class_split_counts(rows: DataFrame, labels=LABELS) -> DataFrame:
    """Label by split, with totals; empty classes show 0."""
    split = F.col("split")
    counts = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(split == s).alias(s) for s in ("train", "val", "test")],
    )
    return (
        label_table(rows.sparkSession, labels)
        .join(counts, "label", "left")
        .na.fill(0, ["total", "train", "val", "test"])
    )


def majority_class(rows: DataFrame, label: str = "label") -> DataFrame:
    """Most frequent label; ties go to the smallest."""
    return (
        rows.groupBy(label)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), label)
        .limit(1)
    )


def majority_predict(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row gets the majority class of the training rows."""
    return rows.withColumn("predicted", majority_class(train).select("label").scalar())


def best_config(grid: DataFrame, score: str = "mean_score", tie: str = "macro_f1", position: str = "position") -> DataFrame:
    """Best grid row; ties go to the higher macro-F1, then to the later row."""
    return grid.orderBy(F.desc(score), F.desc(tie), F.desc(position)).limit(1)


def weighting_comparison(grid: DataFrame) -> DataFrame:
    """Best unweighted and best balanced grid row; the first one wins a tie."""
    weighting = F.coalesce("class_weight", F.lit("none"))
    window = Window.partitionBy("weighting").orderBy(F.desc("mean_score"), "position")
    return (
        grid.withColumn("weighting", weighting)
        .withColumn("_n", F.row_number().over(window))
        .filter("_n = 1")
        .drop("_n")
    )
