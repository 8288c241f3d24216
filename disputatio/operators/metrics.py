"""Classifier metrics. Everything is derived from the confusion counts, a table of a few rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputatio.functions.labels import adjust_label, convert_label

# The threshold grid of the sweep.
THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def confusion_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", group: Sequence[str] = ()) -> DataFrame:
    """Long-form confusion matrix: ``group, y_true, y_pred, n``."""
    weight = F.sum("n") if "n" in df.columns else F.count(F.lit(1))
    return df.groupBy(*group, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(weight.alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def class_counts(confusion: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per class: hits, true rows and predicted rows; classes seen in either column."""
    none = F.lit(0).cast("long")
    as_true = F.struct(
        F.col("y_true").alias("label"),
        F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(none).alias("tp"),
        F.col("n").alias("support"),
        none.alias("predicted"),
    )
    as_pred = F.struct(F.col("y_pred").alias("label"), none.alias("tp"), none.alias("support"), F.col("n").alias("predicted"))
    parts = confusion.select(*group, F.inline(F.array(as_true, as_pred)))
    return parts.groupBy(*group, "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )


def class_rates(confusion: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 per class; a zero division gives 0."""
    counts = class_counts(confusion, group)
    return counts.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("predicted")),
            "recall": _ratio(F.col("tp"), F.col("support")),
            "f1": _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")),
        }
    )


def classification_report(confusion: DataFrame, names: Column, group: Sequence[str] = ()) -> DataFrame:
    """Class rows and the rows ``accuracy``, ``macro avg`` and ``weighted avg``.

    ``names`` turns the ``label`` column into the class name. The accuracy row has its value in ``f1``.
    """
    rates = class_rates(confusion, group)
    classes = rates.select(*group, names.alias("class"), "precision", "recall", "f1", "support")
    total = F.sum("support")

    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * F.col("support")) / total

    def row(kind: str, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("class"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), total.alias("support")
        )

    empty = F.lit(None).cast("double")
    rows = F.array(
        row("accuracy", empty, empty, F.sum("tp") / total),
        row("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
        row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
    )
    summary = rates.groupBy(*group).agg(rows.alias("_rows")).select(*group, F.inline("_rows"))
    return classes.unionByName(summary)


def multiclass_metrics(confusion: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Macro, micro and weighted precision, recall and F1, accuracy and Matthews correlation."""
    rates = class_rates(confusion, group)
    total = F.sum("support")
    accuracy = F.sum("tp") / total

    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * F.col("support")) / total

    t, p = F.col("support").cast("double"), F.col("predicted").cast("double")
    s, c = total.cast("double"), F.sum("tp").cast("double")
    spread = F.sqrt((s * s - F.sum(p * p)) * (s * s - F.sum(t * t)))
    return rates.groupBy(*group).agg(
        F.avg("f1").alias("macro_f1"),
        accuracy.alias("micro_f1"),
        weighted("f1").alias("weighted_f1"),
        _ratio(c * s - F.sum(p * t), spread).alias("matthews_correlation"),
        accuracy.alias("accuracy_normalized"),
        F.sum("tp").alias("accuracy_not_normalized"),
        F.avg("precision").alias("macro_precision"),
        accuracy.alias("micro_precision"),
        weighted("precision").alias("weighted_precision"),
        F.avg("recall").alias("macro_recall"),
        accuracy.alias("micro_recall"),
        weighted("recall").alias("weighted_recall"),
    )


def threshold_confusion(
    predictions: DataFrame, y_true: str, label: str, score: str, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Confusion counts per threshold.

    Predictions are counted by (truth, label, score) first. Scores have two decimals, so only a few
    hundred counts are repeated per threshold, not the predictions.
    """
    groups = predictions.groupBy(
        F.col(y_true).alias("y_true"), F.col(label).alias("_label"), F.col(score).alias("_score")
    ).agg(F.count(F.lit(1)).alias("n"))
    grid = groups.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    coded = grid.withColumn("y_pred", convert_label(adjust_label(F.col("_label"), F.col("_score"), F.col("threshold"))))
    return confusion_counts(coded, group=["threshold"])


def best_threshold(sweep: DataFrame, metric: str) -> DataFrame:
    """Threshold with the greatest metric; the lowest one among equals."""
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col("threshold")).alias("t")))
    return sweep.agg(best.alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.m").alias(metric))
