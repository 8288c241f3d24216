import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from disputatio.functions.labels import (
    adjust_label,
    argmax,
    base_name,
    convert_label,
    label_name,
    normalize_label,
    round_percent,
    safe_model_name,
)
from disputatio.operators.metrics import (
    best_threshold,
    classification_report,
    confusion_counts,
    multiclass_metrics,
    threshold_confusion,
)
from disputatio.operators.stance import CueRule, allowed_source, says_yes


def values(spark, rows, schema, column):
    return [r["y"] for r in spark.createDataFrame(rows, schema).select(column.alias("y")).collect()]


@pytest.mark.parametrize(
    "generation,label,strict",
    [
        ("Pro", "pro", "pro"),
        (" Contra\n", "contra", "contra"),
        ("Pro.", "pro.", "pro"),
        ("Pro, weil", "pro,", "pro"),
        ("Antwort : Pro", "pro", "pro"),
        ("Antwort:\nPro", "antwort:\npro", "pro"),
        ("Label: Neutral.", "neutral", "neutral"),
        ("proof of x", "proof", "pro"),
        ("unpro", "unpro", "pro"),
        ("", "neutral", "neutral"),
    ],
)
def test_normalize_label(spark, generation, label, strict):
    df = spark.createDataFrame([(generation,)], "g string")
    assert tuple(df.select(normalize_label(F.col("g")), normalize_label(F.col("g"), strict=True)).first()) == (label, strict)


def test_adjust_label(spark):
    rows = [("Pro", 0.8, 0.8), ("Pro", 0.79, 0.8), ("Pro", None, 0.8), ("Pro", 0.1, None)]
    got = values(spark, rows, "l string, s double, t double", adjust_label(F.col("l"), F.col("s"), F.col("t")))
    assert got == ["pro", "Neutral", "pro", "pro"]


def test_label_codes(spark):
    got = values(spark, [("Contra.",), (" PRO",), ("Neutral",), ("x",)], "l string", convert_label(F.col("l")))
    assert got == [-1, 1, 0, 0]
    assert values(spark, [(-1,), (0,), (1,)], "c int", label_name(F.col("c"))) == ["Contra", "Neutral", "Pro"]
    with pytest.raises(Exception, match="unknown label code"):
        values(spark, [(2,)], "c int", label_name(F.col("c")))


def test_small_functions(spark):
    assert values(spark, [(0.8456,), (1.0,), (42.0,)], "v double", round_percent(F.col("v"))) == [84.56, 100.0, 42.0]
    assert values(spark, [([1.0, 3.0, 3.0],)], "v array<double>", argmax(F.col("v"))) == [1]
    assert values(spark, [("a/b",)], "v string", safe_model_name(F.col("v"))) == ["a_b"]
    assert values(spark, [("x/a/b.txt",)], "v string", base_name(F.col("v"))) == ["b.txt"]
    assert values(spark, [(" Ja\n",), ("ja bitte",)], "v string", says_yes(F.col("v"))) == [True, False]
    assert values(spark, [("a",), ("b",)], "v string", allowed_source(F.col("v"), ["a"])) == [True, False]
    assert values(spark, [("a",), ("b",)], "v string", allowed_source(F.col("v"), ["x", "alles"])) == [True, True]


def test_cue_rule(spark):
    rule = CueRule({"de": ["für"]}, {"de": ["nicht"]})
    texts = [("Wir sind für das Gesetz, nicht dagegen, für uns.",), ("Nicht so.",), ("für und nicht",), ("leer",)]
    df = spark.createDataFrame(texts, "t string").select(rule(F.lit(""), F.col("t"), F.lit("de")).alias("s"))
    assert [(r["s"]["label"], r["s"]["score"]) for r in df.collect()] == [("Pro", 0.67), ("Contra", 1.0), ("Neutral", 0.5), ("Neutral", 0.0)]


def direct_metrics(pairs):
    labels = sorted({x for p in pairs for x in p})
    n = len(pairs)
    tp = {c: sum(t == p == c for t, p in pairs) for c in labels}
    t = Counter(a for a, _ in pairs)
    p = Counter(b for _, b in pairs)
    precision = {c: tp[c] / p[c] if p[c] else 0.0 for c in labels}
    recall = {c: tp[c] / t[c] if t[c] else 0.0 for c in labels}
    f1 = {c: 2 * precision[c] * recall[c] / (precision[c] + recall[c]) if precision[c] + recall[c] else 0.0 for c in labels}
    correct = sum(tp.values())
    spread = math.sqrt((n * n - sum(v * v for v in p.values())) * (n * n - sum(v * v for v in t.values())))
    mcc = (correct * n - sum(p[c] * t[c] for c in labels)) / spread if spread else 0.0
    return {
        "macro_f1": sum(f1.values()) / len(labels),
        "micro_f1": correct / n,
        "weighted_f1": sum(f1[c] * t[c] for c in labels) / n,
        "matthews_correlation": mcc,
        "accuracy_not_normalized": correct,
        "macro_precision": sum(precision.values()) / len(labels),
        "weighted_precision": sum(precision[c] * t[c] for c in labels) / n,
        "macro_recall": sum(recall.values()) / len(labels),
        "weighted_recall": sum(recall[c] * t[c] for c in labels) / n,
    }


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([-1, 0, 1]), st.sampled_from([-1, 0, 1])), min_size=1, max_size=40))
def test_metrics_equal_the_direct_formulas(spark, pairs):
    df = spark.createDataFrame(pairs, "y_true int, y_pred int")
    got = multiclass_metrics(confusion_counts(df)).first().asDict()
    for name, want in direct_metrics(pairs).items():
        assert got[name] == pytest.approx(want), name


def test_report_rows(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (-1, -1), (-1, 1)], "y_true int, y_pred int")
    rows = {r["class"]: r for r in classification_report(confusion_counts(df), label_name(F.col("label"))).collect()}
    assert set(rows) == {"Contra", "Neutral", "Pro", "accuracy", "macro avg", "weighted avg"}
    assert rows["Neutral"]["support"] == 0 and rows["Neutral"]["recall"] == 0.0
    assert rows["accuracy"]["f1"] == 0.5 and rows["accuracy"]["precision"] is None


def test_sweep_and_best(spark):
    rows = [(1, "Pro", 0.9), (1, "Pro", 0.55), (0, "Pro", 0.3), (-1, "Contra", 0.7), (0, "Contra", 0.2)]
    df = spark.createDataFrame(rows, "y int, label string, score double")
    confusion = threshold_confusion(df, "y", "label", "score", [0.1, 0.5, 0.8])
    sizes = {r["threshold"]: r["n"] for r in confusion.groupBy("threshold").agg(F.sum("n").alias("n")).collect()}
    assert sizes == {0.1: 5, 0.5: 5, 0.8: 5}
    best = best_threshold(multiclass_metrics(confusion, ["threshold"]), "matthews_correlation").first()
    assert best["threshold"] == 0.5 and best["matthews_correlation"] == pytest.approx(1.0)
