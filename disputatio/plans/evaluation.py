"""End-to-end evaluation and preparation jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputatio.functions.labels import label_name, round_percent
from disputatio.functions.parsing import parse_evidence
from disputatio.functions.prompts import PROMPTS
from disputatio.operators.evidence import with_best_sentence
from disputatio.operators.generation import ModelFactory, generate_from_template
from disputatio.operators.metrics import THRESHOLDS, classification_report, threshold_confusion
from disputatio.operators.reshape import (
    SEPARATOR,
    confidence_head,
    first_record,
    stamp,
    strip_time_zone,
    training_filter,
    with_input_text,
)
from disputatio.operators.stance import StanceRule, with_struct


def predict_stance(df: DataFrame, topic: Column, text: Column, lang: Column, rule: StanceRule) -> DataFrame:
    """Add ``label``, ``score`` and ``model_generation``."""
    return with_struct(df, rule(topic, text, lang))


def sweep_reports(
    predictions: DataFrame, y_true: str, label: str = "label", score: str = "score", thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Classification report per threshold, all in one job over counts."""
    confusion = threshold_confusion(predictions, y_true, label, score, thresholds)
    return classification_report(confusion, label_name(F.col("label")), ["threshold"])


def evaluate_stance(
    labelled: DataFrame,
    *,
    key: Sequence[str],
    y_true: str,
    confidence: str,
    topic: Column,
    text: Column,
    lang: Column,
    rule: StanceRule,
    minimum: float = 0.5,
    rows: int | None = None,
    thresholds: Sequence[float] = THRESHOLDS,
) -> DataFrame:
    """Classify the confident rows and report each threshold in percent."""
    chosen = confidence_head(labelled, confidence, key, minimum, rows)
    report = sweep_reports(predict_stance(chosen, topic, text, lang, rule), y_true, thresholds=thresholds)
    return report.withColumns({c: round_percent(F.col(c)) for c in ("precision", "recall", "f1")})


def extract_evidence(
    df: DataFrame, slots: Mapping[str, Column], context: str, model: ModelFactory, template: str = PROMPTS["evidence"], keep: bool = False
) -> DataFrame:
    """Prompt a model for evidence and replace its segment by the nearest sentence of the context.

    An answer that cannot be read counts as empty, and an empty segment gets the first sentence.
    """
    answered = generate_from_template(df, template, slots, model, "_answer", keep)
    parsed = answered.withColumn("_evidence", parse_evidence(F.col("_answer")))
    parsed = parsed.withColumns({"_segment": F.col("_evidence.reasoning_segment"), "reasoning": F.col("_evidence.reasoning")})
    matched = with_best_sentence(parsed, "_segment", context, "_match")
    segment = F.coalesce(F.col("_match_sentence"), F.lit(""))
    return matched.withColumn("reasoning_segment", segment).select(*df.columns, "reasoning_segment", "reasoning")


def evaluate_evidence(
    df: DataFrame, *, topic: str, claim: str, context: str, stance: str, model: ModelFactory, model_name: str, prompt: str = "evidence"
) -> DataFrame:
    """Evidence for every row of a test set, stamped with prompt and model."""
    slots = {"topic": F.col(topic), "claim": F.col(claim), "context": F.col(context), "stance": F.col(stance)}
    found = extract_evidence(df, slots, context, model, PROMPTS[prompt])
    return stamp(found, prompt=prompt, evaluated_model=model_name)


def prepare_training_set(
    df: DataFrame, *, topic: str, argument: str, stance: str, quality: str, part: str, minimum: float = 0.5, separator: str = SEPARATOR
) -> DataFrame:
    """Filtered rows with classifier input, 0/1 label and part, in one pass."""
    rows = with_input_text(training_filter(df, stance, quality, minimum), topic, argument, stance, separator)
    return rows.select(*[c for c in df.columns if c not in (topic, argument)], "input_text", "label")


def split_sizes(prepared: DataFrame, part: str = "set") -> DataFrame:
    """Rows per part."""
    return prepared.groupBy(part).agg(F.count(F.lit(1)).alias("n"))


def prepare_corpus(records: DataFrame, *, key: str, language: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First record per business in a language, time zones removed, as (business, field, value) rows."""
    naive = strip_time_zone(records)
    first = first_record(naive, language, fields, [key], order)
    texts = first.select(key, *[F.col(f).cast("string").alias(f) for f in fields])
    return texts.unpivot([key], list(fields), "field", "value")
