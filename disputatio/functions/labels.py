"""Stance labels: normalising, thresholding, coding, rounding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from disputatio.functions.text import strip_whitespace

# The three stances and their integer codes.
STANCES = ("pro", "contra", "neutral")
CODE_TO_NAME = {-1: "Contra", 0: "Neutral", 1: "Pro"}
CLASSIFIER_CODE_TO_NAME = {0: "Contra", 1: "Pro"}


def normalize_label(generation: Column, strict: bool = False) -> Column:
    """Turn free model output into a label.

    An output that begins (or else ends) with a stance yields its first (or last) blank-separated
    piece, punctuation included; anything else is neutral. ``strict`` maps every outcome to one of
    the three stances.
    """
    text = F.lower(strip_whitespace(generation))
    pieces = F.split(text, " ")
    begins = text.rlike(f"^({'|'.join(STANCES)})")
    ends = text.rlike(f"({'|'.join(STANCES)})$")
    label = (
        F.when(begins, F.element_at(pieces, 1))
        .when(ends, F.element_at(pieces, -1))
        .otherwise(F.lit("neutral"))
    )
    if not strict:
        return label
    found = F.regexp_extract(label, f"({'|'.join(STANCES)})", 1)
    return F.when(found == "", "neutral").otherwise(found)


def adjust_label(label: Column, score: Column, threshold: Column | float | None) -> Column:
    """Lower-case a label, or fall back to ``Neutral`` when its score is below the threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    keep = limit.isNull() | score.isNull() | (score >= limit)
    return F.when(keep, F.lower(label)).otherwise(F.lit("Neutral"))


def convert_label(label: Column) -> Column:
    """Stance code by prefix: 1 for pro, -1 for contra, 0 for anything else."""
    text = F.lower(strip_whitespace(label))
    return F.when(text.startswith("pro"), 1).when(text.startswith("contra"), -1).otherwise(0)


def label_name(code: Column, names: Mapping[int, str] = CODE_TO_NAME) -> Column:
    """Name of a label code; an unknown code is an error."""
    out = F
    for key, name in names.items():
        out = out.when(code == key, F.lit(name))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown label code "), code.cast("string"))))


def round_percent(value: Column) -> Column:
    """Rates up to 1.0 as a percentage with two decimals; larger values are left as they are."""
    return F.when(value <= 1.0, F.round(value * 100, 2)).otherwise(value)


def argmax(scores: Column) -> Column:
    """Zero-based position of the first maximum of an array."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def safe_model_name(name: Column) -> Column:
    """Model name that can be part of a file name."""
    return F.replace(name, F.lit("/"), F.lit("_"))


def base_name(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(path, "/", -1)
