"""Labelled sets and few-shot examples."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the labelled inputs.
TRAINING_SCHEMA = (
    "topic_EN string, argument_EN string, topic_DE string, argument_DE string, "
    "stance_label_EN int, quality_score_EN double, `set` string"
)
TEST_SCHEMA = "topic_DE string, argument_DE string, stance_label int, stance_conf double"
EVIDENCE_SCHEMA = "`Worum geht es?` string, Meinung string, Kontext string, Haltung string"
FEW_SHOT_SCHEMA = "topic string, thema string, argument string, label string, reasoning string"


def read_labelled_csv(spark: SparkSession, path: str, schema: str = TRAINING_SCHEMA) -> DataFrame:
    """CSV with a header and quoted multi-line fields; columns are matched to the header by name."""
    header = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    wanted = spark.createDataFrame([], schema).schema
    missing = [f.name for f in wanted.fields if f.name not in header.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return header.selectExpr(*[f"try_cast(`{f.name}` as {f.dataType.simpleString()}) as `{f.name}`" for f in wanted.fields])


class CheckedRows(NamedTuple):
    """``rows`` in the wanted types; ``rejects`` with the ``record`` as it was and the ``reasons`` it was left out for."""

    rows: DataFrame
    rejects: DataFrame


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field goes over several lines: only then a line holds an odd number of quotes."""
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(odd % 2 == 1).isEmpty()


def read_checked_csv(spark: SparkSession, path: str, schema: str = TRAINING_SCHEMA, multi_line: bool | None = None) -> CheckedRows:
    """Like :func:`read_labelled_csv`, but nothing gets lost: what does not fit its column comes back as a reject.

    A record is rejected if it has more or fewer fields than the header, or a value that is no number of its column's type. Missing
    values are no fault. Files without line breaks in fields are split over tasks (``multi_line=None`` looks at the quotes
    first); others are one task per file, as a line break alone does not tell where a record ends.
    """
    if multi_line is None:
        multi_line = has_line_breaks(spark, path)
    options = {"header": True, "escape": '"', "multiLine": multi_line}
    names = spark.read.csv(path, **options, enforceSchema=False).columns
    wanted = spark.createDataFrame([], schema).schema
    missing = [f.name for f in wanted.fields if f.name not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    corrupt = "_corrupt_record"
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in [*names, corrupt])).csv(path, **options, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt)
    cast = {f.name: F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") for f in wanted.fields}
    faults = [F.when(F.col(f"`{n}`").isNotNull() & c.isNull(), F.lit(n)) for n, c in cast.items()]
    reasons = F.filter(F.array(F.when(F.col(corrupt).isNotNull(), F.lit("number of fields")), *faults), lambda r: r.isNotNull())
    judged = raw.withColumn("_reasons", reasons)
    rows = judged.where(F.size("_reasons") == 0).select(*[c.alias(n) for n, c in cast.items()])
    record = F.coalesce(F.col(corrupt), F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])))
    return CheckedRows(rows, judged.where(F.size("_reasons") > 0).select(record.alias("record"), F.col("_reasons").alias("reasons")))


def read_evidence_set(spark: SparkSession, path: str) -> DataFrame:
    """Evidence test set from Parquet or CSV, by the path's suffix."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return read_labelled_csv(spark, path, EVIDENCE_SCHEMA)


def read_few_shot(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of examples."""
    return spark.read.schema(FEW_SHOT_SCHEMA).json(path, multiLine=True)
