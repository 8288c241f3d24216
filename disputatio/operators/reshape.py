"""Projections, filters and reshaping of argument tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disputatio.operators.ranking import top_k
from disputatio.operators.stance import ANY_SOURCE

SEPARATOR = " [SEP] "

# Display name of each result column, in display order.
DISPLAY_NAMES = {
    "filename": "Quelle",
    "topic_original": "Thema",
    "label": "Haltung",
    "context": "Kontext",
    "argument_reason": "Modellbegründung für gewählte Haltung",
    "argument_original": "Meinung",
    "reasoning": "Begründung für die Meinung",
    "person": "Person",
    "party": "Partei",
    "canton": "Kanton",
    "similarity": "Sem. Ähnlichkeit",
    "model_name": "LLM",
}


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Fail early, with the missing names, before any job starts."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_field(df: DataFrame, struct: str, field: str) -> None:
    """Fail when a struct column lacks a field."""
    require_columns(df, [struct])
    kind = df.schema[struct].dataType
    if not isinstance(kind, T.StructType) or field not in kind.fieldNames():
        raise ValueError(f"field {field!r} not found in {struct!r}")


def first_record(df: DataFrame, language: str, fields: Sequence[str], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Chosen fields of the first record in a language, per key.

    ``order`` must tell the records of a key apart. Only key and order are grouped, with map-side minima,
    so a key with very many records is never gathered; the texts are then picked by a join with one row
    per key.
    """
    require_columns(df, [*fields, *key, *order, "language"])
    rows = df.where(F.col("language") == language)
    first = rows.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    picked = first.select(*key, *[F.col(f"_first.{o}").alias(o) for o in order])
    return rows.join(picked, [*key, *order], "left_semi").select(*key, *fields)


def rename_project(df: DataFrame, names: Mapping[str, str] = DISPLAY_NAMES) -> DataFrame:
    """Rename and reorder to display columns; a missing column is an error."""
    require_columns(df, list(names))
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def chosen_names(chosen: Sequence[str], names: Mapping[str, str] = DISPLAY_NAMES) -> dict[str, str]:
    """The renaming restricted to the chosen display columns."""
    return {old: new for old, new in names.items() if new in chosen}


def dynamic_project(df: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """The chosen columns, or all of them if none is chosen."""
    return df.select(*[F.col(f"`{c}`") for c in chosen]) if chosen else df


def confidence_head(df: DataFrame, confidence: str, key: Sequence[str], minimum: float = 0.5, n: int | None = None) -> DataFrame:
    """Rows above a confidence: all, or the first ``n`` by key."""
    rows = df.where(F.col(confidence) > minimum)
    return rows if n is None else top_k(rows, [F.col(c) for c in key], n)


def training_filter(df: DataFrame, stance: str, quality: str, minimum: float = 0.5) -> DataFrame:
    """Rows with a clear stance (-1 or 1) and good quality."""
    return df.where(F.col(stance).isin(-1, 1) & (F.col(quality) > minimum))


def with_input_text(df: DataFrame, topic: str, argument: str, stance: str, separator: str = SEPARATOR) -> DataFrame:
    """Classifier input and 0/1 label; rows without a usable text go."""
    text = F.concat(F.col(topic), F.lit(separator), F.col(argument))
    rows = df.withColumns({"input_text": text, "label": F.when(F.col(stance) == -1, 0).otherwise(1)})
    return rows.where(F.length("input_text") > 1)


def split_by_set(df: DataFrame, column: str = "set", parts: Sequence[str] = ("train", "test", "dev")) -> dict[str, DataFrame]:
    """One frame per part; on a table partitioned by ``column`` each reads only its own files."""
    return {p: df.where(F.col(column) == p) for p in parts}


def strip_time_zone(df: DataFrame) -> DataFrame:
    """Make every timestamp zone-free, keeping the wall clock of the session's zone."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in zoned}) if zoned else df


def transpose_record(df: DataFrame, key: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """One row per record and field, values as text."""
    names = list(fields) if fields is not None else [c for c in df.columns if c not in key]
    texts = df.select(*key, *[F.col(n).cast("string").alias(n) for n in names])
    return texts.unpivot(list(key), names, "field", "value")


def zip_explode(df: DataFrame, key: Sequence[str], arrays: Mapping[str, str]) -> DataFrame:
    """Parallel arrays to rows: ``arrays`` maps output column to array column."""
    zipped = F.arrays_zip(*[F.col(a).alias(n) for n, a in arrays.items()])
    return df.select(*key, F.posexplode(zipped).alias("pos", "_row")).select(*key, "pos", "_row.*")


def unique_field_values(df: DataFrame, struct: str, field: str) -> DataFrame:
    """Sorted distinct values of a metadata field, the word for any source in front."""
    require_field(df, struct, field)
    values = df.select(F.col(f"{struct}.{field}").alias("value")).distinct().withColumn("is_value", F.lit(1))
    first = df.sparkSession.range(1).select(F.lit(ANY_SOURCE).alias("value"), F.lit(0).alias("is_value"))
    return first.unionByName(values).orderBy("is_value", "value")


def append_results(results: DataFrame, batch: DataFrame) -> DataFrame:
    """Result table followed by a further batch of rows; columns are matched by name."""
    return results.unionByName(batch)


def stamp(df: DataFrame, **values: object) -> DataFrame:
    """Constant columns with run metadata; a list of values becomes one text joined by ``"; "``."""
    flat = {k: "; ".join(map(str, v)) if isinstance(v, (list, tuple)) else v for k, v in values.items()}
    return df.withColumns({k: F.lit(v) for k, v in flat.items()})


def label_union(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Labels seen in either column. Each row is deduplicated before it moves."""
    return df.select(F.explode(F.array(y_true, y_pred)).alias("label")).distinct()


def progress_summary(
    hits: DataFrame,
    group: Sequence[str],
    total: Column,
    hit: Column,
    neutral: Column,
    exhausted: Column,
    cancelled: bool = False,
    neutral_limit: int = 3,
) -> DataFrame:
    """Totals and state of each topic's search.

    States in order of precedence: exhausted, cancelled, neutral_limit, no_match, complete, running.
    """
    sums = hits.groupBy(*group).agg(
        F.coalesce(F.max(total), F.lit(0)).alias("num_matches"),
        F.count(total).cast("int").alias("analyzed"),
        F.coalesce(F.sum(hit.cast("int")), F.lit(0)).cast("int").alias("arguments"),
        F.coalesce(F.sum(neutral.cast("int")), F.lit(0)).cast("int").alias("neutrals"),
        F.coalesce(F.bool_or(exhausted), F.lit(False)).alias("_exhausted"),
    )
    state = (
        F.when(F.col("_exhausted"), "exhausted")
        .when(F.lit(cancelled), "cancelled")
        .when(F.col("neutrals") >= neutral_limit, "neutral_limit")
        .when(F.col("num_matches") == 0, "no_match")
        .when(F.col("num_matches") == F.col("analyzed"), "complete")
        .otherwise("running")
    )
    message = F.format_string("%s: %d matches, %d analyzed, %d arguments", state, "num_matches", "analyzed", "arguments")
    return sums.withColumns({"state": state, "message": message}).drop("_exhausted")


def all_topics_exhausted(topics: DataFrame, group: Sequence[str], neutrals: str, limit: int = 3) -> DataFrame:
    """Per request: whether every topic has reached the neutral limit."""
    return topics.groupBy(*group).agg(F.bool_and(F.col(neutrals) == limit).alias("all_exhausted"))


def empty_results(df: DataFrame) -> DataFrame:
    """A result table without rows but with the columns and types of ``df``."""
    return df.sparkSession.createDataFrame([], df.schema)


def has_rows(df: DataFrame) -> bool:
    """Whether there is any row. Nothing is consumed: the frame can still be read from its start."""
    return not df.isEmpty()
