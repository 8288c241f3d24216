"""Writing fields, results and reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputatio.operators.reshape import require_columns, stamp


def write_fields(df: DataFrame, key: str, fields: Sequence[str], root: str) -> None:
    """One text file folder per record and field: ``root/<key>=…/field=…/``."""
    require_columns(df, [key, *fields])
    long = df.select(key, *[F.col(f).cast("string") for f in fields]).unpivot([key], list(fields), "field", "value")
    long.select(key, "field", F.coalesce("value", F.lit("")).alias("value")).write.mode("overwrite").partitionBy(
        key, "field"
    ).text(root)


def result_path(root: str, *, business_id: str | None = None, file: str | None = None, model: str | None = None, at: datetime | None = None) -> str:
    """Folder of a result table: a time stamp, then business, file and model in the name."""
    moment = (at or datetime.now()).strftime("%Y-%m-%d_%H-%M-%S")
    parts = ["argument_analysis"]
    if business_id is not None:
        parts.append(f"business_id_{business_id}")
    parts += [p for p in (file, model) if p]
    return f"{root.rstrip('/')}/{moment}/{'__'.join(parts).replace('/', '_')}"


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Write a result table as Parquet or CSV (with header, quotes doubled) and return its path."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True, escape='"', quoteAll=True)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown result format {fmt!r}; choose 'parquet' or 'csv'")
    return path


def save_results(df: DataFrame, root: str, threshold: float, sources: Sequence[str], at: datetime | None = None) -> str:
    """Stamp the run's threshold and sources on a result table and write it under a time stamp."""
    moment = (at or datetime.now()).strftime("%Y-%m-%dT%H-%M-%S")
    stamped = stamp(df, similarity_threshold=threshold, selected_sources=list(sources))
    return write_results(stamped, f"{root.rstrip('/')}/saved_results_{moment}")
