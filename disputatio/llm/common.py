"""Shared pieces of the training-data operators: word pattern, cut lineage, counts, numbering."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder all executors share.

    That is ``spark.checkpoint.dir``; only where it is unset (as in tests) the warehouse stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


# Folders written inside the innermost scratch blocks that are open, the outermost block first.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is saved inside the block when it ends, except frames saved with ``keep``.

    No frame that leaves the block may depend on others than those kept.
    """
    token = _SCRATCH.set((*_SCRATCH.get(), []))
    try:
        yield
    finally:
        written = _SCRATCH.get()[-1]
        _SCRATCH.reset(token)
        for folder in written:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write the frame to the shared folder and read it back: a lost executor costs a read, not a recomputation.

    Inside a ``scratch`` block the folder goes with the block; with ``keep`` it stays as long as the block around that one.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    blocks = _SCRATCH.get()[:-1] if keep else _SCRATCH.get()
    if blocks:
        blocks[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    # Shuffle files of jobs that nothing refers to any more go with the driver's next collection; have it now.
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def identified(df: DataFrame, name: str) -> DataFrame:
    """Add a column that tells every row apart and is the same in every plan: the file a row stands in and its place there.

    A frame that is not read from files is written first.
    """
    try:
        return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))
    except AnalysisException:
        return identified(saved(df, name), name)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = 8_000_000) -> DataFrame:
    """Mark a saved table for broadcast if its rows, counted now, stay below a bound in bytes; else Spark shuffles it."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """Partitions that hold about ``per_partition`` rows each."""
    return max(1, -(-rows // per_partition))


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number all rows from 0 in the given order without gathering them in one task.

    Rows are dealt by range, numbered inside their range, and shifted by the rows of the ranges before.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), name)
    before = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_inside", inside).join(before.drop("_n"), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")
