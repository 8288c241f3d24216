"""Early stop across micro-batches: a topic is given up after its third neutral row, whenever it came.

The state, one neutral count per group, is a Parquet table with a version per micro-batch. Version ``n``
is derived from version ``n - 1`` and the rows written by batch ``n``, so a repeated batch overwrites
its own files with the same content. No group is ever held by one task: within a batch the stop is the
same top-k search as in :func:`disputatio.operators.ranking.early_stop`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from disputatio.operators.ranking import top_k_per_group


def _joined(rows: DataFrame, side: DataFrame, group: Sequence[str]) -> DataFrame:
    """Left join on the group, where null is a group, too."""
    named = side.withColumnsRenamed({g: f"_{g}" for g in group})
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
    return rows.join(named, same, "left").drop(*[f"_{g}" for g in group])


def stop_with_state(
    rows: DataFrame, counts: DataFrame | None, group: Sequence[str], order: Sequence[Column], neutral: Column, limit: int
) -> DataFrame:
    """Rows of one batch up to the neutral row that reaches the limit, given the counts so far."""
    if counts is not None:
        rows = _joined(rows, counts.withColumnRenamed("neutrals", "_before"), group)
        rows = rows.withColumn("_before", F.coalesce("_before", F.lit(0))).where(F.col("_before") < limit)
    else:
        rows = rows.withColumn("_before", F.lit(0))
    at = F.struct(*order).alias("_at")
    neutrals = rows.where(neutral).select(*group, "_before", at)
    first = top_k_per_group(neutrals, group, [F.col("_at")], limit, "_nth")
    cut = first.where(F.col("_nth") == limit - 1 - F.col("_before")).select(*group, F.col("_at").alias("_cut"))
    joined = _joined(rows, cut, group)
    return joined.where(F.col("_cut").isNull() | (F.struct(*order) <= F.col("_cut"))).drop("_cut", "_before")


def start_early_stop(
    rows: DataFrame,
    *,
    group: Sequence[str],
    order: Sequence[Column],
    neutral: Column,
    out: str,
    state: str,
    checkpoint: str,
    limit: int = 3,
    available_now: bool = True,
) -> StreamingQuery:
    """Run the stop over a stream. Results land in ``out/batch=<n>``, counts in ``state/version=<n>``."""

    def process(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{state}/version={number - 1}") if number > 0 else None
        kept = stop_with_state(batch, before, group, order, neutral, limit)
        kept.write.mode("overwrite").parquet(f"{out}/batch={number}")
        written = spark.read.schema(batch.schema).parquet(f"{out}/batch={number}")
        counts = written.where(neutral).groupBy(*group).agg(F.count(F.lit(1)).cast("int").alias("neutrals"))
        if before is not None:
            counts = counts.unionByName(before).groupBy(*group).agg(F.sum("neutrals").cast("int").alias("neutrals"))
        counts.write.mode("overwrite").parquet(f"{state}/version={number}")

    writer = rows.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
