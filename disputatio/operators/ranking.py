"""Top-k per group and early stop, both safe when one group holds a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disputatio.session import checkpointed

SALTS = 64


def _wide(df: DataFrame) -> bool:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) > SALTS


def top_k_per_group(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    two_level: bool | None = None,
) -> DataFrame:
    """Best ``k`` rows of each group with their zero-based rank.

    ``row_number() <= k`` lets Spark keep only k rows of a group per task before the shuffle (up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``). On a wide cluster one group could still bring
    ``k`` rows from every task to a single reducer, so the tasks are first merged in ``SALTS`` strands.
    """
    if two_level is None:
        two_level = _wide(df)
    if two_level:
        strands = df.withColumn("_strand", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        first = Window.partitionBy(*group, "_strand").orderBy(*order)
        df = strands.withColumn("_first", F.row_number().over(first)).where(F.col("_first") <= k)
        df = df.drop("_strand", "_first")
    last = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(last)).where(F.col(rank) <= k)
    return ranked.withColumn(rank, F.col(rank) - 1)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Best ``k`` rows of a whole frame: every task keeps k rows, which are merged."""
    return df.orderBy(*order).limit(k)


def early_stop(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    neutral: Column,
    limit: int = 3,
    consecutive: bool = False,
    two_level: bool | None = None,
) -> DataFrame:
    """Keep a group's rows up to and including its ``limit``-th neutral row.

    The place of that row is a top-``limit`` search over the neutral rows alone, which are thinned out
    before they move. No task ever has to hold or sort a whole group. ``consecutive`` counts only
    neutral rows in an unbroken run; it needs each group in one window and is meant for short groups.
    """
    if consecutive:
        rows = df.withColumn("_neutral", neutral)
        seq = Window.partitionBy(*group).orderBy(*order)
        rows = rows.withColumn("_run", F.sum(F.when(F.col("_neutral"), 0).otherwise(1)).over(seq))
        in_run = Window.partitionBy(*group, "_run").orderBy(*order)
        rows = rows.withColumn("_len", F.sum(F.col("_neutral").cast("int")).over(in_run))
        before = seq.rowsBetween(Window.unboundedPreceding, -1)
        done = F.coalesce(F.max("_len").over(before), F.lit(0)) >= limit
        return rows.withColumn("_done", done).where(~F.col("_done")).drop("_neutral", "_run", "_len", "_done")
    key = F.struct(*order).alias("_at")
    neutrals = df.where(neutral).select(*group, key)
    last = top_k_per_group(neutrals, group, [F.col("_at")], limit, "_nth", two_level)
    cut = last.where(F.col("_nth") == limit - 1).select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_at").alias("_cut"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]
    on = same[0]
    for cond in same[1:]:
        on = on & cond
    joined = df.join(cut, on, "left")
    kept = joined.where(F.col("_cut").isNull() | (F.struct(*order) <= F.col("_cut")))
    return kept.drop("_cut", *[f"_{g}" for g in group])


def running_counts(df: DataFrame, group: Sequence[str], part: Sequence[str], order: Sequence[Column], hit: Column) -> DataFrame:
    """Rows seen and hits found so far within a group, which is ordered by the columns ``part`` and then by ``order``.

    Rows are counted per part, the counts are summed up over the parts before, and only the rows of one part stand in
    one window (a topic sentence has at most k of them, a request any number). The rows are written first, as they are read twice.
    """
    rows = checkpointed(df.withColumn("_hit", F.coalesce(hit.cast("int"), F.lit(0))), "counted")
    per_part = rows.groupBy(*group, *part).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_hit").alias("_hits"))
    earlier = Window.partitionBy(*group).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, *part]
    before = per_part.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_rows", "_hits")])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.join(before, same).withColumns(
        {
            "analyzed_so_far": F.col("_rows") + F.count(F.lit(1)).over(so_far),
            "arguments_so_far": F.col("_hits") + F.sum("_hit").over(so_far),
        }
    )
    return counted.drop("_hit", "_rows", "_hits", *[f"_{k}" for k in keys])
