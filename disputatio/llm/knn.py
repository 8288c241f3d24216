"""Exact top-k search by inner product as a Voronoi join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disputatio.llm.common import identified, saved
from disputatio.llm.vectors import matrix, usable

# Relative room for rounding in distances that decide whether a row is left out.
ROOM = 1e-6


def _steps(column, width: int) -> np.ndarray:
    return np.floor(256 * matrix(column, width))


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    """Add the coordinate that gives all rows one norm, so that a nearer row has the larger product with a query."""
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0.0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0.0))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer products; doubles are exact as long as no sum can pass 2**53."""
    largest = np.abs(q).max(initial=0.0) * np.abs(x).max(initial=0.0) * q.shape[1]
    if largest < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def nearest(
    df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = 64, query_block: int = 1024, data_block: int = 32768
) -> DataFrame:
    """For every query its k rows of highest score: ``query_id, rank, vec_id, score``, ties to the smaller id.

    Components become ``floor(256 * x)``; the score is the integer inner product. Every query row has its own list, from
    all rows but itself: rows that share an id are separate queries and separate candidates, so another row of the
    query's id can stand in its list, and two lists of one id are two sets of rows. Rows without an id and vectors that
    are null or hold null or non-finite components take no part; short vectors count as if filled with zeros. Fewer rows
    than k give fewer ranks.

    Rows are lifted to one common norm, where the nearest row is the one of highest product, and belong to the
    cell of their nearest pivot. ``pivots`` rows of smallest hash of their place, without copies, are the pivots. From each cell's
    radius and its k + 1 smallest distances follows how far a query's k-th neighbour can be at most, and from that
    how far from its pivot a row has to lie to matter to a group of query cells; only such rows are sent there.
    Groups meet the data in blocks of at most ``query_block`` by ``data_block`` rows or so, and each block keeps k
    rows per query, so no task grows with the data.
    """
    spark = df.sparkSession
    rows = identified(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("asks")), "place")
    rows = rows.withColumn("row", F.xxhash64("place.file", "place.row")).drop("place").where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not count:
        return spark.createDataFrame([], schema)

    def norms(batches):
        for batch in batches:
            x = _steps(batch["vector"], width)
            yield pd.DataFrame({"most": [(x * x).sum(1).max(initial=0.0)]})

    most = rows.select("vector").mapInPandas(norms, "most double").agg(F.max("most")).first()[0]
    sample = rows.select("vector", "row").orderBy("row").limit(4 * pivots)
    points = np.unique(_lift(_steps(sample.select("vector").toPandas()["vector"], width), most), axis=0)[:pivots]

    def place(batches):
        for batch in batches:
            x = _steps(batch["vector"], width)
            far = _distances(_lift(x, most), points)
            asked = _distances(np.column_stack([x, np.zeros(len(x))]), points)
            yield pd.DataFrame({
                "vec_id": batch["vec_id"], "row": batch["row"], "vector": batch["vector"], "asks": batch["asks"],
                "cell": far.argmin(1), "far": far.min(1), "query_cell": asked.argmin(1), "query_far": asked.min(1),
            })

    placed = saved(rows.mapInPandas(place, "vec_id long, row long, vector array<double>, asks boolean, cell int, far double, query_cell int, query_far double"), "cells")
    asks = F.coalesce("asks", F.lit(False))
    by_cell = Window.partitionBy("cell").orderBy("far")
    closest = placed.select("cell", "far").withColumn("n", F.row_number().over(by_cell)).where(F.col("n") <= k + 1)
    gaps = _distances(points, points)
    # Bounded by the parameters: pivots times k + 1 distances, and a radius per query cell.
    near = closest.select("cell", "far").toPandas()
    radii = placed.where(asks).groupBy("query_cell").agg(F.max("query_far").alias("radius"), F.count(F.lit(1)).alias("n")).toPandas()
    cells, reach = near["cell"].to_numpy(), near["far"].to_numpy()
    pad = ROOM * (1.0 + np.sqrt(most))
    plan, group, filled = [], 0, 0
    limits: dict[int, np.ndarray] = {}
    spots = radii.set_index("query_cell")
    here = sorted(spots.index.tolist(), key=lambda c: (gaps[0, c], c))
    for i in here:
        radius, n = float(spots.loc[i, "radius"]), int(spots.loc[i, "n"])
        at_most = np.sort(radius + gaps[i, cells] + reach)
        bound = at_most[min(k, len(at_most) - 1)] if len(at_most) > k else np.inf
        least = gaps[i] - radius - bound - pad
        if filled and filled + n > query_block:
            group, filled = group + 1, 0
        filled += n
        limits[group] = np.minimum(limits[group], least) if group in limits else least
        plan.append((int(i), group))
    if not plan:
        return spark.createDataFrame([], schema)
    groups = spark.createDataFrame(plan, "query_cell int, grp int")
    reaching = spark.createDataFrame([(g, c, float(v)) for g, x in limits.items() for c, v in enumerate(x)], "grp int, cell int, least double")
    splits = -(-count // data_block)
    sizes = placed.where(asks).join(groups, "query_cell").groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks"))
    queries = placed.where(asks).join(groups, "query_cell").join(sizes, "grp").select(
        "grp", F.pmod(F.col("row"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), "vec_id", "row", "vector"
    )
    data = placed.join(reaching, "cell").where("far >= least").join(sizes, "grp").select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.hash("row"), F.lit(splits)).cast("int").alias("split"), "vec_id", "row", "vector"
    )

    def best(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(there):
            there = there.sort_values("data_id", ignore_index=True)
            x, ids, places = _steps(there["data_vector"], width), there["data_id"].to_numpy(), there["data_row"].to_numpy()
            for at in range(0, len(asked), 128):
                some = asked.iloc[at : at + 128]
                scores = _products(_steps(some["vector"], width), x)
                for q, place, line in zip(some["vec_id"].to_numpy(), some["row"].to_numpy(), scores):
                    open_ = np.flatnonzero(places != place)
                    line = line[open_]
                    if len(line) > k:
                        last = np.partition(line, len(line) - k)[len(line) - k]
                        keep = np.flatnonzero(line >= last)
                        keep = keep[np.lexsort((ids[open_[keep]], -line[keep]))][:k]
                    else:
                        keep = np.arange(len(line))
                    out.append((np.full(len(keep), q), np.full(len(keep), place), ids[open_[keep]], line[keep]))
        if not out:
            return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}, dtype="int64")
        q, r, v, s = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query_id": q, "query_row": r, "vec_id": v, "score": s})

    key = ["grp", "block", "split"]
    # Both sides come from one table; new names for one of them keep their columns apart.
    data = data.toDF("grp", "block", "split", "data_id", "data_row", "data_vector")
    local = queries.groupBy(*key).cogroup(data.groupBy(*key)).applyInPandas(best, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
