"""Near duplicates among embeddings by comparison of tiles in the order of the principal component."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputatio.llm.common import partitions_for, saved
from disputatio.llm.components import connected_components
from disputatio.llm.vectors import matrix, usable

# Slack of a bound over a sum that is rounded.
SLACK = 1e-9
# Parts into which the members of one component are dealt where they look something up.
PARTS = 16


def principal_axes(vectors: DataFrame, column: str, width: int) -> np.ndarray:
    """Axes of the second moments of the unit vectors, largest first; ``width`` squared numbers reach the driver."""

    def moments(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch[column], width)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            total += x.T @ x
        yield pd.DataFrame({"cell": np.arange(width * width), "total": total.ravel()})

    cells = vectors.select(column).mapInPandas(moments, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    second = np.zeros(width * width)
    for row in cells.toLocalIterator():
        second[row.cell] = row.total
    values, axes = np.linalg.eigh(second.reshape(width, width))
    return np.ascontiguousarray(axes[:, np.argsort(-values, kind="stable")])


def linked_pairs(left: np.ndarray, right: np.ndarray, threshold: float, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two matrices of rotated unit vectors whose product may reach the threshold.

    Products grow by ``step`` leading dimensions at a time. What the other dimensions can add is at most the
    product of the norms of both rests; pairs that cannot reach the threshold any more are left out.
    """
    width = left.shape[1]
    rest = lambda x, d: np.linalg.norm(x[:, d:], axis=1)
    d = min(step, width)
    part = left[:, :d] @ right[:, :d].T
    i, j = np.nonzero(part + np.outer(rest(left, d), rest(right, d)) >= threshold - SLACK)
    part = part[i, j]
    while d < width and len(i):
        e = min(d + step, width)
        part = part + np.einsum("ij,ij->i", left[i, d:e], right[j, d:e])
        d = e
        open_ = part + rest(left, d)[i] * rest(right, d)[j] >= threshold - SLACK
        i, j, part = i[open_], j[open_], part[open_]
    return i, j


def embedding_duplicates(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, tile_rows: int = 2048
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of one label are linked when the cosine, in double precision, reaches the threshold. Null vectors,
    zero vectors, those with null or non-finite components and those without a label are linked with nothing;
    vectors of different lengths are never linked. Links run between rows: rows that share an id count as one vector each
    and are not linked by their id. Rows without an id count as links and join components, but name none: a component
    of such rows alone has a null ``component_id``, and its rows are all kept.

    Equal vectors become one class first. Classes are dealt by range over label and first principal coordinate
    into tiles of about ``tile_rows``; a label of any size spreads over many tiles. Unit vectors of a link lie
    within ``sqrt(2 - 2 * threshold)`` of each other, so only tiles whose ranges come that close meet. A pair
    of tiles is one bounded group; it returns counts and a star per linked set, never pairs.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    fit = usable(F.col("vector")) & F.col("label").isNotNull()
    good = rows.where(fit).where(F.exists("vector", lambda x: x != 0))
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    # A class has a number of its own, fixed by being written; ids may be null or stand at several vectors.
    classes = saved(classes.select("*", F.size("vector").alias("length"), F.monotonically_increasing_id().alias("rep")), "classes")
    count, width = classes.agg(F.count(F.lit(1)), F.max("length")).first()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    axes = principal_axes(classes, "vector", width)
    first = axes[:, 0]

    def project(batches):
        for batch in batches:
            x = matrix(batch["vector"], width)
            batch["at"] = (x @ first) / np.linalg.norm(x, axis=1)
            yield batch

    spread = classes.mapInPandas(project, ", ".join(f"{n} {t}" for n, t in classes.dtypes) + ", at double")
    tiles = saved(spread.repartitionByRange(partitions_for(spark, count, tile_rows), "label", "length", "at", "rep").withColumn("tile", F.spark_partition_id()), "tiles")
    ranges = tiles.groupBy("label", "length", "tile").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    a, b = ranges.alias("a"), ranges.alias("b")
    near = (F.col("a.tile") <= F.col("b.tile")) & (F.col("b.low") - F.col("a.high") <= reach) & (F.col("a.low") - F.col("b.high") <= reach)
    meetings = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.length") == F.col("b.length")) & near).select(
        F.col("a.label").alias("label"), F.col("a.length").alias("length"), F.col("a.tile").alias("one"), F.col("b.tile").alias("two")
    )
    sides = meetings.select("*", F.explode(F.array_distinct(F.array("one", "two"))).alias("tile"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep", ignore_index=True)
        raw = matrix(group["vector"], int(group["length"].iloc[0]))
        norms = np.linalg.norm(raw, axis=1)
        turned = (np.pad(raw, ((0, 0), (0, width - raw.shape[1]))) @ axes) / norms[:, None]
        tile, rep, copies = (group[c].to_numpy() for c in ("tile", "rep", "copies"))
        one, two = int(group["one"].iloc[0]), int(group["two"].iloc[0])
        left, right = np.flatnonzero(tile == one), np.flatnonzero(tile == two)
        counts, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for at in range(0, len(left), 512):
            block = left[at : at + 512]
            i, j = linked_pairs(turned[block], turned[right], threshold)
            i, j = block[i], right[j]
            # Both products of a pair inside one tile appear; those of two tiles count for both ends.
            keep = i != j
            i, j = i[keep], j[keep]
            exact = np.einsum("ij,ij->i", raw[i], raw[j]) / (norms[i] * norms[j]) if len(i) else np.zeros(0)
            i, j = i[exact >= threshold], j[exact >= threshold]
            np.add.at(counts, i, copies[j])
            if one != two:
                np.add.at(counts, j, copies[i])
            for x, y in zip(i.tolist(), j.tolist()):
                p, q = top(x), top(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
        out = np.flatnonzero(counts)
        return pd.DataFrame({"rep": rep[out], "n": counts[out], "hub": rep[[top(x) for x in out.tolist()]] if len(out) else rep[:0]})

    data = sides.join(tiles.select("label", "length", "tile", "rep", "copies", "vector"), ["label", "length", "tile"])
    found = saved(data.groupBy("label", "length", "one", "two").applyInPandas(compare, "rep long, n long, hub long"), "found")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    sets = connected_components(found, "rep", "hub").withColumnRenamed("node", "rep")
    of_class = saved(
        classes.join(links, "rep", "left").join(sets, "rep", "left").select(
            "label", "vector", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"), F.pmod(F.hash("rep"), F.lit(PARTS)).alias("part"),
        ),
        "of_class",
    )
    # The smallest id of a component is looked up from parts, so that a component of very many classes is no single join key.
    smallest = of_class.groupBy("component").agg(F.min("low").alias("component_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    joined = rows.join(of_class.join(smallest, ["component", "part"]).select("label", "vector", "n_links", "component_id"), ["label", "vector"], "left")
    # Rows of no class stand alone.
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
