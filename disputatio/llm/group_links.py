"""Exact links among sets of tokens that share a key, without forming all pairs of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disputatio.llm.common import saved
from disputatio.llm.components import connected_components

BITS = [f"w{i}" for i in range(4)]
# Smallest keys that an item carries to tell at which of their keys a pair is formed.
LOWEST = 16


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and bitmaps leave room for a Jaccard similarity of ``percent`` or more."""
    n, p = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in BITS), F.lit(0))
    return (F.least(n, p) * 100 >= F.greatest(n, p) * percent) & (differ * (100 + percent) <= (n + p) * (100 - percent))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of items whose sets have at least ``percent`` per cent of their union in common."""
    tokens = sets.select("item", "tokens")
    both = pairs.join(tokens.toDF("a", "left_tokens"), "a").join(tokens.toDF("b", "right_tokens"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(u) + len(v) - len(np.union1d(u, v))
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "left_tokens", "right_tokens").mapInArrow(compare, "a long, b long")


def _smallest(rest: DataFrame, which: Column, name: str) -> DataFrame:
    """``item`` and the smallest of its keys among those rows."""
    place = F.row_number().over(Window.partitionBy("item").orderBy("key"))
    keys = rest.where(which).select("item", "key").distinct().withColumn("_at", place).where(F.col("_at") <= LOWEST)
    return keys.groupBy("item").agg(F.collect_list("key").alias(name))


def meetings(rest: DataFrame, percent: int, allowed: Column, sure: Column, plain: Column) -> DataFrame:
    """The pairs ``a, b`` of items that share a key, are allowed and lie in different parts, as far as sizes and bitmaps let them link.

    Sets that are much alike share most of their keys. Each item carries the smallest of its ``sure`` keys and of its ``plain`` ones. A pair
    is formed at the smallest key of these that is sure on a side and sure or plain on the other. A pair without such a key
    is formed at every key where it is allowed, so none is lost.
    """
    rest = rest.join(_smallest(rest, sure, "sure"), "item", "left").join(_smallest(rest, plain, "plain"), "item", "left")
    a, b = rest.alias("x"), rest.alias("y")
    apart = (F.col("x.item") < F.col("y.item")) & (F.col("x.part") != F.col("y.part")) & allowed & may_link("x", "y", percent)
    common = [F.array_min(F.array_intersect(f"x.{c}", f"y.{d}")) for c, d in (("sure", "sure"), ("sure", "plain"), ("plain", "sure"))]
    once = F.coalesce(F.least(*common) == F.col("x.key"), F.lit(True))
    return a.join(b, (F.col("x.key") == F.col("y.key")) & apart & once).select(F.col("x.item").alias("a"), F.col("y.item").alias("b"))


def linked_sets(members: DataFrame, sets: DataFrame, percent: int, allowed: Column, sure: Column, plain: Column) -> DataFrame:
    """``node, component`` for the items that link, directly or through others.

    ``members`` has ``key``, ``item``, ``rank`` and what ``allowed`` reads of two members ``x`` and ``y`` of one key;
    ``sets`` has ``item, n, tokens`` (sorted 64-bit hashes) and the bitmap. Only pairs of one key that are allowed can be links. A ``sure`` member of a key
    and another that is sure or ``plain`` are always allowed.

    First every member meets the member of lowest rank of its key; the links found join most copies of one text into
    one component. Then members of one key that still lie in different components meet each other. As a link inside a
    component changes nothing, none is lost; a pair with many keys is formed at one of them (``meetings``). Sizes and bitmaps are compared inside the join, so what leaves it are
    pairs that nearly always link.
    """
    traits = sets.select("item", "n", *BITS)
    x = members.join(traits, "item")
    heads = x.groupBy("key").agg(F.min(F.struct("rank", "item", "n", *BITS)).alias("h")).select("key", "h.*")
    a, b = x.alias("x"), heads.alias("y")
    near = (F.col("x.item") != F.col("y.item")) & may_link("x", "y", percent)
    order = [F.least("x.item", "y.item").alias("a"), F.greatest("x.item", "y.item").alias("b")]
    first = saved(a.join(b, (F.col("x.key") == F.col("y.key")) & near).select(*order).distinct(), "first")
    links = saved(verified(first, sets, percent), "links")
    parts = saved(connected_components(links, "a", "b"), "parts")
    known = x.join(parts, F.col("item") == F.col("node"), "left").withColumn("part", F.coalesce("component", "item")).drop("node", "component")
    split = known.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    rest = saved(known.join(split, "key"), "rest")
    pairs = meetings(rest, percent, allowed, sure, plain).distinct()
    more = saved(verified(pairs.join(first, ["a", "b"], "left_anti"), sets, percent), "more")
    return parts if more.isEmpty() else connected_components(links.union(more), "a", "b")
