"""Exact threshold join of vectors by cosine, pruned with a ball partition that is saved with the collection.

Every vector lies in the ball of its nearest pivot, at an angle to it. Angles between unit vectors obey the triangle
inequality: a topic at angle ``f`` from a pivot can only reach vectors whose angle to that pivot lies within the threshold's
angle of ``f``. So most balls are never read for a topic, and of the others only a ring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputatio.session import checkpointed, measure

# Angles are taken from rounded cosines; rings are wider by this.
SLACK = 1e-6
# Rows of a slice: a ring of a ball.
SLICE_ROWS = 20_000
# The join: vectors of a block, topics that meet it in one task, numbers in either; topics that are worth a task, and those compared at once.
BLOCK_ROWS = 60_000
TOPIC_ROWS = 40_000
BLOCK_CELLS = 4_000_000
FEW_TOPICS = 2_000
TOPICS_AT_ONCE = 128
PIVOT_CELLS = 4_000_000

INDEXED = "corpus_id long, ball int, slice long, angle double, vector array<double>"


@dataclass
class BallIndex:
    """``vectors``: every vector with ball, slice and angle, laid out by them; ``slices``: rows and least and largest angle of each
    slice; ``pivots``: the centres, a bounded number."""

    vectors: DataFrame
    slices: DataFrame
    pivots: np.ndarray


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of a list column, scaled to length 1; zero vectors stay zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles to all pivots. A zero vector has cosine 0 with everything, which is a right angle."""
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has only finite components; the others match nothing."""
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(F.coalesce(fine, F.lit(False)))


def choose_pivots(corpus: DataFrame, count: int | None = None) -> np.ndarray:
    """Pivots: the vectors of smallest hash, about the square root of their number, at most ``PIVOT_CELLS`` numbers in all.

    The choice only decides how much is pruned. Equal pivots are one.
    """
    shape = measure(corpus, F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d"))
    if not shape.n:
        return np.zeros((0, 1))
    count = count or math.ceil(math.sqrt(shape.n))
    count = max(1, min(count, PIVOT_CELLS // shape.d))
    chosen = corpus.select(F.xxhash64("vector").alias("h"), F.col("vector").cast("array<double>").alias("vector")).orderBy("h").limit(count).toArrow()
    return np.unique(unit_rows(chosen.column("vector").combine_chunks()), axis=0)


def _assigned(corpus: DataFrame, pivots: np.ndarray) -> DataFrame:
    sent = corpus.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = unit_rows(batch.column(1))
                near = angles(rows, sent.value)
                ball = near.argmin(axis=1)
                vectors = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), rows.ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ball.astype(np.int32)), pa.array(near[np.arange(len(rows)), ball]), vectors], ["corpus_id", "ball", "angle", "vector"]
                )

    rows = usable(corpus, "vector").select(F.col("corpus_id").cast("long"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(assign, "corpus_id long, ball int, angle double, vector array<double>")


def build_ball_index(corpus: DataFrame, path: str, pivots: np.ndarray | None = None, slice_rows: int = SLICE_ROWS) -> BallIndex:
    """Write the index of ``corpus(corpus_id, vector)`` below ``path``.

    Balls of more than ``slice_rows`` vectors are cut into rings of about that many, at angles from approximate percentiles, so a
    crowded ball is many tasks. Equal vectors, which no ring parts, are dealt by a hash of their id.
    """
    spark = corpus.sparkSession
    corpus = usable(corpus, "vector")
    pivots = choose_pivots(corpus) if pivots is None else pivots
    spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "ball int, vector array<double>").coalesce(1).write.parquet(f"{path}/pivots")
    if not len(pivots):
        spark.createDataFrame([], INDEXED).write.parquet(f"{path}/vectors")
    else:
        _assigned(corpus, pivots).write.parquet(f"{path}/assigned")
        placed = spark.read.parquet(f"{path}/assigned")
        per_ball = placed.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("angle", [i / 64 for i in range(1, 64)], 1000).alias("cuts"))
        per_ball = per_ball.withColumn("rings", F.least(F.ceil(F.col("n") / slice_rows), F.lit(64)))
        # Of 63 marks every (64 / rings)-th one is a border.
        borders = F.when(F.col("rings") > 1, F.transform(F.sequence(F.lit(1), F.col("rings") - 1), lambda i: F.get("cuts", F.floor(i * 64 / F.col("rings")).cast("int") - 1)))
        per_ball = per_ball.select("ball", F.coalesce(borders, F.array().cast("array<double>")).alias("borders"), F.ceil(F.col("n") / 64 / slice_rows).alias("deals"))
        ring = F.size(F.filter("borders", lambda b: b < F.col("angle")))
        dealt = F.pmod(F.xxhash64("corpus_id"), F.greatest("deals", F.lit(1)))
        sliced = placed.join(F.broadcast(per_ball), "ball").withColumn("slice", ring * F.greatest("deals", F.lit(1)) + dealt)
        sliced.select("corpus_id", "ball", F.col("slice").cast("long").alias("slice"), "angle", "vector").repartition("ball", "slice").sortWithinPartitions("ball", "slice").write.parquet(f"{path}/vectors")
    vectors = spark.read.schema(INDEXED).parquet(f"{path}/vectors")
    rings = vectors.groupBy("ball", "slice").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    rings.write.parquet(f"{path}/slices")
    return open_ball_index(spark, path)


def open_ball_index(spark: SparkSession, path: str) -> BallIndex:
    """The index as it was written."""
    found = spark.read.parquet(f"{path}/pivots").orderBy("ball").toArrow()
    pivots = np.array(found.column("vector").to_pylist(), dtype=np.float64) if found.num_rows else np.zeros((0, 1))
    return BallIndex(spark.read.schema(INDEXED).parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/slices"), pivots)


def _reach(threshold: float) -> float:
    return math.acos(max(-1.0, min(1.0, threshold - 1e-9))) + SLACK


def _slice_ranges(index: BallIndex) -> pa.Table:
    """``ball, slice, n, low, high`` in order; their number is that of the balls and of ``SLICE_ROWS`` vectors each."""
    return index.slices.orderBy("ball", "slice").toArrow().combine_chunks()


def _meets(to: np.ndarray, ranges: tuple[np.ndarray, np.ndarray, np.ndarray], reach: float) -> np.ndarray:
    """Per topic and slice whether the ring can hold a vector within reach; ``to`` has the angles to all pivots."""
    ball, low, high = ranges
    near = to[:, ball]
    return (near - reach <= high) & (near + reach >= low)


def _asked(topics: DataFrame) -> DataFrame:
    rows = usable(topics, "vector").where(F.col("topic_id").isNotNull())
    return rows.select(F.col("topic_id").cast("long"), F.col("vector").cast("array<double>").alias("vector"))


def reachable(topics: DataFrame, index: BallIndex, threshold: float) -> DataFrame:
    """``topic_id, ball, slice`` for the slices that the triangle inequality leaves to each topic."""
    reach, found = _reach(threshold), _slice_ranges(index)
    ranges = tuple(found.column(c).to_numpy() for c in ("ball", "low", "high"))
    sent = topics.sparkSession.sparkContext.broadcast((index.pivots, ranges, found.column("slice").to_numpy()))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, ranges, slices = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                i, s = np.nonzero(_meets(angles(unit_rows(part.column(1)), pivots), ranges, reach))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(ranges[0][s].astype(np.int32)), pa.array(slices[s])], ["topic_id", "ball", "slice"])

    return _asked(topics).mapInArrow(near, "topic_id long, ball int, slice long")


def _dealt(topics: DataFrame, index: BallIndex, ranges: tuple[np.ndarray, np.ndarray, np.ndarray], block: np.ndarray, reach: float) -> DataFrame:
    """``id, home, vector, blocks``: each topic once, with its nearest ball and the blocks that hold a slice it can reach."""
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    sent = topics.sparkSession.sparkContext.broadcast((index.pivots, ranges, starts))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, ranges, starts = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                to = angles(unit_rows(part.column(1)), pivots)
                i, b = np.nonzero(np.logical_or.reduceat(_meets(to, ranges, reach), starts, axis=1))
                offsets = np.searchsorted(i, np.arange(part.num_rows + 1)).astype(np.int32)
                blocks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(b.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(to.argmin(axis=1).astype(np.int32)), part.column(1), blocks], ["id", "home", "vector", "blocks"])

    return _asked(topics).mapInArrow(near, "id long, home int, vector array<double>, blocks array<long>")


def _near_pairs(asked: pa.Table, held: pa.Table, pivots: np.ndarray, threshold: float, strict: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a topic and a vector that reach the threshold, some topics of one ball at a time."""
    reach = _reach(threshold)
    held, asked = held.sort_by("ball").combine_chunks(), asked.sort_by("ball").combine_chunks()
    balls, place = np.unique(held.column("ball").to_numpy(), return_inverse=True)
    angle, others = held.column("angle").to_numpy(), held.column("id").combine_chunks()
    b = unit_rows(held.column("vector").combine_chunks())
    for at in range(0, asked.num_rows, TOPICS_AT_ONCE):
        part = asked.slice(at, TOPICS_AT_ONCE).combine_chunks()
        a = unit_rows(part.column("vector").combine_chunks())
        to = angles(a, pivots[balls])
        ring = np.flatnonzero((angle >= (to.min(axis=0) - reach)[place]) & (angle <= (to.max(axis=0) + reach)[place]))
        sims = a @ (b if len(ring) == len(b) else b[ring]).T
        i, j = np.nonzero(sims >= threshold - 1e-9)
        exact = np.round(sims[i, j], 10)
        fit = exact > threshold if strict else exact >= threshold
        i, j, exact = i[fit], ring[j[fit]], exact[fit]
        yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks().take(pa.array(i)), others.take(pa.array(j)), pa.array(exact)], ["topic_id", "corpus_id", "similarity"])


def vector_threshold_join(
    topics: DataFrame, index: BallIndex, threshold: float, strict: bool = False, topic_rows: int = TOPIC_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All pairs of ``topics(topic_id, vector)`` and indexed vectors whose cosine reaches the threshold: ``topic_id, corpus_id, similarity``.

    The result is exact (cosines are compared at ten decimals, as in the other searches); no pair below the threshold becomes a
    row. Slices that follow each other are put in blocks of about ``block_rows`` vectors. A topic goes once to each block that holds a
    slice it can reach, however many of them; a block with more than ``topic_rows`` topics is worked on in several tasks, in which topics of
    one ball are compared with the rings that they can reach. Where nothing can be pruned, a vector is therefore sent once per block and per
    part of the topics, not once per ball. Long vectors make smaller blocks. Only the pivots and the ranges of the slices are broadcast.

    Topic ids are unique and not null. Vectors that are null, empty or hold null or non-finite components match nothing; a zero vector has
    cosine 0 with everything.
    """
    schema = "topic_id long, corpus_id long, similarity double"
    spark = topics.sparkSession
    if not len(index.pivots):
        return spark.createDataFrame([], schema)
    most = max(1, BLOCK_CELLS // index.pivots.shape[1])
    topic_rows, block_rows = min(topic_rows, most), min(block_rows, most)
    found = _slice_ranges(index)
    ranges = tuple(found.column(c).to_numpy() for c in ("ball", "low", "high"))
    n = found.column("n").to_numpy()
    block = np.unique((np.cumsum(n) - n) // block_rows, return_inverse=True)[1]
    dealt = _dealt(topics, index, ranges, block, _reach(threshold)).drop("vector")
    left = checkpointed(dealt.join(_asked(topics).withColumnRenamed("topic_id", "id"), "id"), "topics")
    left = left.select("id", F.col("home").alias("ball"), F.lit(None).cast("double").alias("angle"), "vector", F.explode("blocks").alias("block"))
    crowd = left.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    # Few blocks are cut finer, as far as that makes work for idle cores.
    spare = max(1, spark.sparkContext.defaultParallelism // (int(block.max()) + 1))
    crowd = F.broadcast(crowd.select("block", F.greatest(F.ceil(F.col("n") / topic_rows), F.least(F.lit(spare), F.ceil(F.col("n") / FEW_TOPICS))).alias("parts")))
    left = left.join(crowd, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    placed = spark.createDataFrame(pa.table({"ball": found.column("ball"), "slice": found.column("slice"), "block": block.astype(np.int64)}))
    right = index.vectors.join(F.broadcast(placed), ["ball", "slice"]).select(F.col("corpus_id").alias("id"), "ball", "angle", "vector", "block")
    right = right.join(crowd, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    sent = spark.sparkContext.broadcast(index.pivots)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        is_topic = rows.column("is_topic")
        asked, held = rows.filter(is_topic), rows.filter(pc.invert(is_topic))
        if asked.num_rows and held.num_rows:
            yield from _near_pairs(asked, held, sent.value, threshold, strict)

    both = left.withColumn("is_topic", F.lit(True)).unionByName(right.withColumn("is_topic", F.lit(False)))
    return both.groupBy("block", "part").applyInArrow(compare, schema)
