"""Mixing sources to target weights that change over the training time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disputatio.llm.common import numbered, saved, word_count

Knots = Sequence[tuple[float, float]]

# Weight over training time from 0 to 1, straight between the knots; the areas are 5, 2 and 1.
CURRICULUM: tuple[Knots, ...] = (
    ((0.0, 8.0), (1.0, 2.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.0), (0.5, 1.0), (1.0, 2.0)),
)


def area(knots: Knots) -> float:
    """Integral of a weight schedule."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def time_of(share: Column, knots: Knots) -> Column:
    """Training time at which a schedule has handed out a share of its demand: the inverse of its integral."""
    wanted, done = share * F.lit(area(knots)), 0.0
    out = None
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        rest = wanted - F.lit(done)
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * F.lit(2 * slope), F.lit(0.0)))
        here = F.when(rest <= 0, F.lit(float(t0))).otherwise(F.least(F.lit(float(t1)), F.lit(float(t0)) + rest * F.lit(2.0) / (F.lit(w0) + root)))
        done += (t1 - t0) * (w0 + w1) / 2
        out = here if out is None else F.when(wanted <= F.lit(done - (t1 - t0) * (w0 + w1) / 2), out).otherwise(here)
    return out


def source_targets(sizes: DataFrame, schedules: Sequence[Knots], budget: tuple[int, int], most: int) -> DataFrame:
    """Per source: ``_null``, ``_name``, ``_kind`` (its schedule), ``source_size`` and ``target``.

    The budget is a fraction of all sizes. A target stops at ``most`` times its source's size; what is cut off is
    shared anew by weight until no target is above. Each round sums over the sources and hands two numbers on.
    """
    totals = sizes.groupBy("_null", "_name").agg(F.sum("size").alias("source_size"))
    ranked = numbered(totals, [F.col("_null"), F.col("_name")], "_rank")
    weights = [F.when(F.col("_kind") == k, F.lit(area(s))) for k, s in enumerate(schedules)]
    sources = saved(ranked.withColumn("_kind", F.col("_rank") % len(schedules)).withColumn("_weight", F.coalesce(*weights)), "sources")
    part, whole = budget
    all_words = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    capped = -1
    while True:
        full = F.col("_weight") * F.lit(level) > F.col("source_size") * most
        row = sources.agg(
            F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("words"),
            F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))).alias("weight"),
            F.sum(full.cast("int")).alias("n"),
        ).first()
        if not row.n and capped == 0 or row.n == capped or not row.weight:
            break
        capped = row.n
        level = (part * all_words - whole * most * row.words) / (whole * row.weight)
    target = F.least(F.col("_weight") * F.lit(float(level)), (F.col("source_size") * most).cast("double"))
    return sources.select("_null", "_name", "_kind", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    schedules: Sequence[Knots] = CURRICULUM,
    budget: tuple[int, int] = (3, 2),
    most: int = 2,
    carry: Sequence[str] = (),
    whole_documents: bool = False,
) -> DataFrame:
    """Every document with the words the mix takes from it and the training times at which it takes them.

    Sources get the schedules in turn, by code point of their name, null last. A source's documents form one
    endless stream in the order of a hash of their id; the mix takes as many words of it as the integral of the
    source's schedule grants. The demand up to a document's start, inverted, is its training time in 0 to 1.
    Columns: ``doc_id, size, source_size, target, taken, positions`` (one time for each taking) and those of
    ``carry``. With ``whole_documents`` the stream is cut at the document boundary nearest to the target instead
    of inside a document; then ``taken`` is a multiple of ``size``.

    A running sum over a source goes by slices of the hash: slice totals are summed per source first, then rows
    inside each slice, so a source with a third of all rows spreads over all tasks. Slices hold about 20,000 rows.

    Null text has no words and is never taken. A null source is a source. Repeated rows are separate documents.
    An empty table gives an empty table. Extra columns are dropped unless carried.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(source), F.lit(""))
    sizes = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).isNull().alias("_null"),
        key.alias("_name"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("_order"),
        word_count(F.col(text)).alias("size"),
        F.struct(*[F.col(c) for c in carry]).alias("_carry") if carry else F.lit(None).cast("boolean").alias("_carry"),
    )
    sizes = saved(sizes, "sizes")
    targets = source_targets(sizes, schedules, budget, most)
    rows = sizes.count()
    digits = 1
    while 16**digits * 20_000 < rows:
        digits += 1
    sizes = sizes.withColumn("_slice", F.substring("_order", 1, digits))
    slices = sizes.groupBy("_null", "_name", "_slice").agg(F.sum("size").alias("_words"))
    by_source = Window.partitionBy("_null", "_name").orderBy("_slice")
    slices = slices.withColumn("_before", F.sum("_words").over(by_source) - F.col("_words")).drop("_words")
    slices = slices.join(targets, ["_null", "_name"])
    inside = Window.partitionBy("_null", "_name", "_slice").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("_inside", F.sum("size").over(inside) - F.col("size")).join(slices, ["_null", "_name", "_slice"])

    demand = F.floor("target").cast("long")
    takings = []
    for turn in range(most):
        start = F.lit(turn) * F.col("source_size") + F.col("_before") + F.col("_inside")
        if whole_documents:
            words = F.when(start * 2 + F.col("size") <= demand * 2, F.col("size")).otherwise(F.lit(0))
        else:
            words = F.greatest(F.lit(0), F.least(F.col("size"), demand - start))
        share = start.cast("double") / F.greatest(demand, F.lit(1)).cast("double")
        at = F.coalesce(*[F.when(F.col("_kind") == k, time_of(share, s)) for k, s in enumerate(schedules)])
        takings.append(F.struct(words.cast("long").alias("words"), at.alias("at")))
    return (
        placed.withColumn("_takings", F.filter(F.array(*takings), lambda x: x["words"] > 0))
        .withColumn("taken", F.aggregate("_takings", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
        .select("doc_id", "size", "source_size", "target", "taken", F.col("_takings.at").alias("positions"), *([F.col(f"_carry.{c}").alias(f"_carried_{c}") for c in carry]))
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Rows range-sorted by the first time at which the mix takes them; those never taken come last."""
    first = F.get("positions", F.lit(0))
    return mixed.withColumn("position", first).orderBy(F.col("position").asc_nulls_last(), "doc_id")
