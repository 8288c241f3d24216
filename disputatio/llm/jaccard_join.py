"""Exact Jaccard join on word n-grams by partitions of the token universe."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from disputatio.llm.common import broadcast_if_small, saved
from disputatio.llm.components import connected_components
from disputatio.llm.group_links import BITS, linked_sets, may_link
from disputatio.llm.shingles import Words, bitmap, fingerprint, mixed, slices

# Upper over lower edge of a size band.
BAND = 1.6
# Segments over the least number that the pigeonhole needs: for all sets, then for those that are still open.
COARSE, FINE = 1.15, 4.0


class Bands:
    """Bands of set sizes and what the threshold allows in each."""

    def __init__(self, percent: int):
        self.percent = percent
        self.smallest = next(n for n in range(1, 10_000) if self.most(n, self.largest(n)))
        self._known: dict[int, list[tuple[int, int, int]]] = {}

    def largest(self, n: int) -> int:
        """Size of the largest set that a set of n tokens can link with."""
        return 100 * n // self.percent

    def most(self, n: int, p: int) -> int:
        """Tokens in which linked sets of n and p tokens differ at most."""
        return (100 - self.percent) * (n + p) // (100 + self.percent)

    def edges(self, band: int) -> tuple[int, int]:
        low = self.smallest
        for _ in range(band):
            low = int(low * BAND) + 1
        return low, int(low * BAND)

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """Bands in which a set of n tokens is looked up: band, largest difference there, and that of the band.

        A pair meets in the band of its smaller set; a set also belongs to the band below if a set there may be its partner.
        """
        if n not in self._known:
            self._known[n] = self._of(n)
        return self._known[n]

    def _of(self, n: int) -> list[tuple[int, int, int]]:
        if n < self.smallest:
            return []
        band, (low, high) = 0, self.edges(0)
        while n > high:
            band += 1
            low, high = self.edges(band)
        out = [(band, self.most(n, self.largest(n)), self.most(high, self.largest(high)))]
        if band and self.largest(low - 1) >= n:
            out.append((band - 1, self.most(n, low - 1), self.most(low - 1, self.largest(low - 1))))
        return out


def segments(tokens: np.ndarray, band: int, most: int, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segment of each token, the sum of the scrambled tokens of every segment, and the segments that hold some."""
    count = int(np.ceil((most + 1) * spread)) + 1
    place = (mixed(tokens, 5) % np.uint64(count)).astype(np.int64)
    sums = np.zeros(count, np.uint64)
    np.add.at(sums, place, mixed(tokens, 6))
    return place, sums, np.flatnonzero(np.bincount(place, minlength=count))


def key_of(sums: np.ndarray, place: np.ndarray, band: int) -> np.ndarray:
    """One key for the content of a segment in its place."""
    return mixed(sums + mixed(place.astype(np.uint64), 7 + band), 8).view(np.int64)


def segment_rows(tokens: np.ndarray, bands: Bands, spread: float, only: list[int] | None = None):
    """Per band: keys of the segments that hold tokens, and how many of them may be shared before the set stays open."""
    for band, own, most in bands.of(len(tokens)):
        if only is None or band in only:
            _, sums, used = segments(tokens, band, most, spread)
            yield band, key_of(sums[used], used, band), len(used) - (own + 1)


def still_open(rows: DataFrame) -> DataFrame:
    """``item, band`` of the sets that may have a partner in the band.

    If more segments than the largest allowed difference are held by no other set, every other set differs by more
    than that: there is no partner. ``room`` is the number of segments beyond that; a set with more shared segments stays open.
    Below 0, a partner need not share a segment: the set stays open without asking.
    Equal rows, from copies of one text, count once.
    """
    by_key = Window.partitionBy("key")
    shared = rows.withColumn("low", F.min("item").over(by_key)).withColumn("high", F.max("item").over(by_key)).where("low < high OR room < 0")
    counts = shared.groupBy("item", "band").agg(F.count_distinct(F.when(F.col("low") < F.col("high"), F.col("key"))).alias("n"), F.max("room").alias("room"))
    return counts.where("n > room").select("item", "band")


def allocate(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of the keys at which candidates meet, with what each set asks for there.

    ``rows`` has a row per segment (``kind`` 0) and one per segment without one of its tokens (``kind`` 1). A set buys
    ``need`` units, the largest allowed difference and one: one unit for looking up a segment as it is, a second one
    for looking it up with one token more or less. A segment with a single token (``lone``) sells one unit only: without that
    token it is empty and has no key. If no lookup finds a set, the two differ by at least as many
    tokens as units were bought. Units are bought by cost, which is the number of rows a lookup meets, and no more than needed; those that meet none are free.
    ``ask`` is 0, 1 or 2 units for the row's segment; ``rank`` orders sets by the units they got for free. A set that a hash
    left with fewer units on sale than it needs (all its tokens in very few segments) meets, under a key of its own, every set that sizes and bitmaps allow.
    """
    by_key = Window.partitionBy("key")
    counted = rows.withColumn("n0", F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(by_key)).withColumn(
        "n1", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(by_key)
    )
    counted = saved(counted.where((F.col("kind") == 0) | (F.col("n0") > 0)), "counted")
    plain = F.col("kind") == 0
    costs = counted.groupBy("item", "band", "seg").agg(
        F.max("need").alias("need"),
        F.sum(F.when(plain, F.col("n0") - 1).otherwise(0)).alias("same"),
        F.sum(F.when(plain, F.col("n1")).otherwise(F.col("n0"))).alias("near"),
        F.max("lone").alias("lone"),
    )
    # A unit is one number, so that units sort by cost, then segment, then first and second; a segment's second unit never comes before
    # its first. Without a second one it is null.
    unit = lambda cost, second: F.shiftleft(cost.cast("long"), 32) + F.col("seg").cast("long") * 2 + second
    costs = costs.withColumn("same_unit", unit(F.col("same"), 0)).withColumn("near_unit", F.when(~F.col("lone"), unit(F.greatest("same", "near"), 1)))
    units = F.sort_array(F.filter(F.flatten(F.collect_list(F.array("same_unit", "near_unit"))), lambda x: x.isNotNull()))
    priced = costs.groupBy("item", "band").agg(F.max("need").alias("need"), units.alias("units"))
    # Just the units needed are bought, the cheapest; of equal cost those of the first segments, which sets alike choose alike.
    paid = F.filter(F.slice("units", 1, F.col("need")), lambda x: x >= 2**32)
    priced = priced.select("item", "band", paid.alias("paid"), F.size(F.filter("units", lambda x: x < 2**32)).alias("rank"), (F.size("units") < F.col("need")).alias("short"))
    # A set that gets all its units for free has no partner and takes no further part.
    priced = saved(priced.where("size(paid) > 0 OR short"), "priced")
    place = lambda x: F.shiftright(x.bitwiseAND(2**32 - 1), 1).cast("int")
    second = F.transform(F.filter("paid", lambda x: x % 2 == 1), place)
    single = F.array_except(F.transform(F.filter("paid", lambda x: x % 2 == 0), place), second)
    asks = F.concat(F.transform(single, lambda x: F.struct(x.alias("seg"), F.lit(1).alias("ask"))), F.transform(second, lambda x: F.struct(x.alias("seg"), F.lit(2).alias("ask"))))
    asks = saved(priced.select("item", "band", F.inline(asks)), "asks")
    seen = counted.join(asks, ["item", "band", "seg"]).where((F.col("n0") + F.col("n1") > 1) & ((F.col("kind") == 0) | (F.col("ask") == 2)))
    wanted = saved(seen.select("key").distinct(), "wanted")
    members = counted.join(wanted, "key").join(priced.drop("paid", "short"), ["item", "band"]).join(asks, ["item", "band", "seg"], "left")
    members = members.select("key", "item", "kind", F.coalesce("ask", F.lit(0)).alias("ask"), "rank")
    short = priced.where("short").select("item").distinct()
    if short.isEmpty():
        return members
    traits = sets.select("item", "n", *BITS)
    x, y = broadcast_if_small(saved(traits.join(short, "item"), "short"), 60).alias("x"), traits.alias("y")
    met = y.join(x, may_link("x", "y", percent)).select(F.xxhash64("x.item", F.lit("short")).alias("key"), F.col("y.item").alias("item"))
    return members.union(met.select("key", "item", F.lit(0).alias("kind"), F.lit(1).alias("ask"), F.lit(0).alias("rank")))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    A document's set holds its distinct shingles of ``size`` words (lower case for A-Z); with fewer words all of them
    are one shingle. Two documents link when ``100 * intersection >= percent * union``; ``component_id`` is the smallest
    id reachable by links, the own one included. Null texts and those without words have an empty set and no link. Rows that share
    an id are one document in the component. A null id has no component. Shingles are 64-bit hashes.

    Equal sets become one class by a 128-bit fingerprint. Sets of one size band are cut into segments by a hash of the
    token; two sets that differ in at most H tokens agree in one of H + 1 segments. Sets whose segments nobody shares are
    out after one shuffle, with coarse segments; what is left is cut finer and the rest allocated by cost, with one token more
    or less where that is cheaper, and verified on the tokens. See ``still_open``, ``allocate`` and ``linked_sets``.
    """
    bands = Bands(percent)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for _, part in slices(batch.column(1)):
                words = Words(part)
                for i in range(len(part)):
                    tokens = words.shingles(i, size)
                    out.append((len(tokens), fingerprint(tokens, 9), fingerprint(tokens, 10)))
            n, one, two = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["doc_id", "n", "print", "second"])

    sets_of = saved(rows.mapInArrow(describe, "doc_id long, n long, print long, second long"), "prints")
    classes = saved(sets_of.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "print", "second").agg(F.min("doc_id").alias("item")), "classes")

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch.column(0)):
                words, seen, out = Words(part), set(), []
                for i in range(len(part)):
                    tokens = words.shingles(i, size)
                    name = fingerprint(tokens, 9)
                    if name not in seen:
                        seen.add(name)
                        out += [(keys, name, band, room) for band, keys, room in segment_rows(tokens, bands, COARSE)]
                yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        counts = [len(x[0]) for x in out]
        keys = np.concatenate([x[0] for x in out]) if out else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), *(pa.array(np.repeat(np.array([x[c] for x in out], np.int64), counts).astype(t)) for c, t in ((1, np.int64), (2, np.int32), (3, np.int32)))],
            ["key", "item", "band", "room"],
        )

    row = "key long, item long, band int, room int"
    open_ = still_open(rows.select("text").where("text IS NOT NULL").mapInArrow(coarse, row))
    # The coarse round knows sets by half of their fingerprint; every class with that half goes on.
    by_print = open_.groupBy(F.col("item").alias("print")).agg(F.collect_set("band").alias("bands"))
    by_item = classes.join(by_print, "print").groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("bands"))).alias("bands"))
    by_item = saved(by_item, "open")
    wanted = broadcast_if_small(by_item.withColumnRenamed("item", "doc_id"), 40)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column(1)):
                words, out = Words(part), []
                for i in range(len(part)):
                    tokens = words.shingles(i, size)
                    out.append((len(tokens), fingerprint(tokens, 9), fingerprint(tokens, 10), tokens.tobytes(), *bitmap(tokens)))
                columns = list(zip(*out))
                kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
                kept = batch.slice(start, len(part))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["item", "bands", "n", "print", "second", "tokens", *BITS])

    schema = "item long, bands array<int>, n long, print long, second long, tokens binary, " + ", ".join(f"{w} long" for w in BITS)
    gathered = rows.join(wanted, "doc_id").select("doc_id", "text", "bands").mapInArrow(gather, schema)
    # An id may stand at several texts; the class tells which of them it means, and equal rows count once.
    sets = saved(gathered.join(classes, ["n", "print", "second", "item"], "left_semi").dropDuplicates(["item", "n", "print", "second"]), "sets")
    # Different classes may then share an id; such classes link as they are one document, all by one row per class.
    sets = saved(sets.withColumn("id", F.col("item")).withColumn("item", F.xxhash64("n", "print", "second")), "named")

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, some, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
                tokens = np.frombuffer(blob, np.uint64)
                yield _batch([(keys, item, band, room) for band, keys, room in segment_rows(tokens, bands, FINE, some)])

    left = saved(still_open(sets.select("item", "bands", "tokens").mapInArrow(fine, row)).groupBy("item").agg(F.collect_set("band").alias("bands")), "left")

    def neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "item", "band", "seg", "kind", "need", "lone"]
        for batch in batches:
            for item, some, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
                tokens = np.frombuffer(blob, np.uint64)
                for band, own, most in bands.of(len(tokens)):
                    if band not in some:
                        continue
                    place, sums, used = segments(tokens, band, most, FINE)
                    without = key_of(sums[place] - mixed(tokens, 6), place, band)
                    single = np.bincount(place, minlength=len(sums)) == 1
                    alone = single[place]
                    keys = np.concatenate([key_of(sums[used], used, band), without[~alone]])
                    seg = np.concatenate([used, place[~alone]])
                    kind = np.repeat([0, 1], [len(used), len(keys) - len(used)])
                    fill = lambda v, t: np.full(len(keys), v, t)
                    columns = (keys, fill(item, np.int64), fill(band, np.int32), seg.astype(np.int32), kind.astype(np.int32), fill(own + 1, np.int32), single[seg])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    last = sets.drop("bands").join(left, "item")
    near = last.select("item", "bands", "tokens").mapInArrow(neighbourhoods, "key long, item long, band int, seg int, kind int, need int, lone boolean")
    members = saved(allocate(near, sets, percent), "members")
    same = (F.col("x.kind") == 0) & (F.col("y.kind") == 0) & (F.greatest("x.ask", "y.ask") >= 1)
    off_by_one = (F.col("x.kind") != F.col("y.kind")) & (F.greatest("x.ask", "y.ask") == 2)
    parts = linked_sets(members, sets, percent, same | off_by_one, (F.col("kind") == 0) & (F.col("ask") >= 1), F.col("kind") == 0)

    names = sets.select("item", "id")
    through = parts.join(names.toDF("node", "id"), "node").select("id", F.col("component").alias("set"))
    return components_of_documents(sets_of, classes, through)


def components_of_documents(sets_of: DataFrame, classes: DataFrame, through: DataFrame) -> DataFrame:
    """Carry the components of sets over to documents; an id that stands at several sets joins them."""
    lowest = through.groupBy("set").agg(F.min("id").alias("low"))
    stars = through.join(lowest, "set").select("id", "low")
    members = sets_of.where("n > 0 AND doc_id IS NOT NULL").join(classes, ["n", "print", "second"]).select(F.col("doc_id").alias("id"), F.col("item").alias("low"))
    several = saved(members.groupBy("id").agg(F.min("low").alias("low"), F.max("low").alias("high")).where("low < high"), "several")
    # Ids with several sets are rare and join their classes; all others hang on their class alone.
    if several.isEmpty():
        parts = stars.toDF("node", "component")
    else:
        parts = saved(connected_components(stars.union(members.join(several.select("id"), "id", "left_semi")), "id", "low"), "final")
    found = members.withColumnRenamed("low", "item").join(parts.toDF("item", "component"), "item", "left")
    found = found.groupBy("id").agg(F.min(F.coalesce("component", "item")).alias("component_id")).withColumnRenamed("id", "doc_id")
    out = sets_of.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
