"""Passages that repeat across documents, found by MinHash banding of short paragraphs and read word by word."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disputatio.llm.common import broadcast_if_small, identified, saved, scratch
from disputatio.llm.group_links import BITS, linked_sets
from disputatio.llm.shingles import Words, mixed, rolled, slices

BLANKS = " \t\n\x0b\x0c\r"
BLANK = np.zeros(256, bool)
BLANK[list(BLANKS.encode())] = True
# Words between two cuts of the finer paragraphs at most, and words of a finer paragraph at least.
FINE, LEAST = 16, 16
# Words between two cuts of the coarser paragraphs at most.
COARSE = 64
# Unlike words that may stand between two stretches of one passage.
EDIT = 4
_POWER = 0xD6E8FEB86659FD93


def tuned_bands(similarity: float, rows: int, recall: float) -> int:
    """Fewest bands of ``rows`` minima each that catch a pair of that similarity with at least that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every window of ``width`` (a power of two) values."""
    reach = 1
    while reach < width:
        values = best(values[:-reach], values[reach:]) if len(values) > reach else values[:0]
        reach *= 2
    return values


class Paragraphs(Words):
    """Words of a part of a text column with the places where their own hashes cut them.

    A cut is a pair of words whose hash is the least of some ``width`` neighbouring pairs of its row. So the same words are cut
    alike wherever they stand, no paragraph between two cuts has more than ``width`` words, and there is a cut in any ``width`` pairs.
    """

    def __init__(self, texts: pa.Array):
        super().__init__(texts)
        self.row = np.searchsorted(self.first, np.arange(len(self.hash)), "right") - 1
        self.pair = mixed(self.hash * np.uint64(3) + np.concatenate([self.hash[:1], self.hash[:-1]]), 14) | np.uint64(1)
        self.pair[self.first[:-1][self.first[:-1] < len(self.pair)]] = np.uint64(2**64 - 1)
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(self.hash), np.uint64(_POWER))]))
        self.inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(self.hash), np.uint64(pow(_POWER, -1, 2**64)))]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hash * powers[:-1], dtype=np.uint64)])

    def cuts(self, width: int) -> np.ndarray:
        least = _sliding(self.pair, width, np.minimum)
        least = np.where(self.row[: len(least)] == self.row[len(self.row) - len(least) :], least, np.uint64(0))
        around = np.zeros(width - 1, np.uint64)
        return np.flatnonzero(_sliding(np.concatenate([around, least, around]), width, np.maximum)[: len(self.pair)] == self.pair) if len(least) else np.zeros(0, np.int64)

    def spans(self, width: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, end and name of the paragraphs from every cut to the first one ``least`` or more words on, in the same row.

        Where words repeat over and over, so that neighbours are equal, one of them is given for every ``width`` words.
        """
        at = self.cuts(width)
        following = np.searchsorted(at, at + least)
        at, until = at[following < len(at)], at[following[following < len(at)]]
        inside = self.row[at] == self.row[until]
        at, until = at[inside], until[inside]
        whole = (self.sums[until] - self.sums[at]) * self.inverse[at]
        name = mixed(whole + mixed((until - at).astype(np.uint64), 11), 12)
        if len(at):
            again = (name[1:] == name[:-1]) & (self.row[at[1:]] == self.row[at[:-1]]) & (at[1:] // width == at[:-1] // width)
            keep = np.concatenate([[True], ~again])
            at, until, name = at[keep], until[keep], name[keep]
        return at, until, name.view(np.int64)


def _chained(rows: DataFrame, keys: list[str], since: str, until: str, apart: int, shift: Column | None = None) -> DataFrame:
    """Number the chains of spans of equal keys: a span begins a new one if it lies ``apart`` or more words behind all before it."""
    by = Window.partitionBy(*keys).orderBy(since, until)
    far = F.col(since) - F.max(until).over(by.rowsBetween(Window.unboundedPreceding, -1)) >= apart
    if shift is not None:
        far = far | (F.abs(shift - F.lag(shift).over(by)) > EDIT)
    return rows.withColumn("_new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("_chain", F.sum("_new").over(by)).drop("_new")


def repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, least_words: int = 50, band_rows: int = 1, recall: float = 0.995
) -> DataFrame:
    """One row per document: ``doc_id, n_words, removed_words, spans``.

    ``spans`` lists ``start:end`` (code points, end exclusive) of passages of more than ``least_words`` words (A-Z in either case)
    that stand in a document of smaller id, too (null is smallest; for equal ids the text's hash decides). The words of a passage
    were found in one and the same other document in the same order, but for up to four unlike words between two stretches and
    for unlike words of coarser paragraphs that are linked. What repeats inside one document only, or piecemeal in several others, is left alone.

    Paragraphs are cut by their own words, at two scales. Equal ones of the finer scale meet by name; a passage of 51 words
    contains one of them wherever it lies. Coarser ones meet in bands of MinHash minima, as many as the recall asks for, and are linked if
    their sets of ``size``-word shingles have a Jaccard similarity of ``percent`` or more, without forming all pairs of a band
    (``linked_sets``). Each class (component) points to its first place. Paragraphs in one document that follow
    each other in the document pointed to are a run; its ends are extended word by word.

    Equal texts are one text before anything meets: all but the first are cut whole if they are longer than ``least_words``. Null and empty texts have no words
    and no spans. Equal rows are one document; rows of one id with other texts are documents of their own.
    """
    with scratch(docs.sparkSession):
        return saved(_passages(docs, doc_id, text, size, percent, least_words, band_rows, recall), "passages", keep=True)


def _passages(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, least_words: int, band_rows: int, recall: float) -> DataFrame:
    bands = tuned_bands(percent / 100, band_rows, recall)
    rows = identified(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "_row").withColumn("print", F.xxhash64("text"))
    sized = rows.select("doc_id", "print", "text").mapInArrow(_measured, "doc_id long, print long, missing boolean, n_words long, begin long, stop long")
    every = saved(sized.distinct(), "every")
    first = rows.where("text IS NOT NULL").groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "_row")).alias("first"))
    several = broadcast_if_small(saved(first.where("n > 1").select("print", "first"), "several"), 200)
    texts = rows.where("text IS NOT NULL").join(several, "print", "left").where("first IS NULL OR _row = first._row").select("doc_id", "print", "text")

    def named(width: int, least: int):
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, part in slices(batch.column(2)):
                    p = Paragraphs(part)
                    since, until, name = p.spans(width, least)
                    row = p.row[since]
                    own = batch.slice(at, len(part)).select(["doc_id", "print"]).take(pa.array(row))
                    places = [pa.array(x.astype(np.int32)) for x in (since - p.first[row], until - p.first[row])]
                    yield pa.RecordBatch.from_arrays([*own.columns, *places, pa.array(name)], ["doc_id", "print", "since", "until", "item"])

        return texts.mapInArrow(cut, "doc_id long, print long, since int, until int, item long")

    fine, coarse = named(FINE, LEAST), named(COARSE, size)
    shared = fine.groupBy("item").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low < high").select("item")
    shared = broadcast_if_small(saved(shared, "shared"), 16)

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch.column(0)):
                p, names, keys = Paragraphs(part), [], []
                since, until, name = p.spans(COARSE, size)
                chosen = np.unique(name, return_index=True)[1]
                if len(chosen):
                    counts = until[chosen] - since[chosen] - size + 1
                    edge = np.cumsum(counts) - counts
                    flat = rolled(p.hash, size)[np.repeat(since[chosen] - edge, counts) + np.arange(counts.sum())]
                    for band in range(bands):
                        key = np.full(len(chosen), np.uint64(band))
                        for r in range(band_rows):
                            key = mixed(key + np.minimum.reduceat(mixed(flat, 20 + band * band_rows + r), edge), 13)
                        names.append(name[chosen])
                        keys.append(key.view(np.int64))
                empty = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys or [empty])), pa.array(np.concatenate(names or [empty]))], ["key", "item"])

    proposed = texts.select("text").mapInArrow(minima, "key long, item long")
    # Keys that hold unlike paragraphs are few; paragraphs are dealt by key once, as partial sums.
    keys = proposed.groupBy("key").agg(F.min("item").alias("low"), F.max("item").alias("high")).where("low < high").select("key")
    keys = broadcast_if_small(saved(keys, "keys"), 16)
    members = saved(proposed.join(keys, "key").distinct().withColumn("rank", F.lit(0)), "members")
    wanted = broadcast_if_small(saved(members.select("item").distinct(), "wanted"), 16)
    # Tokens of proposed paragraphs are read where each stands first.
    places = coarse.join(wanted, "item").groupBy("item").agg(F.min(F.struct("print", "since", "until")).alias("at")).select("item", "at.*")
    places = saved(places.groupBy("print").agg(F.collect_list(F.struct("item", "since", "until")).alias("wanted")), "places")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(0)):
                p, wanted = Words(part), batch.column(1).slice(at, len(part))
                found = wanted.flatten()
                head = np.repeat(p.first[:-1], np.diff(wanted.offsets.to_numpy()))
                since, until = (head + found.field(name).to_numpy() for name in ("since", "until"))
                yield pa.RecordBatch.from_arrays([found.field("item"), *_token_sets(p.hash, since, until, size)], ["item", "n", "tokens", *BITS])

    sets = texts.join(broadcast_if_small(places, 100), "print").select("text", "wanted")
    sets = saved(sets.mapInArrow(gather, "item long, n long, tokens binary, " + ", ".join(f"{w} long" for w in BITS)), "sets")
    parts = broadcast_if_small(saved(linked_sets(members, sets, percent, F.lit(True), F.lit(True), F.lit(False)).withColumnRenamed("node", "item"), "parts"), 24)

    again = fine.join(shared, "item").withColumn("class", F.struct(F.lit(0).alias("scale"), "item")).drop("item")
    again = again.unionByName(coarse.join(parts, "item").withColumn("class", F.struct(F.lit(1).alias("scale"), F.col("component").alias("item"))).drop("item", "component"))
    again = saved(again, "again")
    heads = again.groupBy("class").agg(F.min(F.struct("doc_id", "print", "since", "until")).alias("head"))
    heads = broadcast_if_small(saved(heads, "heads"), 64)
    pointed = again.join(heads, "class").where("print <> head.print").select(
        F.col("class.scale").alias("scale"), "print", "since", "until", F.col("head.print").alias("other"), F.col("head.since").alias("there"), F.col("head.until").alias("there_until")
    )
    # Equal paragraphs lie word for word at the same distance, linked ones about so; mixed, the ends of a run might not be the same word in both.
    kinds = ["print", "other", "scale"]
    runs = _chained(pointed, kinds, "since", "until", EDIT + 1, F.col("since") - F.col("there")).groupBy(*kinds, "_chain").agg(
        F.min("since").alias("since"), F.max("until").alias("until"), F.min("there").alias("there"), F.max("there_until").alias("there_until")
    )
    runs = saved(runs.drop("scale", "_chain").distinct(), "runs")
    edges = _edges(texts, runs, least_words + 1 - LEAST)
    mine = edges.select("print", "since", "until", *(F.col(c).alias(f"my_{c}") for c in ("before", "after", "starts", "ends")))
    theirs = broadcast_if_small(
        edges.join(runs.select(F.col("other").alias("print"), F.col("there").alias("since"), F.col("there_until").alias("until")).distinct(), ["print", "since", "until"], "left_semi").select(
            F.col("print").alias("other"), F.col("since").alias("there"), F.col("until").alias("there_until"), "before", "after"
        ),
        400,
    )
    both = runs.join(mine, ["print", "since", "until"]).join(theirs, ["other", "there", "there_until"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, start, end = [], [], [], []
            for a, x, s, b, y, e in zip(*(batch.column(c).to_pylist() for c in ("my_before", "before", "my_starts", "my_after", "after", "my_ends"))):
                left.append(_alike(np.frombuffer(a, np.uint32)[::-1], np.frombuffer(x, np.uint32)[::-1]))
                right.append(_alike(np.frombuffer(b, np.uint32), np.frombuffer(y, np.uint32)))
                start.append(np.frombuffer(s, np.int32)[-1 - left[-1]])
                end.append(np.frombuffer(e, np.int32)[right[-1]])
            columns = [pa.array(np.array(c, np.int32)) for c in (left, right, start, end)]
            yield pa.RecordBatch.from_arrays([batch.column("print"), batch.column("other"), batch.column("since"), batch.column("until"), *columns], ["print", "other", "since", "until", "left", "right", "start", "end"])

    read = both.mapInArrow(extend, "print long, other long, since int, until int, left int, right int, start int, end int")
    read = read.select("print", "other", (F.col("since") - F.col("left")).alias("since"), (F.col("until") + F.col("right")).alias("until"), "start", "end")
    hull = [F.min("since").alias("since"), F.max("until").alias("until"), F.min("start").alias("start"), F.max("end").alias("end")]
    long = _chained(read, ["print", "other"], "since", "until", EDIT + 1).groupBy("print", "other", "_chain").agg(*hull).where(F.col("until") - F.col("since") > least_words).drop("_chain")
    long = _chained(long, ["print"], "since", "until", 1).groupBy("print", "_chain").agg(*hull)
    cut = long.groupBy("print").agg(
        F.sum(F.col("until") - F.col("since")).cast("long").alias("removed"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("listed")
    )
    whole = F.coalesce(~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("first").isNotNull(), F.lit(False)) & (F.col("n_words") > least_words) & ~F.col("missing")
    named_spans = F.array_join(F.transform(F.coalesce("listed", F.array()), lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    out = every.join(several, "print", "left").join(cut, "print", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).when(F.col("missing"), 0).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("removed_words"),
        F.when(whole, F.concat_ws(":", "begin", "stop")).when(F.col("missing"), "").otherwise(named_spans).alias("spans"),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of every text, and the code points at which the first begins and the last ends."""
    for batch in batches:
        for at, part in slices(batch.column(2)):
            out = []
            for x in part.to_pylist():
                text = x or ""
                space = BLANK[np.frombuffer(text.encode(), np.uint8)]
                n = int((~space & np.concatenate([[True], space])[:-1]).sum())
                out.append((x is None, n, len(text) - len(text.lstrip(BLANKS)), len(text.rstrip(BLANKS))))
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).slice(at, len(part)) for i in (0, 1)] + [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "print", "missing", "n_words", "begin", "stop"]
            )


def _token_sets(words: np.ndarray, since: np.ndarray, until: np.ndarray, size: int) -> list[pa.Array]:
    """Number, sorted bytes and bitmap of the distinct shingles of many paragraphs of ``size`` or more words, all at once."""
    counts = until - since - size + 1
    edge = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(since)), counts)
    flat = rolled(words, size)[np.repeat(since - edge, counts) + np.arange(counts.sum())]
    order = np.lexsort((flat, owner))
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    flat, owner = flat[new], owner[new]
    n = np.bincount(owner, minlength=len(since))
    offsets = np.concatenate([[0], np.cumsum(n) * 8]).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(since), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
    cells = 64 * len(BITS)
    odd = (np.bincount(owner * cells + (mixed(flat, 3) % np.uint64(cells)).astype(np.int64), minlength=len(since) * cells) & 1).astype(np.uint8)
    bits = np.packbits(odd.reshape(len(since), cells), axis=1).view(np.int64).reshape(len(since), len(BITS))
    return [pa.array(n.astype(np.int64)), tokens, *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(BITS)))]


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """Words at the head of both that are equal."""
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    return int(unlike[0]) if len(unlike) else n


def _edges(texts: DataFrame, runs: DataFrame, reach: int) -> DataFrame:
    """What stands up to ``reach`` words before and behind the runs and the places they point to.

    ``before`` and ``after`` hold the hashes of those words; ``starts`` and ``ends`` the code points at which the words begin and end, with the run's own.
    """
    places = runs.select("print", "since", "until").union(runs.select("other", "there", "there_until")).distinct()
    places = saved(places.groupBy("print").agg(F.collect_list(F.struct("since", "until")).alias("wanted")), "edge_places")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column(1)):
                p, out = Words(part), []
                letters = np.concatenate([[0], np.cumsum((p.data & 0xC0) != 0x80)])
                sizes = np.cumsum([0, *(len((x or "").encode()) + 1 for x in part.to_pylist())])
                small = (p.hash >> np.uint64(32)).astype(np.uint32)
                for i, (name, some) in enumerate(zip(batch.column(0).slice(at, len(part)).to_pylist(), batch.column(2).slice(at, len(part)).to_pylist())):
                    low, high, head = int(p.first[i]), int(p.first[i + 1]), letters[sizes[i]]
                    for x in some:
                        a, b = low + x["since"], low + x["until"]
                        left, right = max(low, a - reach), min(high, b + reach)
                        starts, ends = letters[p.start[left : a + 1]] - head, letters[p.end[b - 1 : right]] - head
                        out.append((name, x["since"], x["until"], small[left:a].tobytes(), small[b:right].tobytes(), starts.astype(np.int32).tobytes(), ends.astype(np.int32).tobytes()))
                kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 4
                columns = list(zip(*out)) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["print", "since", "until", "before", "after", "starts", "ends"])

    found = texts.join(broadcast_if_small(places, 60), "print").select("print", "text", "wanted")
    return saved(found.mapInArrow(around, "print long, since int, until int, before binary, after binary, starts binary, ends binary"), "edges")
