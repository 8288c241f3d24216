"""Collocations: phrases that stand together more often than their parts do, counted in suffix subtrees by groups of prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disputatio.llm.common import broadcast_if_small, saved
from disputatio.llm.shingles import mixed, slices

# Bytes that end a piece, and bytes between words.
BREAKS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"

DEPTH = 4
KEY = [f"h{i}" for i in range(1, DEPTH + 1)]

_BREAK = np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_SPACE = _BREAK.copy()
_SPACE[list(GAPS)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(13).integers(0, 2**64, 256, np.uint64)


class Pieces:
    """Words of a part of a text column with A-Z as lower case: bytes, hashes by language, and how far each word's piece reaches."""

    def __init__(self, texts: pa.Array, langs: np.ndarray):
        rows = [(x or "").encode().lower() + b"\n" for x in texts.to_pylist()]
        self.data = np.frombuffer(b"".join(rows), np.uint8)
        space = np.concatenate([[True], _SPACE[self.data]])
        self.start = np.flatnonzero(space[:-1] & ~space[1:])
        self.end = np.flatnonzero(~space[:-1] & space[1:])
        n = len(self.data)
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(_BASE), -1, 2**64)))]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[self.data] * powers[:-1], dtype=np.uint64)])
        plain = (sums[self.end] - sums[self.start]) * inverse[self.start]
        self.row = np.searchsorted(np.cumsum([len(r) for r in rows]), self.start, "right")
        # 0 stands for "no word".
        self.hash = np.maximum(mixed(plain + mixed(langs[self.row], 31), 32), np.uint64(1))
        piece = np.concatenate([[0], np.cumsum(_BREAK[self.data])])[self.start]
        self.piece = piece  # rows end with a break, so it tells rows apart, too

    def word(self, at: int) -> str:
        return self.data[self.start[at] : self.end[at]].tobytes().decode()


def lang_codes(langs: pa.Array) -> np.ndarray:
    return np.array([hash_of(x) for x in langs.to_pylist()], np.uint64)


def hash_of(text: str) -> int:
    value = 17
    for b in text.encode():
        value = (value * 0x100000001B3 + b + 1) % 2**64
    return value


class Sketch:
    """A Bloom filter of a bounded number of bits: what is in it passes, of the rest a part that grows as it fills.

    It only spares work. Counts are exact whatever passes.
    """

    def __init__(self, rows: int, most_bits: int):
        self.bits = 1 << min(most_bits, max(16, int(rows * 12).bit_length()))
        self.cells = np.zeros(self.bits // 64, np.uint64)

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        return [mixed(keys, 40 + i) & np.uint64(self.bits - 1) for i in range(3)]

    def fill(self, table: DataFrame, key) -> Sketch:
        """Collect the bits of a table's keys: a word of 64 of them is one row, so the driver sees no more than the filter's size."""
        places = self.places

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.concatenate(places(key(batch)))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["cell", "bits"])

        found = table.mapInArrow(marked, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
        self.cells[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
        return self

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys):
            out &= (self.cells[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return out


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(3) + mixed(b, 33), 34)


def bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pair of words as a number of 40 bits; one that several pairs share only lets more of them pass."""
    return paired(a, b) >> np.uint64(24)


class Counter:
    """Counts of rows of hashes, summed inside a task before they move; handed on when many different ones are held."""

    def __init__(self, width: int, most: int = 1_000_000):
        self.width, self.most = width, most
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.full = 0, False

    def add(self, rows: np.ndarray) -> None:
        if len(rows):
            self.parts.append((rows, np.ones(len(rows), np.int64)))
            self.held += len(rows)
            if self.held > 2 * self.most:
                self.parts = [self.merged()]
                self.held = len(self.parts[0][0])
                self.full = self.held > self.most

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros((0, self.width), np.uint64), np.zeros(0, np.int64)
        rows, weights = (np.concatenate(x) for x in zip(*self.parts))
        # One sort, by a hash of the row; rows that share a hash by chance may come out twice, which a later sum settles.
        key = rows[:, 0]
        for i in range(1, self.width):
            key = paired(key, rows[:, i])
        order = np.argsort(key)
        rows, weights = rows[order], weights[order]
        starts = edges(rows)
        return rows[starts], np.add.reduceat(weights, starts)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged()
        self.parts, self.held, self.full = [], 0, False
        return out


def edges(rows: np.ndarray) -> np.ndarray:
    """Where a new row begins in sorted rows."""
    return np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))


def _as_batch(rows: np.ndarray, n: np.ndarray, extra: dict | None = None) -> pa.RecordBatch:
    arrays = [pa.array(np.ascontiguousarray(rows[:, i]).view(np.int64)) for i in range(rows.shape[1])] + [pa.array(n)]
    names = KEY[: rows.shape[1]] + ["n"]
    for name, values in (extra or {}).items():
        arrays.append(values)
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, word, h1, n`` for every word; ``docs`` has ``lang, text``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, list] = {}

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([w[0] for w in words.values()], pa.string()), pa.array([w[1] for w in words.values()], pa.string()), pa.array(np.array(list(words), np.uint64).view(np.int64)), pa.array([w[2] for w in words.values()], pa.int64())],
                ["lang", "word", "h1", "n"],
            )
            words.clear()
            return out

        for batch in batches:
            langs = batch.column(0).to_pylist()
            codes = lang_codes(batch.column(0))
            for at, part in slices(batch.column(1)):
                p = Pieces(part, codes[at : at + len(part)])
                keys, first, n = np.unique(p.hash, return_index=True, return_counts=True)
                for key, i, m in zip(keys.tolist(), first.tolist(), n.tolist()):
                    known = words.get(key)
                    if known is None:
                        words[key] = [langs[at + int(p.row[i])], p.word(i), m]
                    else:
                        known[2] += m
                if len(words) > 500_000:
                    yield rows()
        yield rows()

    found = docs.mapInArrow(counted, "lang string, word string, h1 long, n long")
    return found.groupBy("lang", "word", "h1").agg(F.sum("n").alias("n"))


def count_pairs(docs: DataFrame, words: Sketch) -> DataFrame:
    """``pair, n``: a bucket of two neighbouring words and its count, for pairs whose words both pass the sketch."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(1, 2_000_000)
        for batch in batches:
            codes = lang_codes(batch.column(0))
            for at, part in slices(batch.column(1)):
                p = Pieces(part, codes[at : at + len(part)])
                often = words.has(p.hash)
                here = np.flatnonzero((p.piece[1:] == p.piece[:-1]) & often[1:] & often[:-1])
                counter.add(bucket(p.hash[here], p.hash[here + 1])[:, None])
                if counter.full:
                    yield _as_batch(*counter.taken()).rename_columns(["pair", "n"])
        yield _as_batch(*counter.taken()).rename_columns(["pair", "n"])

    return docs.mapInArrow(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Groups:
    """Prefixes grouped by a memory budget: a prefix of too many occurrences is made one word longer, the others share groups.

    The count of a word bounds the suffixes that begin with it, that of a pair those below the pair. Prefixes over the budget
    are at most the total divided by it, and all others meet in some eight cells for each budget in the total, so what the
    driver holds is bounded by total / budget.
    """

    def __init__(self, words: DataFrame, pairs: DataFrame, budget: int):
        self.heavy_words = _sorted(words, "h1", budget)[0]
        self.heavy_pairs, share = _sorted(pairs, "pair", budget)
        self.word_group, last = _packed(words, "h1", self.heavy_words, budget)
        self.pair_group, end = _packed(pairs, "pair", self.heavy_pairs, budget)
        self.pair_group += last
        self.spread = share // budget + 1
        self.offset = last + end + np.cumsum(self.spread) - self.spread
        self.count = int(last + end + self.spread.sum())

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The group of every row by its prefix: its first word, two where that is heavy, three where these are."""
        pair = bucket(rows[:, 0], rows[:, 1])
        longer, _ = _among(self.heavy_words, rows[:, 0])
        group = np.where(longer, self.pair_group[_cell(pair, len(self.pair_group))], self.word_group[_cell(rows[:, 0], len(self.word_group))])
        heavy, at = _among(self.heavy_pairs, pair)
        if heavy.any():
            third = (mixed(rows[:, 2], 36) % self.spread[at].astype(np.uint64)).astype(np.int64)
            group = np.where(longer & heavy, self.offset[at] + third, group)
        return group


def _cell(keys: np.ndarray, cells: int) -> np.ndarray:
    return (mixed(keys, 35) % np.uint64(cells)).astype(np.int64)


def _sorted(table: DataFrame, key: str, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys over the budget in order, and their counts."""
    found = table.where(F.col("n") > budget).select(key, "n").toArrow()
    keys = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column(1).to_numpy()[order]


def _packed(table: DataFrame, key: str, heavy: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """The group of every cell, neighbouring cells filling a group until the budget is reached, and the number of groups."""
    cells = 1 << max(10, (8 * (table.agg(F.sum("n")).first()[0] or 0) // budget).bit_length())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = column(batch, key), batch.column("n").to_numpy()
            light = ~_among(heavy, keys)[0]
            sums = np.zeros(cells, np.int64)
            np.add.at(sums, _cell(keys[light], cells), n[light])
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(sums)), pa.array(sums[sums > 0])], ["cell", "n"])

    sums = np.zeros(cells, np.int64)
    found = table.select(key, "n").mapInArrow(summed, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sums[found.column(0).to_numpy()] = found.column(1).to_numpy()
    group = (np.cumsum(sums) - sums) // budget
    return group, int(group[-1]) + 1


def _among(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def suffixes(docs: DataFrame, pairs: Sketch, groups: Groups) -> DataFrame:
    """``h1 … h4, n, group``: the words from each place on, two to four of them, as far as every pair in a row passes the sketch."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(DEPTH)

        def rows() -> pa.RecordBatch:
            keys, n = counter.taken()
            return _as_batch(keys, n, {"group": pa.array(groups.of(keys))})

        for batch in batches:
            codes = lang_codes(batch.column(0))
            for at, part in slices(batch.column(1)):
                p = Pieces(part, codes[at : at + len(part)])
                follows = p.piece[1:] == p.piece[:-1]
                follows[follows] = pairs.has(bucket(p.hash[:-1][follows], p.hash[1:][follows]))
                follows = np.concatenate([follows, np.zeros(DEPTH, bool)])
                here = np.flatnonzero(follows)
                keys = np.zeros((len(here), DEPTH), np.uint64)
                reached = np.ones(len(here), bool)
                keys[:, 0] = p.hash[here]
                for i in range(1, DEPTH):
                    reached &= follows[here + i - 1]
                    keys[reached, i] = p.hash[here[reached] + i]
                counter.add(keys)
                if counter.full:
                    yield rows()
        yield rows()

    schema = ", ".join(f"{k} long" for k in KEY)
    return docs.mapInArrow(counted, f"{schema}, n long, group long")


def subtree_counts(suffix_rows: DataFrame, groups: Groups, least: int) -> DataFrame:
    """Counts of all phrases of two to four words with ``least`` or more, each group of prefixes on its own.

    In sorted order every node of a suffix tree is a run of suffixes; the tree is cut at four words, and a node's count is the
    sum over the leaves of its run. Only a heavy pair lies in several groups; its counts are added up in the end.
    """
    schema = ", ".join(f"{k} long" for k in KEY) + ", n long"

    def counted(table: pa.Table) -> pa.Table:
        rows = np.stack([table.column(k).to_numpy().view(np.uint64) for k in KEY], axis=1)
        n = table.column("n").to_numpy()
        order = np.lexsort(rows.T[::-1])
        rows, n = rows[order], n[order]
        out = []
        for depth in range(2, DEPTH + 1):
            nodes = edges(rows[:, :depth])
            keys, totals = rows[nodes].copy(), np.add.reduceat(n, nodes)
            keys[:, depth:] = 0
            kept = (totals >= least) & (keys[:, depth - 1] > 0)
            if depth == 2:
                kept |= _among(groups.heavy_pairs, bucket(keys[:, 0], keys[:, 1]))[0]
            out.append(_as_batch(keys[kept], totals[kept]))
        return pa.Table.from_batches(out)

    found = suffix_rows.groupBy("group").applyInArrow(counted, schema)
    return found.groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def exact(name: str) -> Column:
    """A whole number whose products do not overflow."""
    return F.col(name).cast("decimal(19,0)")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, covered: int = 80, budget: int = 2_000_000, sketch_bits: int = 27
) -> DataFrame:
    """The first ``top`` phrases of two to four words per language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts (A-Z in lower case) are cut into pieces at ``.,;:!?`` and line ends, and those into words at blanks and tabs. A phrase is a
    candidate if it stands ``least`` times or more (``a``; overlaps count). Of its cuts in two, the one of lowest score counts, the
    first of equal ones: ``l`` and ``r`` are the counts of both sides, the score is floor(2000000 a / (l + r)). Candidates inside a longer candidate
    with ``covered`` percent of their count or more are dropped. Order: score, then ``a``, both falling, then the phrase by its bytes.
    ``n`` is the number of all words of the language.

    Counting goes down level by level, and only where it can still pay: a phrase cannot stand more often than its parts. Words and pairs are counted with
    sums in every task; sketches of bounded size tell the tasks which of them are frequent (pairs go by a hash of 40 bits until then, and are counted exactly in the end). The suffixes that are left, cut at four words, are dealt
    to groups of prefixes of ``budget`` occurrences at most (``Groups``); a prefix of more is made longer. Each group builds its part of the suffix tree alone.
    A group holds one row for each different suffix and task. Words are told apart by 64-bit hashes of language and word.

    A null language is ``und``. Null and empty texts have no words; texts of any length are read whole, in slices of texts. Repeated rows
    count again. Extra columns are dropped. An empty table gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text IS NOT NULL")
    all_words = saved(count_words(rows), "words")
    sizes = all_words.groupBy("lang").agg(F.sum("n").alias("words"))
    words = saved(all_words.where(F.col("n") >= least), "frequent")
    often = Sketch(words.count(), sketch_bits).fill(words.select("h1"), lambda b: column(b, "h1"))
    pairs = saved(count_pairs(rows, often).where(F.col("n") >= least), "pairs")
    linked = Sketch(pairs.count(), sketch_bits).fill(pairs.select("pair"), lambda b: column(b, "pair"))
    groups = Groups(words, pairs, budget)
    phrases = saved(subtree_counts(suffixes(rows, linked, groups), groups, least), "phrases")
    none = F.lit(0).cast("long")
    counts = words.select("h1", *[none.alias(k) for k in KEY[1:]], "n").unionByName(phrases)
    counts = broadcast_if_small(saved(counts, "counts"), 40)
    return ranked(phrases, counts, words, sizes, top, covered)


def ranked(phrases: DataFrame, counts: DataFrame, words: DataFrame, sizes: DataFrame, top: int, covered: int) -> DataFrame:
    """Score the phrases by the counts of their parts, drop covered ones and keep the first of every language."""
    none = F.lit(0).cast("long")
    length = sum((F.when(F.col(k) != 0, 1).otherwise(0) for k in KEY), F.lit(0))
    phrases = phrases.withColumn("length", length)

    def part(first: Column, last: Column) -> Column:
        """The words from one place to another, filled up with zeros."""
        inside = F.slice(F.array(*KEY), first, last - first + 1)
        return F.struct(*[F.coalesce(F.get(inside, F.lit(i)), none).alias(k) for i, k in enumerate(KEY)])

    # Parts of a phrase: both sides of each cut, told apart by k and side.
    k = F.col("k")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), part(F.lit(1), k).alias("part")), F.struct(F.lit("r").alias("side"), part(k + 1, F.col("length")).alias("part"))))
    sides = cuts.select(*KEY, "n", "k", sides.alias("s")).select(*[F.col(x).alias(f"p{x}") for x in KEY], F.col("n").alias("a"), "k", "s.side", "s.part.*")
    found = sides.join(counts, KEY)
    whole = [f"p{x}" for x in KEY]
    both = found.groupBy(*whole, "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("n"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("n"))).alias("r"))
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    best = both.withColumn("score", score.cast("long")).groupBy(*whole, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    best = best.select(*[F.col(f"p{x}").alias(x) for x in KEY], "a", "best.l", "best.r", "best.score")

    # What a longer phrase covers: its parts of two words or more.
    inner = [(i, j) for i in range(1, DEPTH + 1) for j in range(i + 1, DEPTH + 1)]
    inside = F.explode(F.filter(F.array(*[F.when((F.lit(j) <= F.col("length")) & (F.lit(j - i + 1) < F.col("length")), part(F.lit(i), F.lit(j))) for i, j in inner]), lambda x: x.isNotNull()))
    cover = phrases.where("length > 2").select("n", inside.alias("part")).select("part.*", "n").groupBy(*KEY).agg(F.max("n").alias("most"))
    left = best.join(cover, KEY, "left").where(F.col("most").isNull() | (exact("most") * 100 < exact("a") * covered)).drop("most")
    left = saved(left, "scored")

    named = broadcast_if_small(words.select(F.col("h1").alias("h"), "lang", "word"), 48)
    spelt = left.select(*left.columns, F.posexplode(F.filter(F.array(*KEY), lambda x: x != 0)).alias("place", "h")).join(named, "h")
    spelt = spelt.groupBy(*left.columns).agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("list"))
    spelt = spelt.select("lang", F.array_join(F.col("list.word"), " ").alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's best are the best of its strands, so no task sorts all phrases of one.
    strands = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    near = spelt.withColumn("rank", F.row_number().over(strands)).where(F.col("rank") <= top)
    out = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
