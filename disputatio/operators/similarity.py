"""Similarity search: exact set-similarity join on text, exact and approximate cosine search on vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disputatio.functions.text import token_set, words
from disputatio.operators.ranking import top_k_per_group
from disputatio.session import checkpointed, measure

# Search depths of the two search forms and the default similarity threshold.
SEARCH_DEPTH = 1000
SHORT_SEARCH_DEPTH = 10
SIMILARITY_THRESHOLD = 0.8

# Largest topic side that is sent to every executor: bytes of its prefix rows, or cells of vectors and results.
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_CELLS = 4_000_000
SLACK = 1e-9
# Cells of (sentence, topic) whose shared words a task counts at once, and hits it hands on at once.
COUNT_CELLS = 400_000
HIT_ROWS = 10_000
# Carried rows a vector search collects before it lets go of those no topic keeps.
CARRIED_ROWS = 200_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, summed in double precision; a zero vector has cosine 0 with everything."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    zero = F.lit(0.0)

    def add(acc: Column, x: Column) -> Column:
        return acc + x

    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, add)
    norms = F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), zero, add)) * F.sqrt(
        F.aggregate(F.transform(b, lambda x: x * x), zero, add)
    )
    return F.when(norms == 0, zero).otherwise(F.try_divide(dot, norms))


def above(similarity: Column, threshold: float, strict: bool = False) -> Column:
    """The threshold test, on the unrounded similarity."""
    return similarity > threshold if strict else similarity >= threshold


def overlap_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct words."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _token_set(text: Column) -> Column:
    """The word set, never null: over a nullable one Spark would compute it again in a null filter."""
    return F.coalesce(token_set(text), F.array().cast("array<string>"))


def _prefix(tokens: Column, threshold: float) -> Column:
    """The leading words of which a pair reaching the threshold must share its first common one."""
    size = F.size(tokens)
    return F.slice(tokens, 1, size - F.ceil(size * threshold - SLACK).cast("int") + 1)


def signature(tokens: Column) -> Column:
    """64 bits, one set for each word by its hash."""
    bits = F.aggregate(
        tokens,
        F.lit(0).cast("long"),
        lambda acc, w: acc.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))
        ),
    )
    return F.coalesce(bits, F.lit(0).cast("long"))


def _matches(threshold: float, strict: bool) -> Column:
    """Whether corpus set ``_c`` and topic set ``_t`` pass the threshold and first meet at ``_token``.

    The tests go from cheap to costly: set sizes; words left from the meeting place on, as none is
    shared before it; words that cannot be shared by the signatures (every bit of one side missing on
    the other is at least one word it has alone); the similarity itself; and that this is the first
    shared word, so that each pair is kept once. It is one conditional expression, as Spark may put the
    parts of a plain conjunction in another order.
    """
    nl, nr = F.size("_c"), F.size("_t")
    needed = (nl + nr) * (threshold / (1 + threshold)) - SLACK
    only_c = F.bit_count(F.col("_cs").bitwiseAND(F.bitwise_not(F.col("_ts"))))
    only_t = F.bit_count(F.col("_ts").bitwiseAND(F.bitwise_not(F.col("_cs"))))
    possible = (
        (nr >= nl * threshold - SLACK)
        & (nl >= nr * threshold - SLACK)
        & (F.least(nl - F.col("_cp"), nr - F.col("_tp")) >= needed)
        & (nl - only_c >= needed)
        & (nr - only_t >= needed)
    )
    common = F.array_intersect("_c", "_t")
    passed = above(overlap_similarity(F.col("_c"), F.col("_t")), threshold, strict)
    first = F.element_at(common, 1) == F.col("_token")
    return F.coalesce(F.when(possible, F.when(F.size(common) >= needed, F.when(passed, first))), F.lit(False))


def text_top_k(
    topics: DataFrame,
    corpus: DataFrame,
    *,
    topic: str,
    corpus_key: Sequence[str],
    corpus_text: str,
    threshold: float,
    k: int = SEARCH_DEPTH,
    strict: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    two_level: bool | None = None,
) -> DataFrame:
    """Top-k corpus rows per topic text by Jaccard similarity of word sets, above a threshold.

    ``topics`` holds one column of distinct texts. The result has the corpus columns, the topic,
    ``similarity``, ``rank`` (from 0) and ``num_matches``.

    If the topics' prefix rows fit the checked bound, the topics travel to the corpus as lists of topics by
    word; each task counts the words its sentences share with them, and the corpus does not move at all.
    If not, pairs are found by prefix filtering: with all word sets in one fixed order, two sets that reach the
    threshold share a word among the first few of each. Both sides meet by (word, set size), with equal word
    sets of the corpus merged first; a pair is looked at once, at its first common word.
    """
    t, total = _topic_sets(topics, topic, threshold)
    if total <= broadcast_bytes:
        hits = _text_hits_counted(t, corpus, topic, corpus_text, threshold, strict)
    else:
        hits = _text_hits_shuffled(t, corpus, topic, corpus_key, corpus_text, threshold, strict, k, two_level)
    best = [F.col("similarity").desc(), *[F.col(c) for c in corpus_key]]
    ranked = top_k_per_group(hits, [topic], best, k, "rank", two_level)
    if total > broadcast_bytes:
        ranked = ranked.join(corpus, list(corpus_key))
    return with_num_matches(ranked, [topic])


def _topic_sets(topics: DataFrame, topic: str, threshold: float) -> tuple[DataFrame, int]:
    """Word set of each topic text, and the bytes their prefix rows would take.

    Each prefix word makes a row that carries the text and its word set.
    """
    if threshold <= 0:
        raise ValueError("the text search needs a threshold above 0")
    t = topics.select(F.col(topic), _token_set(F.col(topic)).alias("_t")).where(F.size("_t") > 0)
    per_row = F.octet_length(topic) * 2 + F.size("_t") * 16 + 64
    size = F.sum(F.size(_prefix(F.col("_t"), threshold)).cast("long") * per_row)
    return t, measure(t, F.coalesce(size, F.lit(0)).alias("n"))["n"]


def text_matches(
    topics: DataFrame,
    corpus: DataFrame,
    *,
    topic: str,
    corpus_text: str,
    threshold: float,
    strict: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """All pairs above the threshold, without the top-k cut: the form that also runs on a stream.

    Topics within the checked bound are broadcast; beyond it both sides are shuffled by word, on a stream per micro-batch.
    """
    t, total = _topic_sets(topics, topic, threshold)
    return _text_hits_by_word(t, corpus, corpus_text, threshold, strict, total <= broadcast_bytes)


def with_num_matches(hits: DataFrame, group: Sequence[str]) -> DataFrame:
    """Hits per topic, after the top-k cut."""
    return hits.withColumn("num_matches", F.count(F.lit(1)).over(Window.partitionBy(*group)).cast("int"))


def _text_hits_by_word(t: DataFrame, corpus: DataFrame, text: str, threshold: float, strict: bool, small: bool = True) -> DataFrame:
    wanted = t.withColumn("_ts", signature(F.col("_t")))
    wanted = wanted.select("*", F.posexplode_outer(_prefix(F.col("_t"), threshold)).alias("_tp", "_token"))
    rows = corpus.withColumn("_c", _token_set(F.col(text))).withColumn("_cs", signature(F.col("_c")))
    rows = rows.select("*", F.posexplode_outer(_prefix(F.col("_c"), threshold)).alias("_cp", "_token"))
    # the outer explode spares the size filter Spark would add, which computes every word set twice
    met = rows.join(F.broadcast(wanted) if small else wanted, "_token")
    met = met.where(_matches(threshold, strict))
    return met.withColumn("similarity", overlap_similarity(F.col("_c"), F.col("_t"))).drop(
        "_c", "_cs", "_cp", "_t", "_ts", "_tp", "_token"
    )


def _text_hits_counted(t: DataFrame, corpus: DataFrame, topic: str, text: str, threshold: float, strict: bool) -> DataFrame:
    """All pairs above the threshold, found in the corpus rows' own batches: the corpus columns, the topic and ``similarity``.

    A word of a sentence adds one to each topic that holds it; sizes and sums then give the similarity, so no word sets are compared.
    """
    table = t.select(topic, "_t").toArrow().combine_chunks()
    names, sets = table.column(0).combine_chunks(), table.column(1).combine_chunks()
    coded = sets.flatten().dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(number, kind="stable")
    holders = np.repeat(np.arange(len(sizes)), sizes)[order]
    first = np.searchsorted(number[order], np.arange(len(coded.dictionary) + 1))
    sent = corpus.sparkSession.sparkContext.broadcast((coded.dictionary, first, holders, sizes, names))
    columns = corpus.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, holders, sizes, names = sent.value
        n_topics = max(len(sizes), 1)
        step = max(1, COUNT_CELLS // n_topics)
        for batch in batches:
            row, word, size = _distinct_words(batch.column(len(columns)), known)
            own = batch.select(columns)
            # as many words of its own a sentence shares with every topic it reaches the threshold with
            least = np.maximum(np.ceil(size * threshold - SLACK), 1).astype(np.int64)
            for low in range(0, batch.num_rows if len(sizes) else 0, step):
                high = min(low + step, batch.num_rows)
                a, b = np.searchsorted(row, [low, high])
                counts = first[word[a:b] + 1] - first[word[a:b]]
                ends = np.cumsum(counts)
                if not len(ends) or not ends[-1]:
                    continue
                at = np.repeat(first[word[a:b]] - ends + counts, counts) + np.arange(ends[-1])
                cell = np.repeat((row[a:b] - low) * n_topics, counts) + holders[at]
                cell, common = _tally(cell, least[low:high], n_topics)
                r, j = cell // n_topics + low, cell % n_topics
                similarity = common / (size[r] + sizes[j] - common)
                passed = np.flatnonzero(similarity > threshold if strict else similarity >= threshold)
                for some in np.split(passed, range(HIT_ROWS, len(passed), HIT_ROWS)):
                    hits = own.take(pa.array(r[some]))
                    yield pa.RecordBatch.from_arrays([*hits.columns, names.take(pa.array(j[some])), pa.array(similarity[some])], [*columns, topic, "similarity"])

    rows = corpus.select("*", F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("_w"))
    schema = T.StructType([*corpus.schema.fields, T.StructField(topic, T.StringType()), T.StructField("similarity", T.DoubleType())])
    return rows.mapInArrow(search, schema)


def _distinct_words(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and place in ``known`` of the distinct known words, by row, and the number of all distinct words of each row."""
    coded = lists.flatten().dictionary_encode()
    n_words = max(len(coded.dictionary), 1)
    row = np.repeat(np.arange(len(lists), dtype=np.int64), lists.value_lengths().to_numpy(zero_copy_only=False))
    cell = np.sort(row * n_words + coded.indices.to_numpy(zero_copy_only=False))
    cell = cell[np.concatenate([[True], cell[1:] != cell[:-1]])] if len(cell) else cell
    row = cell // n_words
    of = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    word = of[cell - row * n_words]
    return row[word >= 0], word[word >= 0], np.bincount(row, minlength=len(lists))


def _tally(cell: np.ndarray, least: np.ndarray, n_topics: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells named ``least`` times or more, by row, and how often; many of them are counted in place, few are sorted."""
    if len(cell) * 16 < len(least) * n_topics:
        cell, counts = np.unique(cell, return_counts=True)
        enough = counts >= least[cell // n_topics]
        return cell[enough], counts[enough]
    counts = np.bincount(cell, minlength=len(least) * n_topics)
    enough = np.flatnonzero(counts.reshape(-1, n_topics) >= least[:, None])
    return enough, counts[enough]


def _text_hits_shuffled(
    t: DataFrame,
    corpus: DataFrame,
    topic: str,
    key: Sequence[str],
    text: str,
    threshold: float,
    strict: bool,
    k: int,
    two_level: bool | None,
) -> DataFrame:
    # A topic never needs more than the first k of the rows that share one word set, since they all
    # have the same similarity and ties go to the lower key.
    members = corpus.select(*key, _token_set(F.col(text)).alias("_c")).where(F.size("_c") > 0)
    members = top_k_per_group(members, ["_c"], [F.col(c) for c in key], k, "_nth", two_level)
    sets = members.where(F.col("_nth") == 0).select("_c", F.size("_c").alias("_size"))
    sets = sets.withColumn("_cs", signature(F.col("_c")))
    sets = sets.select("*", F.posexplode_outer(_prefix(F.col("_c"), threshold)).alias("_cp", "_token"))
    topic_sets = t.select("_t").distinct().withColumn("_ts", signature(F.col("_t")))
    n = F.size("_t")
    sizes = F.sequence(
        F.greatest(F.ceil(n * threshold - SLACK), F.lit(1)).cast("int"),
        F.floor(n / threshold + SLACK).cast("int"),
    )
    wanted = topic_sets.select("*", F.posexplode_outer(_prefix(F.col("_t"), threshold)).alias("_tp", "_token"))
    wanted = wanted.withColumn("_size", F.explode(sizes))
    pairs = sets.join(wanted, ["_token", "_size"])
    pairs = pairs.where(_matches(threshold, strict))
    pairs = pairs.select("_c", "_t", overlap_similarity(F.col("_c"), F.col("_t")).alias("similarity"))
    hits = pairs.join(members.drop("_nth"), "_c").join(t, "_t")
    return hits.select(topic, *key, "similarity")


# --- vectors -----------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of unit vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return rows / norms


class _Best:
    """The best k (similarity, key) of each topic among the rows a task has seen."""

    def __init__(self, n_topics: int, k: int):
        self.k = k
        self.kept = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in range(n_topics)]

    def add(self, topic: int, sims: np.ndarray, keys: np.ndarray) -> None:
        s = np.concatenate([self.kept[topic][0], sims])
        i = np.concatenate([self.kept[topic][1], keys])
        if len(s) > self.k:
            order = np.lexsort((i, -s))[: self.k]
            s, i = s[order], i[order]
        self.kept[topic] = (s, i)


class _Carried:
    """Columns of the rows that passed the threshold for some topic, by their id; those no topic keeps go when there are many.

    Rows are added after the topics have seen them.
    """

    def __init__(self, best: _Best):
        self.best, self.most, self.count = best, CARRIED_ROWS, 0
        self.ids: list[np.ndarray] = []
        self.rows: list[pa.RecordBatch] = []

    def add(self, ids: np.ndarray, rows: pa.RecordBatch) -> None:
        self.ids.append(ids)
        self.rows.append(rows)
        self.count += len(ids)
        if self.count > self.most:
            ids, table = np.concatenate(self.ids), pa.Table.from_batches(self.rows)
            wanted = np.flatnonzero(np.isin(ids, np.concatenate([i for _, i in self.best.kept])))
            self.ids, self.rows, self.count = [ids[wanted]], table.take(pa.array(wanted)).combine_chunks().to_batches(), len(wanted)
            self.most = max(CARRIED_ROWS, 2 * self.count)

    def of(self, ids: np.ndarray) -> list[pa.Array]:
        have = np.concatenate(self.ids)
        order = np.argsort(have, kind="stable")
        at = order[np.searchsorted(have[order], ids)]
        return [c.combine_chunks() for c in pa.Table.from_batches(self.rows).take(pa.array(at)).columns]


def _search_blocks(
    batches: Iterator[tuple[np.ndarray, pa.Array]], topics: np.ndarray, threshold: float, strict: bool, k: int, best: _Best | None = None, carry: Callable[[np.ndarray], None] | None = None
) -> _Best:
    best = best or _Best(len(topics), k)
    for keys, column in batches:
        if len(keys) == 0:
            continue
        sims = np.round(_matrix(column) @ topics.T, 10)
        passed = sims > threshold if strict else sims >= threshold
        for j in np.flatnonzero(passed.any(axis=0)):
            rows = np.flatnonzero(passed[:, j])
            best.add(int(j), sims[rows, j], keys[rows])
        if carry is not None and len(some := np.flatnonzero(passed.any(axis=1))):
            carry(some)
    return best


def _as_batch(best: _Best, topic_ids: np.ndarray) -> pa.RecordBatch:
    counts = [len(s) for s, _ in best.kept]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(topic_ids, counts), type=pa.int64()),
            pa.array(np.concatenate([i for _, i in best.kept] or [np.empty(0)]), type=pa.int64()),
            pa.array(np.concatenate([s for s, _ in best.kept] or [np.empty(0)]), type=pa.float64()),
        ],
        names=["topic_id", "corpus_id", "similarity"],
    )


HITS = T.StructType(
    [
        T.StructField("topic_id", T.LongType()),
        T.StructField("corpus_id", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)


def cosine_top_k(
    topics: DataFrame,
    corpus: DataFrame,
    *,
    threshold: float,
    k: int = SEARCH_DEPTH,
    strict: bool = False,
    broadcast_cells: int = BROADCAST_CELLS,
    block_rows: int = 50_000,
    two_level: bool | None = None,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Exact top-k cosine search.

    ``topics(topic_id, vector)`` against ``corpus(corpus_id, vector)``; result ``topic_id, corpus_id,
    similarity, rank``. Similarities are compared at ten decimals, beyond what float vectors carry.
    ``carried`` names more columns of the corpus for the result; ``corpus_id`` is then unique, and a corpus that is searched in place is read once.

    A topic block that passes the size check goes to every task, each task multiplies its batches with
    it and hands on no more than k rows per topic. Beyond the bound, topics are split in groups, the
    corpus in blocks, and every (group, block) pair is one bounded task.
    """
    shape = measure(topics, F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d"))
    n, dim = shape["n"], shape["d"] or 1
    fields = T.StructType([*HITS.fields, *(corpus.schema[c] for c in carried)])
    if n == 0:
        return topics.sparkSession.createDataFrame([], fields).withColumn("rank", F.lit(0))
    per_topic = dim + 2 * k
    small = n * per_topic <= broadcast_cells
    if small:
        hits = _cosine_hits_broadcast(topics, corpus, threshold, strict, k, carried, fields)
    else:
        groups = math.ceil(n * per_topic / broadcast_cells)
        corpus = checkpointed(corpus, "corpus") if carried else corpus
        hits = _cosine_hits_grid(topics, corpus, threshold, strict, k, groups, block_rows)
    best = top_k_per_group(hits, ["topic_id"], [F.col("similarity").desc(), F.col("corpus_id")], k, "rank", two_level)
    return best if small or not carried else best.join(corpus.select("corpus_id", *carried), "corpus_id")


def _cosine_hits_broadcast(topics: DataFrame, corpus: DataFrame, threshold: float, strict: bool, k: int, carried: Sequence[str], fields: T.StructType) -> DataFrame:
    table = topics.select(F.col("topic_id").cast("long"), F.col("vector").cast("array<double>")).toArrow()
    table = table.combine_chunks()
    ids = table["topic_id"].combine_chunks().to_numpy()
    sent = corpus.sparkSession.sparkContext.broadcast((ids, _matrix(table["vector"].combine_chunks())))
    names, more = [f.name for f in fields], list(carried)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topic_ids, matrix = sent.value
        best = _Best(len(topic_ids), k)
        rows = _Carried(best)
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            carry = (lambda some, b=b, keys=keys: rows.add(keys[some], b.select(range(2, 2 + len(more))).take(pa.array(some)))) if more else None
            _search_blocks(iter([(keys, b.column(1))]), matrix, threshold, strict, k, best, carry)
        out = _as_batch(best, topic_ids)
        if not more:
            yield out
        elif out.num_rows:
            yield pa.RecordBatch.from_arrays([*out.columns, *rows.of(out.column(1).to_numpy())], names)

    # Each task hands on k rows per topic, so small ones are put together, two for each core.
    tasks = 2 * corpus.sparkSession.sparkContext.defaultParallelism
    return corpus.select(F.col("corpus_id").cast("long"), "vector", *more).coalesce(tasks).mapInArrow(search, fields)


def _cosine_hits_grid(
    topics: DataFrame, corpus: DataFrame, threshold: float, strict: bool, k: int, groups: int, block_rows: int
) -> DataFrame:
    blocks = max(1, math.ceil(corpus.count() / block_rows))
    left = topics.select(
        F.col("topic_id").cast("long").alias("id"),
        F.col("vector").cast("array<double>").alias("vector"),
        F.pmod(F.xxhash64("topic_id"), F.lit(groups)).alias("g"),
        F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("b"),
    )
    right = corpus.select(
        F.col("corpus_id").cast("long").alias("id"),
        F.col("vector").cast("array<double>").alias("vector"),
        F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("g"),
        F.pmod(F.xxhash64("corpus_id"), F.lit(blocks)).alias("b"),
    )

    def search(some_topics: pa.Table, block: pa.Table) -> pa.Table:
        if some_topics.num_rows == 0 or block.num_rows == 0:
            return pa.Table.from_batches([], schema=pa.schema([("topic_id", pa.int64()), ("corpus_id", pa.int64()), ("similarity", pa.float64())]))
        ids = some_topics["id"].combine_chunks().to_numpy()
        matrix = _matrix(some_topics["vector"].combine_chunks())
        rows = iter([(block["id"].combine_chunks().to_numpy(), block["vector"].combine_chunks())])
        return pa.Table.from_batches([_as_batch(_search_blocks(rows, matrix, threshold, strict, k), ids)])

    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(search, HITS)


def approximate_cosine_join(
    topics: DataFrame, corpus: DataFrame, *, threshold: float, tables: int = 8, bucket_length: float = 0.8, seed: int = 42
) -> DataFrame:
    """Approximate cosine join by random-projection hashing on unit vectors.

    On unit vectors a cosine of at least t is a Euclidean distance of at most sqrt(2 - 2t).
    """

    def unit(df: DataFrame, key: str) -> DataFrame:
        raw = df.select(key, array_to_vector(F.col("vector").cast("array<double>")).alias("raw"))
        return Normalizer(inputCol="raw", outputCol="unit").transform(raw).select(key, "unit")

    t, c = unit(topics, "topic_id"), unit(corpus, "corpus_id")
    lsh = BucketedRandomProjectionLSH(
        inputCol="unit", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    model = lsh.fit(t)
    near = model.approxSimilarityJoin(t, c, math.sqrt(2 - 2 * threshold) + SLACK, distCol="distance")
    return near.select(
        F.col("datasetA.topic_id").alias("topic_id"),
        F.col("datasetB.corpus_id").alias("corpus_id"),
        (1 - F.col("distance") * F.col("distance") / 2).alias("similarity"),
    )


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label, averaged per cell with map-side partial sums."""
    cells = df.select(F.col(label).alias("topic_id"), F.posexplode(F.col(vector).cast("array<double>")).alias("d", "v"))
    means = cells.groupBy("topic_id", "d").agg(F.avg("v").alias("v"))
    rows = means.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("cells"))
    return rows.select("topic_id", F.transform("cells", lambda c: c["v"]).alias("vector"))


__all__ = [
    "above",
    "approximate_cosine_join",
    "centroids",
    "cosine",
    "cosine_top_k",
    "overlap_similarity",
    "text_top_k",
    "vector_to_array",
    "with_num_matches",
]
