"""Models that are nothing but counts: a naive Bayes classifier and hashed word vectors. All of it is grouping and joining.

Both join words with a table that has one row per word. The classifier counts words of a row before they meet it, so a word that
stands in every text brings one row per text; the table is broadcast within a checked size, and a frequent word in a larger
one is a skewed key that Spark splits at run time. The vectors look up a bounded number of most frequent words in place, so only rare words move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disputatio.functions.text import words
from disputatio.operators.similarity import cosine_top_k, with_num_matches
from disputatio.session import checkpointed, measure

SMALL_ROWS = 200_000
FREQUENT_WORDS = 200_000
DIMENSIONS = 64


def _small(df: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it is small. It is written before it is counted."""
    df = checkpointed(df, "counted")
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def word_counts(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """The key, ``word`` and ``tf`` for every different word of a row; a row without words has one row with a null word."""
    rows = df.select(*key, F.explode_outer(words(F.col(text))).alias("word"))
    return rows.groupBy(*key, "word").agg(F.count(F.lit(1)).alias("tf"))


# --- naive Bayes -------------------------------------------------------------------------------


@dataclass
class CountedModel:
    """``table``: ``word`` and one logarithm per label in ``weights``; ``labels`` and their logarithms ``priors`` are in the same order."""

    table: DataFrame
    labels: list
    priors: list[float]


def train_counted(train: DataFrame, text: str = "input_text", label: str = "label") -> CountedModel:
    """Multinomial naive Bayes with one added to every count.

    One aggregate over (label, word) with partial sums is the whole training. Labels are a bounded set: only they and their sums
    come to the driver. Null labels are left out, null texts have no words but count for the prior.
    """
    known = train.where(F.col(label).isNotNull())
    rows = known.select(F.col(label).alias("label"), F.explode(words(F.col(text))).alias("word"))
    counts = checkpointed(rows.groupBy("label", "word").agg(F.count(F.lit(1)).alias("c")), "counts")
    shares = {r.label: r.n for r in known.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = {r.label: r.c for r in counts.groupBy("label").agg(F.sum("c").alias("c")).collect()}
    size = counts.select("word").distinct().count()
    labels, n = sorted(shares), sum(shares.values())
    per_label = [F.coalesce(F.sum(F.when(F.col("label") == x, F.col("c"))), F.lit(0)) for x in labels]
    weights = [F.log((c + 1) / F.lit(float(totals.get(x, 0) + size))) for c, x in zip(per_label, labels)]
    table = counts.groupBy("word").agg(F.array(*weights).alias("weights")) if labels else counts.select("word", F.array().cast("array<double>").alias("weights"))
    return CountedModel(_small(table), labels, [log(shares[x] / n) for x in labels])


def predict_counted(model: CountedModel, rows: DataFrame, key: Sequence[str], text: str = "input_text") -> DataFrame:
    """The key, ``predicted_label`` (the smallest of equally likely ones) and ``margin``, by which it beats the next in logarithms.

    Rows are told apart by their key. Words the training did not see say nothing; without any other word the prior decides.
    """
    met = word_counts(rows, key, text).join(model.table, "word", "left")
    sums = [F.lit(p) + F.coalesce(F.sum(F.col("tf") * F.get("weights", F.lit(i))), F.lit(0.0)) for i, p in enumerate(model.priors)]
    scored = met.groupBy(*key).agg(F.array(*sums).alias("_s"))
    ranked = F.reverse(F.array_sort("_s"))
    best = F.array_position("_s", F.array_max("_s"))
    return scored.select(
        *key,
        F.element_at(F.array(*[F.lit(x) for x in model.labels]), best.cast("int")).alias("predicted_label"),
        F.coalesce(F.element_at(ranked, 1) - F.get(ranked, F.lit(1)), F.lit(0.0)).alias("margin"),
    )


# --- hashed vectors ----------------------------------------------------------------------------


@dataclass
class WordWeights:
    """Document frequencies of a collection: ``word``, ``df`` and the number of rows."""

    table: DataFrame
    rows: int

    @cached_property
    def frequent(self) -> pa.Table:
        """The ``FREQUENT_WORDS`` words that stand in most rows."""
        return self.table.orderBy(F.col("df").desc(), "word").limit(FREQUENT_WORDS).toArrow().combine_chunks()


def count_documents(corpus: DataFrame, text: str) -> WordWeights:
    # A null stands for the row itself, so one pass counts both.
    found = F.coalesce(F.array_distinct(words(F.col(text))), F.array().cast("array<string>"))
    tokens = corpus.select(F.explode(F.array_append(found, F.lit(None).cast("string"))).alias("word"))
    counts = checkpointed(tokens.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "counted")
    rows = measure(counts.where("word IS NULL"), F.coalesce(F.sum("df"), F.lit(0)).alias("n"))["n"]
    table = counts.where("word IS NOT NULL")
    return WordWeights(F.broadcast(table) if table.count() <= SMALL_ROWS else table, rows)


def bucket(word: Column, dimensions: int) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("long") % dimensions).cast("int")


def sign(word: Column) -> Column:
    return F.when(F.substring(F.md5(word), 8, 1) < "8", 1.0).otherwise(-1.0)


def _component(word: str, dimensions: int) -> tuple[int, float]:
    """``bucket`` and ``sign`` of a word, as plain values."""
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:7], 16) % dimensions, 1.0 if digest[7] < "8" else -1.0


def _schema(fields: Sequence[T.StructField], more: str) -> T.StructType:
    return T.StructType([*fields, *T.StructType.fromDDL(more).fields])


def embed_counted(df: DataFrame, key: Sequence[str], text: str, weights: WordWeights, dimensions: int = DIMENSIONS, output: str = "embedding") -> DataFrame:
    """The key and a unit vector: each word adds its count times its inverse document frequency, with a sign, to one component.

    Component and sign come from the word's MD5, so the vectors need no model file and other engines can make the same. A row without
    words, or whose words cancel out, has a zero vector. Words that no document of the collection holds get the highest weight. Rows are told apart by their key.

    The ``FREQUENT_WORDS`` words of most rows are broadcast and looked up in the row's batch; only the other words of a row, each with few
    occurrences, meet the table by a join. Rows are written once, as the numbers of their words. One whose words are all looked up gets its vector
    where it is read; the others move once, as those numbers, to meet their rarer words. Where keys repeat all rows move. Vectors are not written.
    """
    spark, first, places = df.sparkSession, weights.frequent, len(key)
    names = first.column("word").to_pylist()
    marks = [_component(w, dimensions) for w in names]
    value = np.array([m[1] for m in marks]) * np.log((weights.rows + 1.0) / (first.column("df").to_numpy() + 1.0))
    numbers = spark.sparkContext.broadcast({w: i for i, w in enumerate(names)})
    known = spark.sparkContext.broadcast((np.array([m[0] for m in marks], dtype=np.int64), value))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = numbers.value
        for batch in batches:
            lists = batch.column(places)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            coded = lists.flatten().dictionary_encode()
            of = np.array([place.get(w, -1) for w in coded.dictionary.to_numpy(zero_copy_only=False)], dtype=np.int32)
            word = of[coded.indices.to_numpy(zero_copy_only=False)] if len(of) else np.empty(0, dtype=np.int32)
            listed, ends = word >= 0, np.arange(batch.num_rows + 1)
            rare = coded.filter(pa.array(~listed)).dictionary_decode().cast(pa.string())
            out = [
                pa.ListArray.from_arrays(pa.array(np.searchsorted(row[some], ends).astype(np.int32)), values)
                for some, values in ((listed, pa.array(word[listed])), (~listed, rare))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:places], *out], [*key, "_f", "_rare"])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring rows of one key make one vector; only the last key of a batch waits for the next one."""
        component, value = known.value
        for table in _whole_keys(batches, places):
            row = _places_of_keys(table, places)
            n, keys = int(row[-1]) + 1, table.take(pa.array(np.searchsorted(row, np.arange(row[-1] + 1))))
            at, word = _flat(table.column("_f"), row)
            joined = np.flatnonzero(table.column("_d").is_valid().to_numpy())
            at = np.concatenate([at * dimensions + component[word], row[joined] * dimensions + table.column("_d").drop_null().to_numpy()])
            v = np.concatenate([value[word], table.column("_v").drop_null().to_numpy()])
            order = np.lexsort((v, at))  # one order of addition, however the rows came together
            raw = np.bincount(at[order], weights=v[order], minlength=n * dimensions).reshape(n, dimensions)
            norm = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
            # A norm that is only what rounding left over is none.
            unit = np.where(norm < 1e-9, 0.0, raw / np.where(norm < 1e-9, 1.0, norm))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dimensions + 1, dimensions, dtype=np.int32)), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in keys.columns[:places]], vectors], [*key, output])

    rows = df.select(*key, F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("_w"))
    kept = [f for f in rows.schema.fields if f.name != "_w"]
    packed = checkpointed(rows.mapInArrow(numbered, _schema(kept, "_f array<int>, _rare array<string>")), "numbered", compression="zstd")
    none = {"_d": F.lit(None).cast("int"), "_v": F.lit(None).cast("double")}
    once = packed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    settled = (F.size("_rare") == 0) if once else F.lit(False)
    moved = packed.where(~settled)
    rare = moved.select(*key, F.explode("_rare").alias("word")).join(weights.table, "word", "left")
    weight = sign(F.col("word")) * F.log(F.lit(weights.rows + 1.0) / (F.coalesce("df", F.lit(0)) + 1))
    rare = rare.select(*key, F.lit(None).cast("array<int>").alias("_f"), bucket(F.col("word"), dimensions).alias("_d"), weight.alias("_v"))
    gathered = moved.drop("_rare").withColumns(none).unionByName(rare).repartition(*key).sortWithinPartitions(*key)
    schema = _schema(kept, f"`{output}` array<double>")
    vectors = gathered.mapInArrow(dense, schema)
    return packed.where(settled).drop("_rare").withColumns(none).mapInArrow(dense, schema).unionByName(vectors) if once else vectors


def _flat(lists: pa.ChunkedArray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of a list column its row's entry of ``row``, and the value; a null list has none."""
    lists = lists.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(row, lengths), lists.flatten().to_numpy(zero_copy_only=False)


def _places_of_keys(table: pa.Table, places: int) -> np.ndarray:
    """Number of each row's key, from 0, where rows of one key are neighbours; nulls are equal."""
    new = np.zeros(table.num_rows, dtype=np.int64)
    for column in table.columns[:places]:
        code = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def _whole_keys(batches: Iterator[pa.RecordBatch], places: int) -> Iterator[pa.Table]:
    """The batches, cut so that no key stands in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        row = _places_of_keys(table, places)
        last = int(np.searchsorted(row, row[-1]))
        held = table.slice(last).combine_chunks().to_batches()
        if last:
            yield table.slice(0, last)
    if held:
        yield pa.Table.from_batches(held)


def vector_search(topics: DataFrame, collection: DataFrame, key: Sequence[str], number: str, vector: str, weights: WordWeights, threshold: float, k: int, strict: bool = False) -> DataFrame:
    """Hits of distinct topic sentences by cosine: ``topic_rewritten``, the key, ``similarity, rank, num_matches``.

    ``collection`` has the key, a unique ``number`` that orders rows of equal similarity, and the vectors. This is the searcher that
    ``find_arguments`` takes in place of the text search.
    """
    asked = topics.select("topic_rewritten", F.xxhash64("topic_rewritten").alias("topic_id"))
    embedded = embed_counted(asked, ["topic_id", "topic_rewritten"], "topic_rewritten", weights, output="vector")
    asked = checkpointed(embedded, "topics")
    corpus = collection.select(F.col(number).alias("corpus_id"), F.col(vector).alias("vector"), *key)
    hits = cosine_top_k(asked.select("topic_id", "vector"), corpus, threshold=threshold, k=k, strict=strict, carried=key)
    hits = with_num_matches(hits, ["topic_id"])
    return hits.join(asked.select("topic_id", "topic_rewritten"), "topic_id").select("topic_rewritten", *key, "similarity", "rank", "num_matches")
