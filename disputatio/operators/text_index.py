"""A saved inverted index of sentences: written once, extended by new sentences, searched without reading their texts.

Two bucketed tables: ``postings`` (by token) and ``sets`` (by key). A search finds candidates in the postings of its rare words
and compares word sets; texts are read for the hits only. Both are written where their rows are made: each task writes its own
files of each bucket, so building moves nothing. A posting is the key, the size of the set and the word's place, and no more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disputatio.functions.text import WORD, words
from disputatio.operators.ranking import top_k_per_group
from disputatio.operators.similarity import BROADCAST_BYTES, SEARCH_DEPTH, SLACK, above, overlap_similarity, with_num_matches
from disputatio.session import checkpointed, discard, measure, work_dir

# Words in more than one of so many sentences are common; the sum of all set sizes bounds their number to a hundred times the mean size.
TIERS = (100, 30, 10)


@dataclass
class TextIndex:
    """``least`` is the lowest threshold it can be searched with, ``tiers`` the common words, rarest tier first.

    A set is kept as its words with blanks between, which takes less room than a list of them.
    """

    postings: DataFrame
    sets: DataFrame
    key: list[str]
    least: float
    tiers: list[list[str]]
    buckets: int


def common_words(corpus: DataFrame, text: str) -> list[list[str]]:
    """Words by document frequency, in tiers; all others are rare."""
    # A null stands for the sentence itself, so one pass counts both.
    found = F.coalesce(F.array_distinct(words(F.col(text))), F.array().cast("array<string>"))
    tokens = corpus.select(F.explode(F.array_append(found, F.lit(None).cast("string"))).alias("token"))
    counts = checkpointed(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "word_counts")
    rows = measure(counts.where("token IS NULL"), F.coalesce(F.sum("df"), F.lit(0)).alias("n"))["n"]
    counts = counts.where(F.col("token").isNotNull() & (F.col("df") * TIERS[0] > rows)).collect()
    return [sorted(r.token for r in counts if r.df * t > rows and (n + 1 == len(TIERS) or r.df * TIERS[n + 1] <= rows)) for n, t in enumerate(TIERS)]


def rare_first(text: Column, tiers: Sequence[Sequence[str]]) -> Column:
    """Distinct words of a text, rare ones first, within a tier longest first. The order is one for all texts and stays as it is when the index grows."""

    def tier(w: Column) -> Column:
        out = F.lit(0)
        for n, listed in enumerate(tiers):
            out = F.when(w.isin(list(listed)), n + 1).otherwise(out) if listed else out
        return out

    keyed = F.transform(F.array_distinct(words(text)), lambda w: F.struct(tier(w).alias("tier"), (-F.length(w)).alias("l"), w.alias("w")))
    return F.coalesce(F.transform(F.sort_array(keyed), lambda x: x["w"]), F.array().cast("array<string>"))


def _prefix_size(size: Column, threshold: float) -> Column:
    return size - F.ceil(size * threshold - SLACK).cast("int") + 1


@contextmanager
def _rows(corpus: DataFrame, key: Sequence[str], text: str, least: float, tiers: Sequence[Sequence[str]]) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Sets and postings of the sentences. The sets are made once, kept while the block writes both, and then deleted."""
    # The test on the text stands for one on the set, which Spark would compute once more for it.
    with_words = corpus.where(F.lower(F.col(text)).rlike(WORD))
    kept = work_dir(corpus.sparkSession, "sets")
    sets = checkpointed(with_words.select(*key, rare_first(F.col(text), tiers).alias("tokens")), path=kept)
    leading = F.slice("tokens", 1, _prefix_size(F.size("tokens"), least))
    # Sets are small and take fewer, larger files than the postings, which each task has to sort.
    fewer = max(corpus.sparkSession.sparkContext.defaultParallelism, sets.rdd.getNumPartitions() // 4)
    try:
        yield sets.withColumn("tokens", F.array_join("tokens", " ")).coalesce(fewer), sets.select(*key, F.size("tokens").alias("size"), F.posexplode_outer(leading).alias("place", "token"))
    finally:
        discard(corpus.sparkSession, kept)


def build_text_index(corpus: DataFrame, key: Sequence[str], text: str, name: str, path: str, least: float = 0.2, buckets: int = 64) -> TextIndex:
    """Write the tables ``{name}_postings``, ``{name}_sets`` and ``{name}_order`` below ``path``.

    One pass counts words, one orders each sentence's own set in place; a task writes its rows to its own files of the buckets.
    Sentences without a word are left out, as no search can find them. ``key`` is unique; null texts have no words.
    """
    if least <= 0:
        raise ValueError("the index needs a least threshold above 0")
    spark = corpus.sparkSession
    tiers = common_words(corpus, text)
    order = [(n, least, words) for n, words in enumerate(tiers)]
    spark.createDataFrame(order, "tier int, least double, words array<string>").coalesce(1).write.option("path", f"{path}/order").saveAsTable(f"{name}_order")
    with _rows(corpus, key, text, least, tiers) as (sets, postings):
        for part, rows, by in (("postings", postings, ["token"]), ("sets", sets, list(key))):
            packed = rows.write.option("compression", "zstd").option("path", f"{path}/{part}")
            packed.bucketBy(buckets, *by).sortBy(*dict.fromkeys([*by, *key])).saveAsTable(f"{name}_{part}")
    return open_text_index(spark, name, key)


def open_text_index(spark: SparkSession, name: str, key: Sequence[str]) -> TextIndex:
    order = spark.table(f"{name}_order").orderBy("tier").collect()
    described = spark.sql(f"DESCRIBE EXTENDED {name}_sets").collect()
    buckets = next(int(r.data_type) for r in described if r.col_name == "Num Buckets")
    return TextIndex(spark.table(f"{name}_postings"), spark.table(f"{name}_sets"), list(key), order[0].least, [r.words for r in order], buckets)


def extend_text_index(spark: SparkSession, name: str, corpus: DataFrame, key: Sequence[str], text: str) -> TextIndex:
    """Add the sentences whose key is not there yet. Words keep the order of the first build, so old and new rows fit together."""
    index = open_text_index(spark, name, key)
    # Only keys move to be compared; texts stay unless more keys are known than can be broadcast.
    known = checkpointed(corpus.select(*key).join(index.sets.select(*key), list(key), "left_semi"), "known")
    few = known.count() * 16 * len(key) <= BROADCAST_BYTES
    fresh = corpus.join(F.broadcast(known) if few else known, list(key), "left_anti")
    with _rows(fresh, key, text, index.least, index.tiers) as (sets, postings):
        postings.select(*index.postings.columns).write.insertInto(f"{name}_postings")
        sets.select(*index.sets.columns).write.insertInto(f"{name}_sets")
    spark.catalog.refreshTable(f"{name}_postings")
    spark.catalog.refreshTable(f"{name}_sets")
    return open_text_index(spark, name, key)


def indexed_top_k(
    topics: DataFrame, index: TextIndex, *, topic: str, threshold: float, k: int = SEARCH_DEPTH, strict: bool = False, broadcast_bytes: int = BROADCAST_BYTES, two_level: bool | None = None
) -> DataFrame:
    """Top-k sentences per topic text by Jaccard similarity of word sets, from the index: topic, key, ``similarity, rank, num_matches``.

    Two sets that reach the threshold share one of their first words in the index's order, and from the first word they share
    on each has as many words left as the pair needs in common. A posting tells a sentence's size and the word's place; what
    they leave of the pairs is compared by the word sets. The topics' rows are broadcast within a checked size; the postings then do not move at all.
    """
    if threshold < index.least - SLACK:
        raise ValueError(f"the index was built for thresholds from {index.least}")
    asked = topics.select(F.col(topic), rare_first(F.col(topic), index.tiers).alias("_t")).where(F.size("_t") > 0)
    # Pairs are grouped by a topic's number, written with it, and not by its text.
    asked = checkpointed(asked.withColumns({"_n": F.size("_t"), "_topic": F.monotonically_increasing_id()}), "topics")
    weight = _prefix_size(F.col("_n"), threshold).cast("long") * (F.octet_length(topic) + 64)
    total = measure(asked, F.coalesce(F.sum(weight), F.lit(0)).alias("n"))["n"]
    wanted = asked.select("_topic", "_n", F.posexplode_outer(F.slice("_t", 1, _prefix_size(F.col("_n"), threshold))).alias("_at", "token"))
    leading = index.postings.where(F.col("place") < _prefix_size(F.col("size"), threshold))
    met = leading.join(F.broadcast(wanted) if total <= broadcast_bytes else wanted, "token")
    n, m = F.col("size"), F.col("_n")
    needed = (n + m) * (threshold / (1 + threshold)) - SLACK
    # A pair that reaches the threshold passes at the first word it shares; where it fails there it fails at all later ones.
    possible = (m >= n * threshold - SLACK) & (n >= m * threshold - SLACK) & (F.least(n - F.col("place"), m - F.col("_at")) >= needed)
    # Pairs go to their sentence's bucket at once, where they meet the sets.
    pairs = met.where(possible).select("_topic", *index.key, "size").repartition(index.buckets, *index.key).distinct().drop("size")
    sets = index.sets.select(*index.key, F.split("tokens", " ").alias("tokens"))
    found = pairs.join(sets, index.key).join(asked.select("_topic", topic, "_t"), "_topic")
    similarity = overlap_similarity(F.col("tokens"), F.col("_t"))
    hits = found.withColumn("similarity", similarity).where(above(F.col("similarity"), threshold, strict)).select(topic, *index.key, "similarity")
    best = [F.col("similarity").desc(), *[F.col(c) for c in index.key]]
    return with_num_matches(top_k_per_group(hits, [topic], best, k, "rank", two_level), [topic])
