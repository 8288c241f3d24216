"""Best-matching sentence of a context for a piece of evidence."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disputatio.functions.text import once, plain_form, split_sentences


def edit_ratio(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; two empty texts are alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def best_sentence(query: Column, context: Column, score: Callable[[Column, Column], Column] = edit_ratio) -> Column:
    """``struct<score, back, sentence>`` of the context sentence nearest to the query.

    ``back`` is the negative position, so the first of equally near sentences wins. An empty query
    gets the first sentence, an empty context a null.
    """

    def pick(q: Column) -> Column:
        scored = F.transform(
            split_sentences(context),
            lambda s, i: F.struct(
                once(plain_form(s), lambda p: score(q["plain"], p)).alias("score"), (-i).alias("back"), s.alias("sentence")
            ),
        )
        return F.array_max(F.when(F.length(q["raw"]) == 0, F.slice(scored, 1, 1)).otherwise(scored))

    return once(F.struct(query.alias("raw"), plain_form(query).alias("plain")), pick)


def with_best_sentence(df: DataFrame, query: str, context: str, prefix: str = "best") -> DataFrame:
    """Add ``<prefix>_sentence``, ``<prefix>_pos`` and ``<prefix>_score``."""
    found = df.withColumn("_best", best_sentence(F.col(query), F.col(context)))
    return found.select(
        *df.columns,
        F.col("_best.sentence").alias(f"{prefix}_sentence"),
        (-F.col("_best.back")).alias(f"{prefix}_pos"),
        F.col("_best.score").alias(f"{prefix}_score"),
    )


CLOSEST = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("score", T.DoubleType())])

# In a sentence of so many characters, those that make up more than a hundredth of it (and one more) start no match.
LONG_SENTENCE = 200


def _cell_rows(sentence: str, wide: int) -> tuple[dict[str, bytes], bool]:
    """Per character the places of the sentence as bits, ``wide`` bytes each, and whether frequent ones were left out."""
    places: dict[str, int] = {}
    for j, c in enumerate(sentence):
        places[c] = places.get(c, 0) | 1 << j
    most = len(sentence) // 100 + 1 if len(sentence) >= LONG_SENTENCE else len(sentence)
    return {c: p.to_bytes(wide, "little") for c, p in places.items() if p.bit_count() <= most}, any(p.bit_count() > most for p in places.values())


def matched(query: str, sentence: str) -> int:
    """Characters in matching blocks: the longest common block, the first in the query and then in the sentence, and the same left and right of it.

    All pairs of equal characters are bits of one number, a row per character of the query. Shifted by a row and a place, it shows
    where a block goes on, so the longest block takes about twice the logarithm of its length in shifts. Equals the blocks of ``difflib``.
    """
    wide = len(sentence) // 8 + 1  # at least one bit stays free, so that no block runs into the next row
    step, total, empty = wide * 8 + 1, 0, bytes(wide)
    rows, left_out = _cell_rows(sentence, wide)
    cells = b"".join([rows.get(c, empty) for c in query])
    open_parts = [(0, len(query), 0, len(sentence))]
    while open_parts:
        alo, ahi, blo, bhi = open_parts.pop()
        inside = ((1 << bhi) - (1 << blo)).to_bytes(wide, "little") * (ahi - alo)
        runs = [int.from_bytes(cells[alo * wide : ahi * wide], "little") & int.from_bytes(inside, "little")]
        i, j, size = alo, blo, 0
        if runs[0]:
            # runs[n] has the starts of blocks of 2**n characters.
            while longer := runs[-1] & runs[-1] >> (step << (len(runs) - 1)):
                runs.append(longer)
            starts, size = runs[-1], 1 << (len(runs) - 1)
            for n in range(len(runs) - 2, -1, -1):
                if longer := starts & runs[n] >> (step * size):
                    starts, size = longer, size + (1 << n)
            at = (starts & -starts).bit_length() - 1
            i, j = alo + at // (wide * 8), at % (wide * 8)
        if left_out:
            while i > alo and j > blo and query[i - 1] == sentence[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and query[i + size] == sentence[j + size]:
                size += 1
        if size:
            total += size
            if i > alo and j > blo:
                open_parts.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                open_parts.append((i + size, ahi, j + size, bhi))
    return total


def closest(query: str, sentences: Sequence[str]) -> tuple[int | None, float | None]:
    """Place and ratio of the first of the sentences nearest to the query; those that cannot be nearer by the characters they share are not compared."""
    have, top, best = Counter(query), None, -1.0
    bounds = []
    for at, s in enumerate(sentences):
        whole = len(query) + len(s)
        bounds.append((-(2.0 * (have & Counter(s)).total() / whole if whole else 1.0), at))
    for bound, at in sorted(bounds):
        if -bound < best:
            break
        whole = len(query) + len(sentences[at])
        ratio = 2.0 * matched(query, sentences[at]) / whole if whole else 1.0
        if ratio > best or ratio == best and at < top:
            top, best = at, ratio
    return (None, None) if top is None else (top, best)


@F.pandas_udf(CLOSEST)
def _closest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for queries, lists in batches:
        found = [closest(query, sentences) for query, sentences in zip(queries, lists)]
        yield pd.DataFrame(found, columns=["pos", "score"]).astype({"pos": "Int32", "score": "float64"})


def with_best_sentence_by_ratio(df: DataFrame, query: str, context: str, prefix: str = "best") -> DataFrame:
    """Like :func:`with_best_sentence`, scored by matching blocks (Ratcliff-Obershelp)."""
    rows = df.withColumn("_sentences", split_sentences(F.col(context)))
    rows = rows.withColumn("_found", _closest(F.col(query), F.col("_sentences")))
    return rows.select(
        *df.columns,
        F.expr("try_element_at(_sentences, _found.pos + 1)").alias(f"{prefix}_sentence"),
        F.col("_found.pos").alias(f"{prefix}_pos"),
        F.col("_found.score").alias(f"{prefix}_score"),
    )
