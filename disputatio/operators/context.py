"""Sentence tables: sentences with neighbourhood contexts and rewritten text.

A document is one row, so its sentences and their windows are built with array functions on that
row. No shuffle is needed, and a source holding a third of all documents changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputatio.functions.lexicons import AMBIGUOUS_WORDS, Lexicon, in_lexicon
from disputatio.functions.parsing import mentions_carried
from disputatio.functions.text import CASED_WORD, split_sentences

# Sentences taken before a sentence; one fewer (itself included) is taken from it on.
GENERAL_RADIUS = 5
REWRITE_RADIUS = 2
PROMPT_RADIUS = 20


def neighbours(sentences: Column, position: Column, radius: int, exact: bool = False) -> Column:
    """Sentences ``position - radius`` to ``position + radius - 1``, joined by a blank.

    The window is cut at both ends of the document. ``exact`` gives the list-slice form, in which a
    negative start counts from the document's end, so early sentences of a long document get nothing.
    """
    size = F.size(sentences)
    start = F.greatest(position - radius, F.lit(0))
    if exact:
        start = F.when(position >= radius, position - radius).otherwise(
            F.greatest(size + position - radius, F.lit(0))
        )
    end = F.least(position + radius, size)
    return F.array_join(F.slice(sentences, start + 1, F.greatest(end - start, F.lit(0))), " ")


def ambiguous_words(sentence: Column, lang: Column, lexicon: Lexicon = AMBIGUOUS_WORDS) -> Column:
    """Distinct words of the sentence that are in the lexicon, in order of appearance."""
    found = F.filter(_cased_words(sentence), lambda w: in_lexicon(lexicon, lang, F.lower(w)))
    return F.array_distinct(found)


def is_ambiguous(sentence: Column, lang: Column, lexicon: Lexicon = AMBIGUOUS_WORDS) -> Column:
    """Whether any word of the sentence is in the lexicon."""
    return F.exists(_cased_words(sentence), lambda w: in_lexicon(lexicon, lang, F.lower(w)))


def _cased_words(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(CASED_WORD), F.lit(0))


def explode_sentences(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per sentence: the keys, ``sent_id`` (from 0) and ``sentence``."""
    rows = df.select(*keys, F.posexplode_outer(split_sentences(F.col(text))).alias("sent_id", "sentence"))
    return rows.where(F.col("sent_id").isNotNull())


def _unpack(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per element of ``_rows``.

    The outer form is meant: for the plain one Spark adds a filter on the array's size, which computes
    the whole array a second time and, below the projections, all sentences once per sentence.
    """
    out = rows.select(*keys, F.inline_outer("_rows"))
    return out.where(F.col("sent_id").isNotNull())


def sentence_contexts(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    radius: int = GENERAL_RADIUS,
    exact: bool = False,
    output: str = "context",
) -> DataFrame:
    """One row per sentence with its neighbourhood."""
    lists = df.select(*keys, split_sentences(F.col(text)).alias("_sentences"))
    rows = lists.select(
        *keys,
        F.transform(
            F.col("_sentences"),
            lambda s, i: F.struct(
                i.alias("sent_id"),
                s.alias("sentence"),
                neighbours(F.col("_sentences"), i, radius, exact).alias(output),
            ),
        ).alias("_rows"),
    )
    return _unpack(rows, keys)


def prepare_sentences(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    lang: str | None = "lang",
    method: str | None = "context",
    force: bool = False,
    exact: bool = False,
    lexicon: Lexicon = AMBIGUOUS_WORDS,
    speakers: bool = False,
) -> DataFrame:
    """Sentences with rewritten text and general context.

    ``speakers`` adds ``mention``, the last mention of a speaker in the document up to the sentence.

    Output: the keys, ``sent_id, original_sentence, new_sentence, context``; with ``method="llm"``
    also ``ambiguous_words`` and ``prompt_context``, the inputs of the rewriting prompt, and
    ``new_sentence`` is null where a model still has to write it.

    ``method="context"`` replaces an ambiguous sentence by its close neighbourhood, ``None`` keeps
    every sentence. ``force`` treats all sentences as ambiguous.
    """
    if method not in ("context", "llm", None):
        raise ValueError(f"unknown rewriting method {method!r}; choose 'llm', 'context' or None")
    language = F.col(lang) if lang else F.lit(None).cast("string")
    lists = df.select(*keys, language.alias("_lang"), split_sentences(F.col(text)).alias("_sentences"))
    sentences = F.col("_sentences")

    def row(s: Column, i: Column) -> Column:
        fields = [i.alias("sent_id"), s.alias("original_sentence")]
        rewrite = F.lit(True) if force else is_ambiguous(s, F.col("_lang"), lexicon)
        if method is None:
            fields.append(s.alias("new_sentence"))
        elif method == "context":
            close = neighbours(sentences, i, REWRITE_RADIUS, exact)
            fields.append(F.when(rewrite, close).otherwise(s).alias("new_sentence"))
        else:
            fields.append(F.when(~rewrite, s).alias("new_sentence"))
            found = ambiguous_words(s, F.col("_lang"), lexicon)
            fields.append(F.array_join(found, ", ").alias("ambiguous_words"))
            fields.append(F.when(rewrite, neighbours(sentences, i, PROMPT_RADIUS, exact)).alias("prompt_context"))
        if speakers:
            fields.append(F.get("_mentions", i).alias("mention"))
        return F.struct(*fields)

    if speakers:
        lists = lists.withColumn("_mentions", mentions_carried(sentences))
    rows = lists.select(*keys, "_sentences", F.transform(sentences, row).alias("_rows"))
    out = _unpack(rows, [*keys, "_sentences"])
    # The context stands above the generator, so a plan that does not read it does not make it either.
    context = neighbours(sentences, F.col("sent_id"), GENERAL_RADIUS, exact).alias("context")
    names = [c for c in out.columns if c not in (*keys, "_sentences", "mention")]
    return out.select(*keys, *names, context, *(["mention"] if speakers else []))
