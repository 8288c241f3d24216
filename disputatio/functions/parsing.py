"""Reading structured answers and speaker mentions out of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from disputatio.functions.text import once

# Fixed value: "Anna Muster (G, ZH)", a person followed by party and canton.
SPEAKER = r"(\p{Lu}[\p{L}-]+ \p{Lu}[\p{L}-]+) \(([\p{L}-]+), ?([A-Z]{2})\)"
SPEAKER_FIELDS = ("person", "party", "canton")


# Quoted strings with escapes, and what may stand in a flat list or object: strings are taken whole, brackets inside them do not count.
QUOTED = r""""(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'"""
FLAT_LIST = rf"""\[((?:[^\[\]"']++|{QUOTED})*+)\]"""
FLAT_OBJECT = rf"""\{{(?:[^{{}}"']++|{QUOTED})*+\}}"""


def parse_dict_list(generation: Column) -> Column:
    """Objects of the first flat list in a model answer, as ``array<map<string,string>>``.

    An answer without a list is searched for objects itself. Code fences are left out, words hyphenated at a line end are
    joined, null values are empty strings. What is not an object is left out; an answer without any gives an empty array.
    """
    line = F.translate(F.replace(F.replace(generation, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" ")), "`", "")
    found = F.regexp_extract(line, FLAT_LIST, 1)
    objects = F.regexp_extract_all(F.when(found == "", line).otherwise(found), F.lit(FLAT_OBJECT), F.lit(0))
    parsed = F.filter(F.transform(objects, lambda o: F.from_json(o, "map<string,string>")), lambda m: m.isNotNull())
    filled = F.transform(parsed, lambda m: F.transform_values(m, lambda _, v: F.coalesce(v, F.lit(""))))
    return F.coalesce(filled, F.array().cast("array<map<string,string>>"))


def parse_fields(generation: Column, fields: Sequence[str]) -> Column:
    """Struct of the named string fields of a JSON answer; whatever is missing is an empty string."""
    schema = ", ".join(f"{name} string" for name in fields)
    parsed = F.from_json(generation, schema)
    return F.struct(*[F.coalesce(parsed[name], F.lit("")).alias(name) for name in fields])


def parse_evidence(generation: Column) -> Column:
    """Answer of the evidence step."""
    return parse_fields(generation, ("reasoning_segment", "reasoning"))


def _last_mention(text: Column) -> Column:
    """The last mention of a speaker in a text, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(SPEAKER), F.lit(0)), F.lit(-1))


def mention_fields(mention: Column) -> Column:
    """``person, party, canton`` of a mention; empty fields of an empty or missing one."""
    who = F.coalesce(mention, F.lit(""))
    return F.struct(*[F.regexp_extract(who, SPEAKER, i + 1).alias(n) for i, n in enumerate(SPEAKER_FIELDS)])


def speaker(sentence: Column, context: Column) -> Column:
    """Speaker named in the sentence, or else the last one named before it in its context.

    What the context says after the sentence does not count; a context that does not hold the sentence is taken to stand before
    it. The result has empty fields where nobody is named.
    """
    at = F.instr(context, sentence)
    before = F.when(at > 0, F.substring(context, 1, at - 1)).otherwise(context)
    return mention_fields(F.coalesce(_last_mention(sentence), _last_mention(before)))


def mentions_carried(sentences: Column) -> Column:
    """For every sentence of a document the last mention in it or any sentence before it; empty strings where there is none.

    Mentions are searched once per document; for each sentence only the sentences that name somebody are looked through.
    """
    mentions = F.filter(F.transform(sentences, lambda s, i: F.struct(i.alias("at"), _last_mention(s).alias("who"))), lambda m: m["who"].isNotNull())

    def last(named: Column) -> Column:
        return F.transform(sentences, lambda _, i: F.coalesce(F.array_max(F.filter(named, lambda m: m["at"] <= i))["who"], F.lit("")))

    return once(mentions, last)
