"""Rendering a dialogue once from the view of each of its speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    r"""Text that holds no marker, however markers are nested in it: ``<|`` becomes ``<\|``, ``<\|`` becomes ``<\\|`` and so on.

    ``unescaped`` gives the text back; null is empty.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _one_line(name: Column) -> Column:
    """An escaped name whose line breaks are spaces, so that it cannot end its own line."""
    return F.regexp_replace(escaped(name), r"[\x0A-\x0D\x{85}\x{2028}\x{2029}]", " ")


def rotate_perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = "system", block: int = 64
) -> DataFrame:
    """One row per conversation, participant and block of turns: the dialogue with that participant as assistant.

    Other speakers become users that carry their name; system turns stay system turns. ``mask`` lists the
    spans (code points, end exclusive) a model is trained on: the participant's own words with their end marker.
    Columns: ``conv_id, speaker, block, n_turns, rendered, mask``.

    Turns go by number, then speaker, then text. A conversation is rendered in blocks of ``block`` turn numbers, so
    one of any length never gathers in one task. Every block is rendered for every participant of the whole conversation.
    A null speaker is a participant without a name, a null turn number counts as 0, null text is empty, repeated
    rows are repeated turns. Markers inside texts and names are escaped, line breaks in a rendered name are spaces; the
    ``speaker`` column keeps the name as it was. A conversation of system turns alone has no participant and no row.
    """
    name = F.coalesce(F.col(speaker), F.lit(""))
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.floor(F.coalesce(F.col(turn), F.lit(0)) / block).cast("long").alias("block"),
        F.struct(F.coalesce(F.col(turn), F.lit(0)).cast("long").alias("turn"), name.alias("who"), escaped(F.col(text)).alias("said")).alias("line"),
    )
    talks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    people = rows.select("conv_id", F.col("line.who").alias("speaker")).where(F.col("speaker") != system).distinct()
    seen = talks.join(people, talks["conv_id"].eqNullSafe(people["conv_id"])).drop(people["conv_id"])

    def piece(x: Column) -> Column:
        own = x["who"] == F.col("speaker")
        head = F.when(own, F.lit("assistant")).when(x["who"] == system, F.lit(system)).otherwise(F.concat(F.lit("user name="), _one_line(x["who"])))
        return F.struct(own.alias("own"), F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"), F.concat(x["said"], F.lit(CLOSE)).alias("body"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        spans = F.when(x["own"], F.concat(acc["spans"], F.array(F.concat_ws(":", begin, end)))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    pieces = F.transform("lines", piece)
    return seen.withColumn("pieces", pieces).select(
        "conv_id",
        "speaker",
        "block",
        F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.aggregate("pieces", start, add)["spans"], ",").alias("mask"),
    )
