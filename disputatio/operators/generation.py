"""Batch text generation: every distinct prompt goes to a user-supplied function once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputatio.functions.parsing import parse_dict_list
from disputatio.functions.prompts import PROMPTS, render_prompt
from disputatio.functions.text import capitalize_first
from disputatio.session import checkpointed

# Called once per task; returns the function that answers a batch of prompts.
ModelFactory = Callable[[], Callable[[pd.Series], pd.Series]]


def batch_generate(
    df: DataFrame, prompt: str, model: ModelFactory, output: str = "generation", keep: bool = False, tasks: int | None = None
) -> DataFrame:
    """Add a model's answer to the prompt column of each row.

    Equal prompts are merged before the model sees them, so a prompt shared by many rows costs one
    call and one row of the shuffle. Answers come back by the prompt's hash. ``keep`` writes the answers
    to the shared folder, so that a lost task never calls a costly model again. Spark sizes tasks by bytes;
    ``tasks`` sets their number where the model, not the text, is the cost.
    """
    hashed = df.withColumn("_prompt_id", F.sha2(F.col(prompt), 256))
    unique = hashed.where(F.col(prompt).isNotNull()).select("_prompt_id", F.col(prompt).alias("_prompt")).distinct()
    if tasks is not None:
        unique = unique.repartition(tasks, "_prompt_id")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = model()
        for batch in batches:
            yield pd.DataFrame({"_prompt_id": batch["_prompt_id"], output: generate(batch["_prompt"])})

    answers = unique.mapInPandas(answer, f"_prompt_id string, `{output}` string")
    if keep:
        answers = checkpointed(answers, "answers")
    return hashed.join(answers, "_prompt_id", "left").drop("_prompt_id")


def generate_from_template(
    df: DataFrame, template: str, slots: Mapping[str, Column], model: ModelFactory, output: str = "generation", keep: bool = False
) -> DataFrame:
    """Render a prompt per row, generate, and drop the prompt again."""
    prompts = df.withColumn("_rendered", render_prompt(template, slots))
    return batch_generate(prompts, "_rendered", model, output, keep).drop("_rendered")


def rewrite_sentences(prepared: DataFrame, model: ModelFactory, template: str = PROMPTS["rewrite"]) -> DataFrame:
    """Let a model write the missing ``new_sentence`` values of ``prepare_sentences(method="llm")``.

    Only the sentences a model has to write are shuffled. Where it answers nothing, the sentence stays as it was.
    """
    slots = {
        "sentence": F.col("original_sentence"),
        "context": F.col("prompt_context"),
        "ambiguous_words": F.col("ambiguous_words"),
    }
    todo = prepared.where(F.col("new_sentence").isNull()).withColumn("_todo", render_prompt(template, slots))
    done = batch_generate(todo, "_todo", model, "_written").withColumn("new_sentence", F.coalesce("_written", "original_sentence"))
    written = prepared.where(F.col("new_sentence").isNotNull()).unionByName(done.drop("_todo", "_written"))
    return written.drop("ambiguous_words", "prompt_context")


def translate_columns(
    df: DataFrame, columns: Mapping[str, str], model: ModelFactory, capitalize: Sequence[str] = ()
) -> DataFrame:
    """Capitalise the named columns, then add a translation of each source column."""
    out = df.withColumns({c: capitalize_first(F.col(c)) for c in capitalize}) if capitalize else df
    for source, target in columns.items():
        out = generate_from_template(out, PROMPTS["translate"], {"text": F.col(source)}, model, target)
    return out


def explode_segments(df: DataFrame, keys: Sequence[str], generation: str) -> DataFrame:
    """One row per object of a generated list, as a map of its fields."""
    return df.select(*keys, F.posexplode(parse_dict_list(F.col(generation))).alias("segment_no", "fields"))
