"""Prompt templates, rendering and routing of prompts to models.

The templates are this project's own wording. Slots are written ``{slot}``; ``{{`` and ``}}`` stand
for single braces. Any template can be replaced by the caller's.
"""

from __future__ import annotations

from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMPTS: dict[str, str] = {
    "stance": (
        "Beurteile den Satz zum Thema. Antworte nur mit Pro, Contra oder Neutral.\n"
        "Thema: {topic_text}\nSatz: {text_sample}\nLabel: "
    ),
    "stance_with_reason": (
        "Beurteile, ob der Satz das Thema ausdrücklich stützt, ablehnt oder keins von beidem tut.\n"
        "Gib zuerst eine Begründung und am Ende das Label Pro, Contra oder Neutral.\n"
        "Thema: {topic_text}\nSatz: {text_sample}\n"
    ),
    "stance_few_shot": (
        "Ordne das Argument dem Thema zu: pro, contra oder neutral. Beispiele:\n{examples}"
        "Antworte für diesen Fall mit einem Wort.\nZu «{topic_text}» heisst es «{text_sample}»: "
    ),
    "is_argument": (
        "Bezieht der Satz Stellung zum Thema, dafür oder dagegen? Antworte mit Ja oder Nein.\n"
        "Thema: {topic_text}\nSatz: {text_sample}\n"
    ),
    "is_debatable": "Lässt sich über die Aussage streiten? Antworte mit Ja oder Nein.\nAussage: {text}\n",
    "rewrite": (
        "Formuliere den Satz so um, dass er ohne Kontext verständlich ist. Erkläre vor allem: {ambiguous_words}.\n"
        "Erfinde nichts und gib nur den neuen Satz zurück.\nSatz: {sentence}\nKontext: {context}\n"
    ),
    "evidence": (
        "Suche im Kontext die Stelle, die eine {stance}-Haltung zur Aussage am besten begründet.\n"
        'Antworte als JSON: {{"reasoning_segment": "Stelle im Wortlaut", "reasoning": "kurze Begründung"}}.\n'
        "Findet sich nichts, bleiben beide Felder leer.\nAussage: {topic}\nKontext: {context}\n"
    ),
    "evidence_for_claim": (
        "Der Auszug nimmt eine {stance}-Haltung zur Aussage ein. Suche im Kontext die Begründung dafür.\n"
        'Antworte als JSON: {{"reasoning_segment": "Stelle im Wortlaut", "reasoning": "kurze Begründung"}}.\n'
        "Aussage: {topic}\nAuszug: {claim}\nKontext: {context}\n"
    ),
    "speaker": (
        "Wer sagt den Satz? Antworte als JSON und lass Unbekanntes leer:\n"
        '{{"person": "Name", "party": "Partei", "canton": "Kanton"}}\nSatz: {sentence}\nKontext: {context}\n'
    ),
    "segments": (
        "Teile den Text in Abschnitte, die je ein Argument enthalten.\n"
        'Antworte als Liste: [{{"segment": "Abschnitt"}}]\nText: {argument_text}\n'
    ),
    "arguments": (
        "Nenne alle Pro- und Contra-Argumente des Textes zum Thema im Wortlaut.\n"
        "Thema: {topic_text}\nText: {argument_text}\n"
    ),
    "argument_list": (
        'Schreibe die Übersicht als Liste: [{{"argument": "Wortlaut", "stance": "Pro oder Contra"}}]\n'
        "Übersicht: {overview}\n"
    ),
    "main_points": "Nenne die wichtigsten Punkte des Textes als Liste.\nText: {text}\n",
    "translate": "Übersetze ins Deutsche und gib nur die Übersetzung zurück.\nText: {text}\n",
}

FEW_SHOT_EXAMPLE = "- Zu «{thema}» heisst es «{argument}»: {label}\n"

# Chat templates of models that need one.
CHAT_TEMPLATES = {
    "inst": "<s> [INST] {prompt} [/INST]",
    "marker": "<|input|>\n{prompt}<|output|>\n",
    "header": "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n{prompt}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n",
}

# Default generation parameters.
GENERATION_PARAMETERS = {"max_tokens": 4096.0, "temperature": 0.0, "repetition_penalty": 1.1}


def render_prompt(template: str, slots: Mapping[str, Column]) -> Column:
    """Fill the slots of a template.

    The template is taken apart first, so braces inside inserted text are left alone.
    """
    parts: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if field not in slots:
                raise ValueError(f"no value for slot {field!r}")
            parts.append(F.coalesce(slots[field].cast("string"), F.lit("")))
    return F.concat(*parts)


def fill_template_column(template: Column, slot: str, value: Column) -> Column:
    """Fill one slot of a template that is itself a column."""
    return F.replace(template, F.lit("{" + slot + "}"), value)


def few_shot_examples(examples: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One row with all examples as text, in a repeatable shuffled order: by the hash of seed and key.

    All examples go into one prompt; the caller chooses those that fit one.
    """
    text = render_prompt(FEW_SHOT_EXAMPLE, {n: F.col(n) for n in ("thema", "argument", "label")})
    order = F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))
    rows = examples.select(F.struct(order.alias("o"), F.col(key).alias("k"), text.alias("t")).alias("e"))
    merged = rows.agg(F.array_sort(F.collect_list("e")).alias("es"))
    return merged.select(F.array_join(F.transform("es", lambda e: e["t"]), "").alias("examples"))


def client_parameters(client: Column, parameters: Mapping[str, float] = GENERATION_PARAMETERS) -> Column:
    """Generation parameters under the names a client understands.

    Local pipelines call the token limit ``max_new_tokens``; one hosted client has no repetition penalty.
    """
    given = F.create_map(*[F.lit(x) for kv in parameters.items() for x in kv])
    renamed = F.transform_keys(
        given,
        lambda k, _: F.when(client.isin("transformers", "vi") & (k == "max_tokens"), "max_new_tokens").otherwise(k),
    )
    return F.map_filter(renamed, lambda k, _: ~((client == "openai") & (k == "repetition_penalty")))


def route_prompts(prompts: DataFrame, registry: DataFrame, model: str = "model", prompt: str = "prompt") -> DataFrame:
    """Attach client, parameters and chat template to each prompt.

    ``registry(model, client, template)`` is a short list of models and is left to Spark to broadcast
    by its size. Hosted clients get the bare prompt.
    """
    templates = F.create_map(*[F.lit(x) for kv in CHAT_TEMPLATES.items() for x in kv])
    rows = prompts.join(registry.withColumnRenamed("model", model), model, "left")
    template = F.when(F.col("client").isin("together", "openai"), None).otherwise(templates[F.col("template")])
    filled = F.when(template.isNull(), F.col(prompt)).otherwise(fill_template_column(template, "prompt", F.col(prompt)))
    return rows.withColumns({"final_prompt": filled, "parameters": client_parameters(F.col("client"))})
