"""Queries on prompts, batch generation, answers and evidence.

The models here are small rules, so that SQL can follow them; a real one is passed in the same way.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import TEST_CONTRA, TEST_PRO, sql_edit_ratio, sql_list, sql_plain, sql_sentence_list, spread_table, table
from disputatio.functions.parsing import parse_dict_list, parse_evidence
from disputatio.functions.prompts import (
    PROMPTS,
    few_shot_examples,
    render_prompt,
    route_prompts,
)
from disputatio.operators.evidence import with_best_sentence, with_best_sentence_by_ratio
from disputatio.operators.generation import batch_generate, explode_segments, generate_from_template, translate_columns
from disputatio.operators.stance import says_yes, stance_from_generation
from disputatio.plans.evaluation import evaluate_evidence, extract_evidence

# Models with their client and chat template.
MODEL_REGISTRY = [
    ("microsoft/Phi-3-mini-128k-instruct", "vllm", None),
    ("numind/NuExtract-large", "vllm", None),
    ("VAGOsolutions/SauerkrautLM-Mixtral-8x7B-Instruct", "transformers", "inst"),
    ("VAGOsolutions/Llama-3.1-SauerkrautLM-70b-Instruct", "transformers", "header"),
    ("microsoft/Phi-3-vision-128k-instruct", "vi", None),
    ("meta-llama/Meta-Llama-3.1-8B-Instruct-Turbo", "together", None),
    ("gpt-4o-2024-08-06", "openai", None),
]


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the one that follows it in the conversation; the last one is followed by itself."""
    rows = spread_table(spark, sf_dir, "conversations")
    following = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("_next"))
    pairs = rows.select("conv_id", "turn", F.col("text").alias("question")).join(following, ["conv_id", "turn"], "left")
    return pairs.select("conv_id", "turn", "question", F.coalesce("_next", "question").alias("answer"))


def q_render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = {"topic_text": F.col("question"), "text_sample": F.col("answer")}
    return exchanges(spark, sf_dir).select("conv_id", "turn", render_prompt(PROMPTS["stance"], slots).alias("prompt"))


def registry(spark: SparkSession) -> DataFrame:
    names = ("model", "client", "template")
    return spark.createDataFrame(pa.table({n: pa.array([m[i] for m in MODEL_REGISTRY], pa.string()) for i, n in enumerate(names)}))


def q_prompt_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.array(*[F.lit(m) for m, _, _ in MODEL_REGISTRY])
    number = (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(MODEL_REGISTRY))) + 1).cast("int")
    prompts = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(models, number).alias("model"), F.col("text").alias("prompt"))
    routed = route_prompts(prompts, registry(spark))
    shown = F.transform(F.array_sort(F.map_entries("parameters")), lambda e: F.format_string("%s=%.1f", e["key"], e["value"]))
    return routed.select("conv_id", "turn", "model", "client", "final_prompt", F.array_join(shown, ";").alias("parameters"))


def q_fewshot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations, a fixed list of 25, serve as examples; every benchmark text gets its prompt."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    label = F.element_at(F.array(F.lit("pro"), F.lit("contra"), F.lit("neutral")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    examples = few_shot_examples(rows.select("n_nationkey", F.col("r_name").alias("thema"), F.col("n_name").alias("argument"), label.alias("label")), "n_nationkey")
    items = spread_table(spark, sf_dir, "benchmark")
    slots = {"examples": examples.scalar(), "topic_text": F.concat(F.lit("Text "), "item_id"), "text_sample": F.col("text")}
    return items.select("item_id", render_prompt(PROMPTS["stance_few_shot"], slots).alias("prompt"))


def cue_model():
    """Answers Pro or Contra by the cue words of the prompt's last part, with some talk around the label."""
    pro = {w for ws in TEST_PRO.values() for w in ws}
    contra = {w for ws in TEST_CONTRA.values() for w in ws}

    def answer(prompt: str) -> str:
        found = re.findall(r"[^\W\d_]+", prompt.split("Satz: ")[-1].lower())
        p, c = sum(w in pro for w in found), sum(w in contra for w in found)
        return "Pro, weil es so ist" if p > c else "Das Label lautet: Contra" if c > p else "Keins von beiden."

    return lambda prompts: prompts.map(answer)


def q_batch_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("Satz: "), "text").alias("prompt"))
    return batch_generate(rows, "prompt", cue_model).drop("prompt")


def q_classify_stance_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = {"topic_text": F.col("question"), "text_sample": F.regexp_replace("answer", "\\s+", " ")}
    template = PROMPTS["stance"].replace("Label: ", "")
    answered = generate_from_template(exchanges(spark, sf_dir), template, slots, cue_model)
    return answered.withColumn("stance", stance_from_generation(F.col("generation"))).select("conv_id", "turn", "stance.*")


def yes_no_model():
    """Says yes to every sentence with a cue word."""
    label = cue_model()
    return lambda prompts: label(prompts).map(lambda a: "Nein" if a.startswith("Keins") else " Ja\n")


def q_argument_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = {"topic_text": F.col("question"), "text_sample": F.col("answer")}
    answered = generate_from_template(exchanges(spark, sf_dir), PROMPTS["is_argument"], slots, yes_no_model)
    return answered.where(says_yes(F.col("generation"))).select("conv_id", "turn", "answer")


# Words of the built-in word-by-word translation.
GLOSSARY = {"the": "die", "and": "und", "with": "mit", "from": "aus", "for": "für", "that": "dass"}


def glossary_model():
    def translate(prompt: str) -> str:
        text = prompt.split("Text: ", 1)[1][:-1]
        for word, target in GLOSSARY.items():
            text = re.sub(rf"\b{word}\b", target, text, flags=re.ASCII)
        return text

    return lambda prompts: prompts.map(translate)


def q_translate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_table(spark, sf_dir, "benchmark").withColumn("text_EN", F.lower("text"))
    return translate_columns(rows, {"text_EN": "text_DE"}, glossary_model, ["text_EN"]).drop("text")


def segment_model():
    """One segment per line of the text, letters only, inside a fenced list."""

    def answer(prompt: str) -> str:
        lines = prompt.split("Text: ", 1)[1][:-1].split("\n")
        objects = [json.dumps({"segment": re.sub("[^a-zà-ÿ ]", "", line.lower()), "stance": None}, ensure_ascii=False) for line in lines]
        return "Hier die Liste:\n```[" + ",\n".join(objects) + "]```"

    return lambda prompts: prompts.map(answer)


def q_segment_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    answered = generate_from_template(rows, PROMPTS["segments"], {"argument_text": F.col("text")}, segment_model)
    parts = explode_segments(answered, ["conv_id", "turn"], "generation")
    return parts.select("conv_id", "turn", "segment_no", F.col("fields")["segment"].alias("segment"), F.col("fields")["stance"].alias("stance"))


def q_parse_dict_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made from events: single and double quotes, a null, a broken line, a text item to be dropped."""
    answer = F.concat(
        F.lit("Antwort:\n```["), F.col("props"), F.lit(",\n 'nur Text', {'event': '"), F.col("event_type"), F.lit("', 'va-\nlue': null}] ]```")
    )
    answer = F.when(F.col("event_id") % 5 == 0, F.col("props")).otherwise(answer)
    rows = spread_table(spark, sf_dir, "events").select("event_id", answer.alias("generation"))
    items = rows.select("event_id", F.posexplode(parse_dict_list(F.col("generation"))).alias("segment_no", "fields"))
    return items.select("event_id", "segment_no", *[F.col("fields")[k].alias(k) for k in ("k", "event", "value")])


def q_parse_evidence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("turn") % 4
    safe = F.regexp_replace(F.regexp_replace("text", '["\\\\\\\\]', ""), "\\s+", " ")
    answer = (
        F.when(kind == 0, F.concat(F.lit('{"reasoning_segment": "'), safe, F.lit('", "reasoning": "weil"}')))
        .when(kind == 1, F.concat(F.lit('{"reasoning": "'), safe, F.lit('"}')))
        .when(kind == 2, F.lit('{"reasoning_segment": null, "reasoning": null}'))
        .otherwise(safe)
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", parse_evidence(answer).alias("e"))
    return rows.select("conv_id", "turn", "e.*")


def evidence_model():
    """Names the last line of the context; says nothing readable for contexts of odd length."""

    def answer(prompt: str) -> str:
        context = prompt.split("Kontext: ", 1)[1][:-1]
        if len(context) % 2:
            return "Keine Begründung."
        return json.dumps({"reasoning_segment": context.split("\n")[-1], "reasoning": str(len(context))}, ensure_ascii=False)

    return lambda prompts: prompts.map(answer)


def q_extract_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = {"topic": F.lit("Thema"), "stance": F.lit("pro"), "context": F.col("answer")}
    rows = extract_evidence(exchanges(spark, sf_dir), slots, "answer", evidence_model)
    return rows.select("conv_id", "turn", "reasoning_segment", "reasoning")


def q_evaluate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exchanges(spark, sf_dir).select(
        "conv_id", "turn", F.lit("Thema").alias("Worum geht es?"), F.lit("Meinung").alias("Meinung"), F.col("answer").alias("Kontext"), F.lit("pro").alias("Haltung")
    )
    found = evaluate_evidence(
        rows, topic="Worum geht es?", claim="Meinung", context="Kontext", stance="Haltung", model=evidence_model, model_name="rule/last-line", prompt="evidence_for_claim"
    )
    return found.drop("Kontext")


def q_evidence_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_best_sentence(exchanges(spark, sf_dir), "question", "answer")
    return rows.select("conv_id", "turn", "best_sentence", "best_pos", F.round("best_score", 6).alias("best_score"))


def q_evidence_best_match_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_best_sentence_by_ratio(exchanges(spark, sf_dir), "question", "answer")
    return rows.select("conv_id", "turn", "best_sentence", "best_pos", F.round("best_score", 6).alias("best_score"))


# --- SQL ---------------------------------------------------------------------------------------


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_template(template: str, **slots: str) -> str:
    parts = []
    for piece in re.split(r"(\{\w+\})", template.replace("{{", "\x01").replace("}}", "\x02")):
        name = piece[1:-1]
        parts.append(slots[name] if piece.startswith("{") else sql_text(piece.replace("\x01", "{").replace("\x02", "}")))
    return " || ".join(p for p in parts if p != "''")


SQL_EXCHANGES = """WITH x AS (SELECT u.conv_id, u.turn, u.text AS question, coalesce(a.text, u.text) AS answer FROM conversations u LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"""
ALL_PRO = sorted({w for ws in TEST_PRO.values() for w in ws})
ALL_CONTRA = sorted({w for ws in TEST_CONTRA.values() for w in ws})


def sql_cue_answer(text: str) -> str:
    found = f"regexp_extract_all(lower({text}), '\\p{{L}}+')"
    p = f"len(list_filter({found}, lambda w: list_contains({sql_list(ALL_PRO)}, w)))"
    c = f"len(list_filter({found}, lambda w: list_contains({sql_list(ALL_CONTRA)}, w)))"
    return f"CASE WHEN {p} > {c} THEN 'Pro, weil es so ist' WHEN {c} > {p} THEN 'Das Label lautet: Contra' ELSE 'Keins von beiden.' END"


def sql_models() -> str:
    rows = ", ".join(f"({i}, {sql_text(m)}, {sql_text(c)}, {sql_text(t) if t else 'NULL'})" for i, (m, c, t) in enumerate(MODEL_REGISTRY))
    return f"models(i, model, client, template) AS (VALUES {rows})"


def sql_best(query: str, sentences: str) -> str:
    ratio = sql_edit_ratio(sql_plain(query), sql_plain("cl[i + 1]"))
    return f"list_max(list_transform(range(len({sentences})), lambda i: {{'score': {ratio}, 'back': -i, 's': cl[i + 1]}}))"


SQL_EVIDENCE = f"""{SQL_EXCHANGES},
e AS (SELECT *, {sql_sentence_list("answer")} AS cl, length(answer) % 2 = 1 AS odd, string_split(answer, chr(10))[-1] AS seg FROM x),
m AS (SELECT conv_id, turn, CASE WHEN odd OR seg = '' THEN coalesce(cl[1], '') ELSE coalesce(({sql_best("seg", "cl")}).s, '') END AS reasoning_segment,
  CASE WHEN odd THEN '' ELSE CAST(length(answer) AS VARCHAR) END AS reasoning FROM e)"""

HEADER = "'<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || text || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10)"

QUERIES = {
    "render_prompt": q_render_prompt,
    "prompt_routing": q_prompt_routing,
    "fewshot_prompt": q_fewshot_prompt,
    "batch_generate": q_batch_generate,
    "classify_stance_generated": q_classify_stance_generated,
    "argument_gate": q_argument_gate,
    "translate_columns": q_translate_columns,
    "segment_arguments": q_segment_arguments,
    "parse_dict_list": q_parse_dict_list,
    "parse_evidence_json": q_parse_evidence_json,
    "extract_evidence": q_extract_evidence,
    "evaluate_evidence": q_evaluate_evidence,
    "evidence_best_match": q_evidence_best_match,
    "evidence_best_match_ratio": q_evidence_best_match_ratio,
}


def sql_translated(text: str) -> str:
    for word, target in GLOSSARY.items():
        text = f"regexp_replace({text}, '\\b{word}\\b', '{target}', 'g')"
    return text


SQL_SAFE = "regexp_replace(regexp_replace(text, '[\"\\\\]', '', 'g'), '\\s+', ' ', 'g')"
CAP = "upper(substr(lower(text), 1, 1)) || substr(lower(text), 2)"

ORACLE = {
    "render_prompt": f"{SQL_EXCHANGES} SELECT conv_id, turn, {sql_template(PROMPTS['stance'], topic_text='question', text_sample='answer')} AS prompt FROM x",
    "prompt_routing": f"""WITH {sql_models()}
SELECT conv_id, turn, model, client, CASE WHEN client IN ('together', 'openai') OR template IS NULL THEN text
  WHEN template = 'inst' THEN '<s> [INST] ' || text || ' [/INST]' ELSE {HEADER} END AS final_prompt,
  CASE WHEN client IN ('transformers', 'vi') THEN 'max_new_tokens=4096.0;repetition_penalty=1.1;temperature=0.0'
  WHEN client = 'openai' THEN 'max_tokens=4096.0;temperature=0.0' ELSE 'max_tokens=4096.0;repetition_penalty=1.1;temperature=0.0' END AS parameters
  FROM conversations JOIN models ON (conv_id + turn) % {len(MODEL_REGISTRY)} = i""",
    "fewshot_prompt": f"""WITH ex AS (SELECT string_agg('- Zu «' || r_name || '» heisst es «' || n_name || '»: '
  || ['pro', 'contra', 'neutral'][n_nationkey % 3 + 1] || chr(10), '' ORDER BY md5('42-' || n_nationkey)) AS examples
  FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT item_id, {sql_template(PROMPTS['stance_few_shot'], examples='examples', topic_text="'Text ' || item_id", text_sample='text')} AS prompt FROM benchmark, ex""",
    "batch_generate": f"SELECT conv_id, turn, {sql_cue_answer('text')} AS generation FROM conversations",
    "classify_stance_generated": f"""{SQL_EXCHANGES}, g AS (SELECT conv_id, turn, {sql_cue_answer('answer')} AS model_generation FROM x)
SELECT conv_id, turn, CASE WHEN model_generation LIKE 'Pro%' THEN 'pro,' WHEN model_generation LIKE '%Contra' THEN 'contra' ELSE 'neutral' END AS label,
  CAST(NULL AS DOUBLE) AS score, model_generation FROM g""",
    "argument_gate": f"{SQL_EXCHANGES} SELECT conv_id, turn, answer FROM x WHERE ({sql_cue_answer('answer')}) <> 'Keins von beiden.'",
    "translate_columns": f'SELECT item_id, {CAP} AS "text_EN", {sql_translated("(" + CAP + ")")} AS "text_DE" FROM benchmark',
    "segment_arguments": """WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations),
u AS (SELECT conv_id, turn, unnest(ls) AS line, CAST(unnest(range(len(ls))) AS INTEGER) AS segment_no FROM l)
SELECT conv_id, turn, segment_no, regexp_replace(lower(line), '[^a-zà-ÿ ]', '', 'g') AS segment, '' AS stance FROM u""",
    "parse_dict_list": """SELECT event_id, 0 AS segment_no, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS event, CAST(NULL AS VARCHAR) AS value FROM events
UNION ALL SELECT event_id, 1, NULL, event_type, '' FROM events WHERE event_id % 5 <> 0""",
    "parse_evidence_json": f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN {SQL_SAFE} ELSE '' END AS reasoning_segment,
  CASE turn % 4 WHEN 0 THEN 'weil' WHEN 1 THEN {SQL_SAFE} ELSE '' END AS reasoning FROM conversations""",
    "extract_evidence": f"{SQL_EVIDENCE} SELECT * FROM m",
    "evaluate_evidence": f"""{SQL_EVIDENCE} SELECT *, 'Thema' AS "Worum geht es?", 'Meinung' AS "Meinung", 'pro' AS "Haltung",
  'evidence_for_claim' AS prompt, 'rule/last-line' AS evaluated_model FROM m""",
    "evidence_best_match": f"""{SQL_EXCHANGES}, s AS (SELECT *, {sql_sentence_list("answer")} AS cl FROM x),
b AS (SELECT *, {sql_best("question", "cl")} AS best FROM s)
SELECT conv_id, turn, best.s AS best_sentence, CAST(-best.back AS INTEGER) AS best_pos, round(best.score, 6) AS best_score FROM b""",
}
