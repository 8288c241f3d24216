"""Queries of the end-to-end jobs: search, mining, presentation."""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import (
    SQL_LABEL,
    SQL_SCORE,
    TEST_CONTRA,
    TEST_CUES,
    TEST_PRO,
    TEXT_THRESHOLD,
    sql_adjust,
    sql_ambiguous,
    sql_by_lang,
    sql_edit_ratio,
    sql_plain,
    sql_sentence_list,
    sql_sentences,
    sql_stance,
    sql_window,
    sql_words,
    spread_table,
)
from disputatio.functions.parsing import SPEAKER
from disputatio.functions.prompts import PROMPTS
from disputatio.operators.context import PROMPT_RADIUS
from disputatio.operators.counted import count_documents, embed_counted, vector_search
from disputatio.operators.ranking import running_counts
from disputatio.operators.reshape import all_topics_exhausted, progress_summary
from disputatio.operators.stance import is_argument
from disputatio.operators.text_index import build_text_index, extend_text_index, indexed_top_k
from disputatio.plans.mining import (
    MiningOptions,
    build_collection,
    classify,
    find_arguments,
    mine_corpus,
    prepare_topics,
    present_results,
    search,
    stop_early,
)
from disputatio.session import work_dir

OPTIONS = MiningOptions(similarity_threshold=TEXT_THRESHOLD, stance=TEST_CUES, cues=TEST_CUES)
KEY = ["doc_id", "sent_id"]


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents")
    return build_collection(docs, ["doc_id", "source"], "text", "lang", html=False)


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_topics(spread_table(spark, sf_dir, "benchmark"), "item_id", "text")


def digest_model():
    """A stand-in for a model: answers with the digest of the prompt."""
    return lambda prompts: prompts.map(lambda p: hashlib.md5(p.encode()).hexdigest())


def q_rewrite_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_topics(spread_table(spark, sf_dir, "benchmark"), "item_id", "text", "llm", digest_model)


def q_find_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_arguments(topics(spark, sf_dir), collection(spark, sf_dir), KEY, "source", "doc_id", OPTIONS)


def q_indexed_find_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over a saved index, written for the English sentences and then extended by the others."""
    sentences = collection(spark, sf_dir)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    name = f"index_{uuid.uuid4().hex}"
    build_text_index(sentences.where(english), KEY, "new_sentence", name, work_dir(spark, name))
    index = extend_text_index(spark, name, sentences.where(~english), KEY, "new_sentence")
    found = lambda asked: indexed_top_k(asked, index, topic="topic_rewritten", threshold=TEXT_THRESHOLD, k=OPTIONS.depth)
    return find_arguments(topics(spark, sf_dir), sentences, KEY, "source", "doc_id", OPTIONS, searcher=found)


VECTOR_THRESHOLD = 0.5


def q_find_arguments_by_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The argument search by cosine of hashed word vectors instead of shared words.

    Neither the collection nor the vectors are written: with contexts and 64 numbers a sentence they take several times the documents.
    """
    entries = collection(spark, sf_dir)
    weights = count_documents(entries, "new_sentence")
    number = F.col("doc_id") * (1 << 20) + F.col("sent_id")
    vectors = embed_counted(entries.select(*KEY, "new_sentence"), KEY, "new_sentence", weights).withColumn("number", number)
    found = lambda asked: vector_search(asked, vectors, KEY, "number", "embedding", weights, VECTOR_THRESHOLD, OPTIONS.depth)
    return find_arguments(topics(spark, sf_dir), entries, KEY, "source", "doc_id", OPTIONS, searcher=found)


def q_find_arguments_some_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = MiningOptions(
        similarity_threshold=TEXT_THRESHOLD, stance=TEST_CUES, cues=TEST_CUES, sources=("src1", "src3", "src5", "src7"), precheck=True, stance_threshold=0.6
    )
    return find_arguments(topics(spark, sf_dir), collection(spark, sf_dir), KEY, "source", "doc_id", options)


def debatable(text):
    """Built-in yes/no rule: a sentence with at least five words can be debated."""
    from disputatio.functions.text import words

    return F.size(words(text)) >= 5


def q_mine_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = MiningOptions(similarity_threshold=TEXT_THRESHOLD, stance=TEST_CUES, cues=TEST_CUES, debatable=debatable)
    rows = mine_corpus(topics(spark, sf_dir), collection(spark, sf_dir), KEY, options)
    return rows.withColumn("similarity", F.round("similarity", 6))


def q_present_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present_results(q_find_arguments(spark, sf_dir))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = topics(spark, sf_dir)
    slim = collection(spark, sf_dir).select(*KEY, "source", "lang", "new_sentence")
    hits = search(asked, slim, KEY, OPTIONS, OPTIONS.depth, strict=False)
    return stop_early(classify(hits, OPTIONS), asked, OPTIONS.neutral_limit)


def q_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _kept(spark, sf_dir)
    return rows.select(
        "request_id", "topic_pos", *KEY, "rank", "num_matches", "label", "analysis_status",
        (F.col("rank") + 1 == F.col("num_matches")).alias("all_arguments_analyzed"),
    )


def q_running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = running_counts(_kept(spark, sf_dir), ["request_id"], ["topic_pos"], [F.col("rank")], is_argument(F.col("label")))
    return rows.select("request_id", "topic_pos", "rank", "label", "analyzed_so_far", "arguments_so_far")


def q_progress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = topics(spark, sf_dir).select("request_id", "topic_pos")
    rows = asked.join(_kept(spark, sf_dir), ["request_id", "topic_pos"], "left")
    return progress_summary(
        rows,
        ["request_id", "topic_pos"],
        F.col("num_matches"),
        is_argument(F.col("label")),
        ~is_argument(F.col("label")),
        F.lit(False),
    )


def q_all_topics_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = topics(spark, sf_dir).select("request_id", "topic_rewritten")
    counts = _kept(spark, sf_dir).groupBy("request_id", "topic_rewritten").agg(F.max("analysis_status").alias("n"))
    states = asked.join(counts, ["request_id", "topic_rewritten"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return all_topics_exhausted(states, ["request_id"], "n", OPTIONS.neutral_limit)


# --- SQL ---------------------------------------------------------------------------------------


@lru_cache
def sql_hits(depth: int, strict: bool = False) -> str:
    """CTEs up to the ranked hits of each distinct topic sentence."""
    op = ">" if strict else ">="
    return f"""
WITH {sql_sentences("cs", "documents", "doc_id, source, lang", "text")},
coll AS MATERIALIZED (SELECT doc_id, source, lang, sent_id, sentence AS original_sentence,
  CASE WHEN len({sql_ambiguous("sentence", "lang")}) > 0 THEN {sql_window("sent_id", 2)} ELSE sentence END AS new_sentence,
  {sql_window("sent_id", 5)} AS context FROM cs),
{sql_sentences("ts", "benchmark", "item_id", "text")},
topics AS MATERIALIZED (SELECT item_id AS request_id, sent_id AS topic_pos, sentence AS topic_original,
  CASE WHEN len({sql_ambiguous("sentence", "NULL")}) > 0 THEN {sql_window("sent_id", 2)} ELSE sentence END AS topic_rewritten FROM ts),
tt AS (SELECT topic_rewritten, list_distinct({sql_words("topic_rewritten")}) AS w FROM (SELECT DISTINCT topic_rewritten FROM topics)),
tw AS (SELECT topic_rewritten, len(w) AS n, unnest(w) AS word FROM tt),
ct AS (SELECT doc_id, sent_id, list_distinct({sql_words("new_sentence")}) AS w FROM coll),
cw AS (SELECT doc_id, sent_id, len(w) AS m, unnest(w) AS word FROM ct),
sims AS (SELECT topic_rewritten, doc_id, sent_id, count(*)::DOUBLE / (any_value(n) + any_value(m) - count(*)) AS similarity
  FROM cw JOIN tw USING (word) GROUP BY topic_rewritten, doc_id, sent_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_rewritten ORDER BY similarity DESC, doc_id, sent_id) AS rn
  FROM sims WHERE similarity {op} {TEXT_THRESHOLD}),
hits AS MATERIALIZED (SELECT topic_rewritten, doc_id, sent_id, similarity, CAST(rn - 1 AS INTEGER) AS rank,
  CAST(count(*) OVER (PARTITION BY topic_rewritten) AS INTEGER) AS num_matches FROM ranked WHERE rn <= {depth})"""


def _sql_vector(name: str, source: str, key: str, text: str) -> str:
    """CTEs of the nonzero components of hashed vectors, as ``name``."""
    return f"""{name}_tf AS (SELECT {key}, word, count(*) AS tf FROM (SELECT {key}, unnest({sql_words(text)}) AS word FROM {source}) GROUP BY ALL),
{name}_raw AS (SELECT {key}, ('0x' || substr(md5(word), 1, 7))::INTEGER % 64 AS d,
  sum(tf * CASE WHEN substr(md5(word), 8, 1) < '8' THEN 1 ELSE -1 END * ln(((SELECT count(*) FROM coll) + 1.0::DOUBLE) / (coalesce(df, 0) + 1)) ORDER BY word) AS v
  FROM {name}_tf LEFT JOIN df USING (word) GROUP BY ALL),
{name} AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS norm FROM {name}_raw)"""


def sql_vector_hits(depth: int) -> str:
    """CTEs up to the ranked hits by cosine."""
    tables = sql_hits(depth).split("tt AS (")[0]
    return f"""{tables}df AS (SELECT word, count(*) AS df FROM (SELECT doc_id, sent_id, unnest(list_distinct({sql_words("new_sentence")})) AS word FROM coll) GROUP BY word),
tt AS (SELECT DISTINCT topic_rewritten FROM topics),
{_sql_vector("tv", "tt", "topic_rewritten", "topic_rewritten")}, {_sql_vector("cv", "coll", "doc_id, sent_id", "new_sentence")},
sims AS (SELECT topic_rewritten, doc_id, sent_id, round(sum(t.v * c.v) / (any_value(t.norm) * any_value(c.norm)), 10) AS similarity
  FROM tv t JOIN cv c USING (d) WHERE t.norm >= 1e-9 AND c.norm >= 1e-9 GROUP BY topic_rewritten, doc_id, sent_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_rewritten ORDER BY similarity DESC, doc_id, sent_id) AS rn
  FROM sims WHERE similarity >= {VECTOR_THRESHOLD}),
hits AS MATERIALIZED (SELECT topic_rewritten, doc_id, sent_id, similarity, CAST(rn - 1 AS INTEGER) AS rank,
  CAST(count(*) OVER (PARTITION BY topic_rewritten) AS INTEGER) AS num_matches FROM ranked WHERE rn <= {depth})"""


def sql_labelled(threshold: float, where: str = "TRUE", precheck: bool = False) -> str:
    pro, contra = sql_stance(sql_words("new_sentence"), "lang")
    gate = f"score >= {threshold}" if precheck else "TRUE"
    return f"""
counted AS (SELECT hits.*, source, lang, original_sentence, new_sentence, context, {pro} AS p, {contra} AS c
  FROM hits JOIN coll USING (doc_id, sent_id) WHERE {where}),
scored AS (SELECT * EXCLUDE (p, c), {SQL_LABEL} AS raw, {SQL_SCORE} AS score FROM counted),
labelled AS (SELECT *, {sql_adjust("raw", "score", threshold)} AS label FROM scored WHERE {gate})"""


SQL_KEPT = """
asked AS (SELECT request_id, topic_pos, topic_original, labelled.*,
  CASE WHEN label IN ('pro', 'contra') THEN 0 ELSE 1 END AS ntr FROM topics JOIN labelled USING (topic_rewritten)),
stopping AS (SELECT *, coalesce(sum(ntr) OVER (PARTITION BY request_id, topic_rewritten ORDER BY topic_pos, rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM asked),
kept AS MATERIALIZED (SELECT *, CAST(seen + ntr AS INTEGER) AS analysis_status, rank + 1 = num_matches AS all_arguments_analyzed
  FROM stopping WHERE seen < 3)"""


def sql_evidence(source: str, for_all: bool = False) -> str:
    sentences = sql_sentence_list("context")
    ratio = sql_edit_ratio(sql_plain("topic_rewritten"), sql_plain("cl[i + 1]"))
    best = f"list_max(list_transform(range(len(cl)), lambda i: {{'score': {ratio}, 'back': -i, 's': cl[i + 1]}}))"
    wanted = "TRUE" if for_all else "label IN ('pro', 'contra')"
    cues = f"CASE WHEN label = 'pro' THEN {sql_by_lang(TEST_PRO, 'lang')} ELSE {sql_by_lang(TEST_CONTRA, 'lang')} END"
    return f"""
split AS (SELECT *, {sentences} AS cl FROM {source}),
matched AS (SELECT *, CASE WHEN {wanted} AND len(cl) > 0 THEN ({best}).s ELSE '' END AS reasoning_segment FROM split),
cued AS (SELECT *, list_filter({sql_words("reasoning_segment")}, lambda w: list_contains({cues}, w)) AS cw2 FROM matched),
spoken AS (SELECT *, coalesce(regexp_extract_all(original_sentence, '{SPEAKER}', 0)[-1], regexp_extract_all(
  CASE WHEN instr(context, original_sentence) > 0 THEN left(context, instr(context, original_sentence) - 1) ELSE context END, '{SPEAKER}', 0)[-1], '') AS who FROM cued),
evident AS (SELECT *,
  CASE WHEN label IN ('pro', 'contra') THEN array_to_string(list_filter(cw2, lambda w, i: list_position(cw2, w) = i), ', ') ELSE '' END AS reasoning,
  CASE WHEN label IN ('pro', 'contra') THEN regexp_extract(who, '{SPEAKER}', 1) ELSE '' END AS person,
  CASE WHEN label IN ('pro', 'contra') THEN regexp_extract(who, '{SPEAKER}', 2) ELSE '' END AS party,
  CASE WHEN label IN ('pro', 'contra') THEN regexp_extract(who, '{SPEAKER}', 3) ELSE '' END AS canton FROM spoken)"""


SQL_ARGUMENT_ROW = """SELECT request_id, topic_pos, topic_original, topic_rewritten, new_sentence AS argument_rewritten,
  original_sentence AS argument_original, CAST(score AS VARCHAR) AS argument_reason, person, party, canton, context, label, score,
  reasoning, reasoning_segment, floor(similarity * 100 + 0.5000001) / 100 AS similarity, 'cue-rule' AS model_name, num_matches,
  rank AS num_arguments_analyzed, source AS business_id, CAST(doc_id AS VARCHAR) AS filename, analysis_status, all_arguments_analyzed
  FROM evident"""


def sql_find(threshold: float = 0.8, where: str = "TRUE", precheck: bool = False) -> str:
    return f"{sql_hits(1000)},{sql_labelled(threshold, where, precheck)},{SQL_KEPT},{sql_evidence('kept')}"


def sql_prompt(template: str, slots: dict[str, str]) -> str:
    parts = []
    for literal, slot, _, _ in Formatter().parse(template):
        parts += ["'" + literal.replace("'", "''") + "'"] if literal else []
        parts += [f"coalesce({slots[slot]}, '')"] if slot is not None else []
    return " || ".join(parts)


SQL_REWRITE = f"""WITH {sql_sentences("ts", "benchmark", "item_id", "text")},
found AS (SELECT item_id, sent_id, sentence, {sql_ambiguous("sentence", "NULL")} AS words, {sql_window("sent_id", PROMPT_RADIUS)} AS near FROM ts)
SELECT item_id AS request_id, sent_id AS topic_pos, sentence AS topic_original, CASE WHEN len(words) > 0
  THEN md5({sql_prompt(PROMPTS["rewrite"], {"sentence": "sentence", "context": "near", "ambiguous_words": "array_to_string(list_filter(words, lambda w, i: list_position(words, w) = i), ', ')"})})
  ELSE sentence END AS topic_rewritten FROM found"""

SQL_SHORT = f"{sql_hits(1000)},{sql_labelled(0.8)},{SQL_KEPT}"

QUERIES = {
    "rewrite_with_model": q_rewrite_with_model,
    "find_arguments": q_find_arguments,
    "indexed_find_arguments": q_indexed_find_arguments,
    "find_arguments_by_vector": q_find_arguments_by_vector,
    "find_arguments_some_sources": q_find_arguments_some_sources,
    "mine_corpus": q_mine_corpus,
    "present_results": q_present_results,
    "early_stop": q_early_stop,
    "running_progress": q_running_progress,
    "progress_summary": q_progress_summary,
    "all_topics_exhausted": q_all_topics_exhausted,
}

ORACLE = {
    "rewrite_with_model": SQL_REWRITE,
    "find_arguments": f"{sql_find()} {SQL_ARGUMENT_ROW}",
    "indexed_find_arguments": f"{sql_find()} {SQL_ARGUMENT_ROW}",
    "find_arguments_by_vector": f"{sql_vector_hits(1000)},{sql_labelled(0.8)},{SQL_KEPT},{sql_evidence('kept')} {SQL_ARGUMENT_ROW}",
    "find_arguments_some_sources": f"{sql_find(0.6, 'source IN (' + repr('src1') + ', ' + repr('src3') + ', ' + repr('src5') + ', ' + repr('src7') + ')', True)} {SQL_ARGUMENT_ROW}",
    "mine_corpus": f"""{sql_hits(10, strict=True)},{sql_labelled(0.8, "length(new_sentence) > 10 AND len(" + sql_words("new_sentence") + ") >= 5")},
asked AS (SELECT request_id, topic_pos, topic_original, labelled.* FROM topics JOIN labelled USING (topic_rewritten)),{sql_evidence('asked', True)}
SELECT request_id, topic_pos, doc_id, sent_id, topic_original, topic_rewritten, new_sentence AS argument_rewritten,
  original_sentence AS argument_original, CAST(score AS VARCHAR) AS argument_reason, person, party, canton, context, label, score,
  reasoning, reasoning_segment, round(similarity, 6) AS similarity FROM evident""",
    "present_results": f"""{sql_find()},
run AS (SELECT *, count(*) OVER w AS analyzed_so_far, sum(CASE WHEN label IN ('pro', 'contra') THEN 1 ELSE 0 END) OVER w AS arguments_so_far
  FROM evident WINDOW w AS (PARTITION BY request_id ORDER BY topic_pos, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT request_id, topic_pos, rank, CAST(doc_id AS VARCHAR) AS "Quelle", topic_original AS "Thema", label AS "Haltung", context AS "Kontext",
  CAST(score AS VARCHAR) AS "Modellbegründung für gewählte Haltung", original_sentence AS "Meinung", reasoning AS "Begründung für die Meinung",
  person AS "Person", party AS "Partei", canton AS "Kanton", floor(similarity * 100 + 0.5000001) / 100 AS "Sem. Ähnlichkeit", 'cue-rule' AS "LLM",
  analyzed_so_far, CAST(arguments_so_far AS BIGINT) AS arguments_so_far FROM run WHERE label IN ('pro', 'contra')""",
    "early_stop": f"""{SQL_SHORT}
SELECT request_id, topic_pos, doc_id, sent_id, rank, num_matches, label, analysis_status, all_arguments_analyzed FROM kept""",
    "running_progress": f"""{SQL_SHORT}
SELECT request_id, topic_pos, rank, label, count(*) OVER w AS analyzed_so_far,
  CAST(sum(1 - ntr) OVER w AS BIGINT) AS arguments_so_far
  FROM kept WINDOW w AS (PARTITION BY request_id ORDER BY topic_pos, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "progress_summary": f"""{SQL_SHORT},
sums AS (SELECT t.request_id, t.topic_pos, coalesce(max(num_matches), 0) AS num_matches, CAST(count(num_matches) AS INTEGER) AS analyzed,
  CAST(coalesce(sum(1 - ntr), 0) AS INTEGER) AS arguments, CAST(coalesce(sum(ntr), 0) AS INTEGER) AS neutrals
  FROM topics t LEFT JOIN kept k ON t.request_id = k.request_id AND t.topic_pos = k.topic_pos GROUP BY t.request_id, t.topic_pos),
states AS (SELECT *, CASE WHEN neutrals >= 3 THEN 'neutral_limit' WHEN num_matches = 0 THEN 'no_match'
  WHEN num_matches = analyzed THEN 'complete' ELSE 'running' END AS state FROM sums)
SELECT *, state || ': ' || num_matches || ' matches, ' || analyzed || ' analyzed, ' || arguments || ' arguments' AS message FROM states""",
    "all_topics_exhausted": f"""{SQL_SHORT},
counts AS (SELECT request_id, topic_rewritten, max(analysis_status) AS n FROM kept GROUP BY ALL)
SELECT t.request_id, bool_and(coalesce(n, 0) = 3) AS all_exhausted FROM topics t
  LEFT JOIN counts c ON t.request_id = c.request_id AND t.topic_rewritten = c.topic_rewritten GROUP BY t.request_id""",
}
