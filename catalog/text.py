"""Queries on text: sentences, contexts, ambiguous words, markup, clean-up, speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import sql_ambiguous, sql_sentences, sql_window, spread_table, table
from disputatio.functions.parsing import SPEAKER, mention_fields, speaker
from disputatio.functions.text import capitalize_first, clean_whitespace, escape_all_strings, strip_html
from disputatio.operators.context import (
    PROMPT_RADIUS,
    ambiguous_words,
    explode_sentences,
    prepare_sentences,
    sentence_contexts,
)
from disputatio.plans.mining import build_collection

# Long windows are compared by digest and length, which keeps the results small; all text is processed.


def q_split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_sentences(spread_table(spark, sf_dir, "documents"), ["doc_id"])


def _digest(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumns({f"{out}_md5": F.md5(F.col(text)), f"{out}_length": F.length(text)}).drop(text)


def q_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_contexts(spread_table(spark, sf_dir, "documents"), ["doc_id"])
    return _digest(rows.drop("sentence"), "context", "context")


def q_context_window_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_contexts(spread_table(spark, sf_dir, "documents"), ["doc_id"], exact=True)
    return _digest(rows.drop("sentence"), "context", "context")


def q_prompt_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_contexts(spread_table(spark, sf_dir, "documents"), ["doc_id"], radius=PROMPT_RADIUS)
    return _digest(rows.drop("sentence"), "context", "context")


def q_rewrite_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare_sentences(spread_table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", "sent_id", "new_sentence", (F.col("new_sentence") != F.col("original_sentence")).alias("rewritten"))


def q_ambiguous_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explode_sentences(spread_table(spark, sf_dir, "documents"), ["doc_id", "lang"])
    words = F.array_join(ambiguous_words(F.col("sentence"), F.col("lang")), ", ")
    return rows.select("doc_id", "sent_id", words.alias("ambiguous_words"))


def q_ambiguous_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explode_sentences(spread_table(spark, sf_dir, "documents"), ["doc_id", "lang"])
    return rows.where(F.size(ambiguous_words(F.col("sentence"), F.col("lang"))) > 0).drop("lang")


def q_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "pages").select("page_id", strip_html(F.col("html")).alias("text"))


def q_strip_html_glued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "pages").select("page_id", strip_html(F.col("html"), "").alias("text"))


def q_clean_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "documents").select("doc_id", clean_whitespace(F.col("text")).alias("text"))


def q_capitalize_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "documents").select("doc_id", capitalize_first(F.lower("text")).alias("text"))


def q_escape_control_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("c_custkey") % 31 + 1).cast("int")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.col("c_name"), F.char(code), F.col("c_mktsegment"), F.char(code)).alias("text"))
    return escape_all_strings(rows)


def protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences naming speakers, made from customers, nations and regions."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    # nation and region are fixed lists of 25 and 5 rows; their size decides how they are joined
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    canton = F.upper(F.substring("r_name", 1, 2))
    name = F.concat(
        F.substring("c_mktsegment", 1, 1), F.lower(F.substr("c_mktsegment", F.lit(2))), F.lit(" "),
        F.substring("r_name", 1, 1), F.lower(F.regexp_replace(F.substr("r_name", F.lit(2)), " ", "")),
    )
    mention = F.concat(name, F.lit(" (M-"), F.substring("c_mktsegment", 1, 1), F.lit(", "), canton, F.lit(")"))
    unnamed = F.concat(F.lit("Die Vorlage kam von "), F.col("c_name"))
    return rows.select(
        "c_custkey",
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("Nach "), mention, F.lit(" ist sie sinnvoll"))).otherwise(unnamed).alias("sentence"),
        F.when(F.col("c_nationkey") % 3 == 0, unnamed).otherwise(F.concat(F.lit("Anna Muster (G, ZH) fragte. "), mention, F.lit(" sprach dagegen."))).alias("context"),
    )


def q_extract_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = protocol(spark, sf_dir)
    return rows.withColumn("who", speaker(F.col("sentence"), F.col("context"))).select("c_custkey", "sentence", "context", "who.*")


def q_speaker_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as minutes: one sentence per item, those of returned items name who speaks; the speaker holds until the next one is named."""
    who = F.concat(F.lit("Anna Muster (M-"), F.col("l_returnflag"), F.lit(", Z"), F.col("l_linestatus"), F.lit(")"))
    said = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0, F.concat(F.lit("Nach "), who, F.lit(" genug."))).otherwise("Das ist richtig.")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", said.alias("said")).alias("item"))
    minutes = items.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["said"]), " ").alias("text"))
    rows = prepare_sentences(minutes, ["l_orderkey"], "text", None, None, speakers=True)
    return rows.select("l_orderkey", "sent_id", mention_fields(F.col("mention")).alias("who")).select("l_orderkey", "sent_id", "who.*")


def q_build_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread_table(spark, sf_dir, "pages").withColumn("business_id", F.regexp_extract("url", "^https?://([^/]+)", 1))
    rows = build_collection(pages, ["page_id", "business_id"], "html")
    return rows.withColumn("context", F.md5("context"))


BLOCKS = "(?i)</(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|title)\\s*>|<br\\s*/?>"


def sql_strip(html: str, separator: str) -> str:
    text = f"regexp_replace({html}, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g')"
    text = f"regexp_replace({text}, '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g')"
    text = f"regexp_replace({text}, '(?s)<!--.*?-->', '', 'g')"
    if separator:
        text = f"regexp_replace({text}, '{BLOCKS}', {separator}, 'g')"
    text = f"regexp_replace({text}, '</?[A-Za-z!?][^>]*>', '', 'g')"
    pairs = [("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&apos;", "chr(39)"), ("&middot;", "'·'"), ("&copy;", "'©'"), ("&amp;", "'&'")]
    for entity, char in pairs:
        text = f"replace({text}, '{entity}', {char})"
    return text


def sql_exact_window(radius: int) -> str:
    start = f"CASE WHEN sent_id >= {radius} THEN sent_id - {radius} ELSE greatest(len(lst) + sent_id - {radius}, 0) END"
    return f"CASE WHEN ({start}) >= least(sent_id + {radius}, len(lst)) THEN '' ELSE array_to_string(list_slice(lst, ({start}) + 1, least(sent_id + {radius}, len(lst))), ' ') END"


def _sql_digest(expr: str) -> str:
    return f"""WITH {sql_sentences("s", "documents", "doc_id", "text")}, w AS (SELECT doc_id, sent_id, {expr} AS context FROM s)
SELECT doc_id, sent_id, md5(context) AS context_md5, CAST(length(context) AS INTEGER) AS context_length FROM w"""


SQL_FOUND = sql_ambiguous("sentence", "lang")

QUERIES = {
    "split_sentences": q_split_sentences,
    "context_window": q_context_window,
    "context_window_exact": q_context_window_exact,
    "prompt_context": q_prompt_context,
    "rewrite_with_context": q_rewrite_with_context,
    "ambiguous_words": q_ambiguous_words,
    "ambiguous_sentences": q_ambiguous_sentences,
    "strip_html": q_strip_html,
    "strip_html_glued": q_strip_html_glued,
    "clean_whitespace": q_clean_whitespace,
    "capitalize_first": q_capitalize_first,
    "escape_control_chars": q_escape_control_chars,
    "extract_speaker": q_extract_speaker,
    "speaker_carried": q_speaker_carried,
    "build_collection": q_build_collection,
}

ORACLE = {
    "split_sentences": f"WITH {sql_sentences('s', 'documents', 'doc_id', 'text')} SELECT doc_id, sent_id, sentence FROM s",
    "context_window": _sql_digest(sql_window("sent_id", 5)),
    "context_window_exact": _sql_digest(sql_exact_window(5)),
    "prompt_context": _sql_digest(sql_window("sent_id", 20)),
    "rewrite_with_context": f"""WITH {sql_sentences("s", "documents", "doc_id, lang", "text")},
n AS (SELECT *, CASE WHEN len({SQL_FOUND}) > 0 THEN {sql_window("sent_id", 2)} ELSE sentence END AS new_sentence FROM s)
SELECT doc_id, sent_id, new_sentence, new_sentence <> sentence AS rewritten FROM n""",
    "ambiguous_words": f"""WITH {sql_sentences("s", "documents", "doc_id, lang", "text")}, f AS (SELECT *, {SQL_FOUND} AS w FROM s)
SELECT doc_id, sent_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ', ') AS ambiguous_words FROM f""",
    "ambiguous_sentences": f"""WITH {sql_sentences("s", "documents", "doc_id, lang", "text")},
marked AS (SELECT DISTINCT lang, sentence FROM s WHERE len({SQL_FOUND}) > 0)
SELECT doc_id, sent_id, sentence FROM s WHERE EXISTS (SELECT 1 FROM marked m WHERE m.lang = s.lang AND m.sentence = s.sentence)""",
    "strip_html": f"SELECT page_id, {sql_strip('html', 'chr(10)')} AS text FROM pages",
    "strip_html_glued": f"SELECT page_id, {sql_strip('html', '')} AS text FROM pages",
    "clean_whitespace": "SELECT doc_id, regexp_replace(regexp_replace(text, '[\\n\\t\\r]', ' ', 'g'), ' +', ' ', 'g') AS text FROM documents",
    "capitalize_first": "SELECT doc_id, upper(substr(lower(text), 1, 1)) || substr(lower(text), 2) AS text FROM documents",
    "escape_control_chars": """WITH t AS (SELECT *, CAST(c_custkey % 31 + 1 AS INTEGER) AS code FROM customer),
e AS (SELECT *, CASE WHEN code IN (9, 10, 13) THEN chr(code) ELSE '\\x' || lpad(lower(to_hex(code)), 2, '0') END AS ch FROM t)
SELECT c_custkey, c_name || ch || c_mktsegment || ch AS text FROM e""",
    "speaker_carried": f"""WITH named AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 'Anna Muster (M-' || l_returnflag || ', Z' || l_linestatus || ')' END AS mention FROM lineitem),
said AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, coalesce('Nach ' || mention || ' genug.', 'Das ist richtig.')) - 1 AS n, mention FROM named),
carried AS (SELECT l_orderkey, n, coalesce(last_value(mention IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING), '') AS who FROM said)
SELECT l_orderkey, CAST(n AS INTEGER) AS sent_id, regexp_extract(who, '{SPEAKER}', 1) AS person, regexp_extract(who, '{SPEAKER}', 2) AS party,
  regexp_extract(who, '{SPEAKER}', 3) AS canton FROM carried""",
    "extract_speaker": f"""WITH r AS (SELECT c_custkey, c_nationkey, 'Die Vorlage kam von ' || c_name AS unnamed,
  substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) || ' ' || substr(r_name, 1, 1) || lower(replace(substr(r_name, 2), ' ', ''))
  || ' (M-' || substr(c_mktsegment, 1, 1) || ', ' || upper(substr(r_name, 1, 2)) || ')' AS mention
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'Nach ' || mention || ' ist sie sinnvoll' ELSE unnamed END AS sentence,
  CASE WHEN c_nationkey % 3 = 0 THEN unnamed ELSE 'Anna Muster (G, ZH) fragte. ' || mention || ' sprach dagegen.' END AS context FROM r),
w AS (SELECT *, coalesce(regexp_extract_all(sentence, '{SPEAKER}', 0)[-1], regexp_extract_all(context, '{SPEAKER}', 0)[-1], '') AS who FROM p)
SELECT c_custkey, sentence, context, regexp_extract(who, '{SPEAKER}', 1) AS person, regexp_extract(who, '{SPEAKER}', 2) AS party,
  regexp_extract(who, '{SPEAKER}', 3) AS canton FROM w""",
    "build_collection": f"""WITH plain AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS business_id, {sql_strip("html", "chr(10)")} AS text FROM pages),
{sql_sentences("s", "plain", "page_id, business_id", "text")}
SELECT page_id, business_id, sent_id, sentence AS original_sentence,
  CASE WHEN len({sql_ambiguous("sentence", "NULL")}) > 0 THEN {sql_window("sent_id", 2)} ELSE sentence END AS new_sentence,
  md5({sql_window("sent_id", 5)}) AS context FROM s""",
}
