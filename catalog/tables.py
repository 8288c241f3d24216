"""Queries on records, result tables and the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import sql_sentences, spread_table, table
from catalog.stances import SQL_SENTENCE, sentence_stances
from disputatio.operators.context import explode_sentences, prepare_sentences
from disputatio.operators.reshape import (
    append_results,
    chosen_names,
    dynamic_project,
    first_record,
    rename_project,
    stamp,
    strip_time_zone,
    transpose_record,
    unique_field_values,
)
from disputatio.operators.stance import allowed_source
from disputatio.plans.evaluation import prepare_corpus
from disputatio.sources.collection import SOURCE_URL, as_entries, new_entries, scan_collection, upsert

NAMES = {"source": "Quelle", "sentence": "Meinung", "label": "Haltung", "score": "Sicherheit"}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as business records: the source is the business, each day brings one document."""
    rows = spread_table(spark, sf_dir, "documents").withColumnRenamed("lang", "language")
    return rows.withColumn("modified", F.timestamp_seconds(F.col("doc_id") * 86400 + 3600))


def q_extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_record(records(spark, sf_dir), "de", ["text", "n_chars"], ["source"], ["doc_id"])


def q_tz_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return strip_time_zone(orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ordered"), F.col("o_orderdate").alias("naive")))


def q_transpose_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transpose_record(table(spark, sf_dir, "customer"), ["c_custkey"], ["c_name", "c_nationkey", "c_mktsegment"])


def q_prepare_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_corpus(records(spark, sf_dir), key="source", language="de", fields=["text", "n_chars", "modified"], order=["doc_id"])


def q_rename_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename_project(sentence_stances(spark, sf_dir), NAMES)


def q_dynamic_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ["Meinung", "Haltung"]
    renamed = rename_project(sentence_stances(spark, sf_dir), {"doc_id": "doc_id", **chosen_names(chosen, NAMES)})
    return dynamic_project(renamed, ["doc_id", *chosen])


def q_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explode_sentences(spread_table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return rows.where(allowed_source(F.col("source"), ["src1", "src2", "src11"]))


def q_min_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_sentences(spread_table(spark, sf_dir, "documents"), ["doc_id"]).where(F.length("sentence") > 10)


def q_stamp_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_stances(spark, sf_dir).select("doc_id", "sent_id", "label")
    return stamp(rows, similarity_threshold=0.8, selected_sources=["src1", "alles"], method="finetuned", prompt="stance", model_name="cue-rule")


def q_append_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a stance first, then the batch of neutral ones."""
    rows = sentence_stances(spark, sf_dir).select("doc_id", "sent_id", "label")
    return append_results(rows.where(F.col("label") != "Neutral"), rows.where(F.col("label") == "Neutral").select("label", "sent_id", "doc_id"))


def entries(spark: SparkSession, sf_dir: str, known: bool = False) -> DataFrame:
    """Collection entries of all documents, or of the labelled ones: the collection so far."""
    docs = spread_table(spark, sf_dir, "documents")
    if known:
        docs = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    prepared = prepare_sentences(docs, ["doc_id", "source", "lang"])
    number = F.concat_ws("-", "doc_id", "sent_id")
    return as_entries(prepared.withColumn("filename", F.col("doc_id").cast("string")), "source", "filename", number)


def q_unique_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = F.struct(F.col("source").alias("business_id"), F.col("doc_id").alias("filename"))
    return unique_field_values(spread_table(spark, sf_dir, "documents").select(metadata.alias("metadata")), "metadata", "business_id").select("value")


def q_collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection so far holds the labelled documents; all documents are added."""
    incoming = entries(spark, sf_dir)
    existing = entries(spark, sf_dir, known=True).withColumn("origin", F.lit("existing"))
    rows = upsert(existing, incoming.withColumn("origin", F.lit("added")))
    return rows.select("id", "document", "origin", "metadata.url")


def q_new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_entries(entries(spark, sf_dir, known=True), entries(spark, sf_dir)).groupBy("business_id").agg(F.count(F.lit(1)).alias("n"))


def q_collection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_collection(entries(spark, sf_dir), ["document", "metadata.original_sentence", "metadata.business_id"])


def q_collection_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_collection(entries(spark, sf_dir), ["document"], limit=100, offset=50)


URL = SOURCE_URL

QUERIES = {
    "extract_fields": q_extract_fields,
    "tz_naive": q_tz_naive,
    "transpose_record": q_transpose_record,
    "prepare_corpus": q_prepare_corpus,
    "rename_project": q_rename_project,
    "dynamic_project": q_dynamic_project,
    "source_filter": q_source_filter,
    "min_length_filter": q_min_length_filter,
    "stamp_metadata": q_stamp_metadata,
    "append_results": q_append_results,
    "unique_field_values": q_unique_field_values,
    "collection_upsert": q_collection_upsert,
    "new_entries": q_new_entries,
    "collection_scan": q_collection_scan,
    "collection_page": q_collection_page,
}


def _entries_sql() -> str:
    from catalog.base import sql_ambiguous, sql_window

    return f"""WITH {sql_sentences("s", "documents", "doc_id, source, lang", "text")},
en AS (SELECT *, source || '-' || doc_id || '-' || sent_id AS id,
  CASE WHEN len({sql_ambiguous("sentence", "lang")}) > 0 THEN {sql_window("sent_id", 2)} ELSE sentence END AS document FROM s)"""


FIRST = """WITH f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE lang = 'de')"""

ORACLE = {
    "extract_fields": f"{FIRST} SELECT source, text, n_chars FROM f WHERE rn = 1",
    "tz_naive": "SELECT o_orderkey, o_orderdate AS ordered, o_orderdate AS naive FROM orders",
    "transpose_record": """SELECT c_custkey, 'c_name' AS field, c_name AS value FROM customer UNION ALL
SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer""",
    "prepare_corpus": f"""{FIRST} SELECT source, 'text' AS field, text AS value FROM f WHERE rn = 1 UNION ALL
SELECT source, 'n_chars', CAST(n_chars AS VARCHAR) FROM f WHERE rn = 1 UNION ALL
SELECT source, 'modified', strftime(make_timestamp((doc_id * 86400 + 3600) * 1000000), '%Y-%m-%d %H:%M:%S') FROM f WHERE rn = 1""",
    "rename_project": f'{SQL_SENTENCE} SELECT source AS "Quelle", sentence AS "Meinung", label AS "Haltung", score AS "Sicherheit" FROM st',
    "dynamic_project": f'{SQL_SENTENCE} SELECT doc_id, sentence AS "Meinung", label AS "Haltung" FROM st',
    "source_filter": f"WITH {sql_sentences('s', 'documents', 'doc_id, source', 'text')} SELECT doc_id, source, sent_id, sentence FROM s WHERE source IN ('src1', 'src2', 'src11')",
    "min_length_filter": f"WITH {sql_sentences('s', 'documents', 'doc_id', 'text')} SELECT doc_id, sent_id, sentence FROM s WHERE length(sentence) > 10",
    "stamp_metadata": f"""{SQL_SENTENCE} SELECT doc_id, sent_id, label, 0.8::DOUBLE AS similarity_threshold, 'src1; alles' AS selected_sources,
  'finetuned' AS method, 'stance' AS prompt, 'cue-rule' AS model_name FROM st""",
    "append_results": f"{SQL_SENTENCE} SELECT doc_id, sent_id, label FROM st",
    "unique_field_values": "SELECT 'alles' AS value UNION ALL SELECT DISTINCT source FROM documents",
    "collection_upsert": f"""{_entries_sql()} SELECT id, document, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'existing' ELSE 'added' END AS origin,
  '{URL}' || source AS url FROM en""",
    "new_entries": f"{_entries_sql()} SELECT source AS business_id, count(*) AS n FROM en WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source",
    "collection_scan": f"{_entries_sql()} SELECT id, document, sentence AS original_sentence, source AS business_id FROM en",
    "collection_page": f"{_entries_sql()} SELECT id, document FROM en ORDER BY id LIMIT 100 OFFSET 50",
}
