"""Sources and sinks as round trips: the tables are written in a foreign form and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import spread_table, sql_sentences, table
from disputatio.functions.labels import base_name, safe_model_name
from disputatio.functions.text import split_sentences
from disputatio.operators.reshape import empty_results, has_rows, require_field
from disputatio.session import work_dir
from disputatio.sources.collection import add_to_collection, as_entries, get_or_create, scan_collection
from disputatio.sources.corpus import read_business_records, scan_text_corpus
from disputatio.sources.sinks import result_path, save_results, write_fields, write_results
from disputatio.sources.tables import FEW_SHOT_SCHEMA, read_checked_csv, read_few_shot


def q_scan_labelled_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a labelled set in CSV, some numbers of which are none; accepted rows and rejects together."""
    folder = work_dir(spark, "csv")
    docs = spread_table(spark, sf_dir, "documents")
    score = F.when(F.col("doc_id") % 7 == 0, "n/a").otherwise(F.col("n_chars").cast("string"))
    docs.select("doc_id", F.md5("text").alias("argument"), score.alias("score"), F.concat("source", F.lit('\n"'), "lang").alias("topic")).write.csv(folder, header=True, escape='"')
    found = read_checked_csv(spark, folder, "topic string, argument string, score double, doc_id long")
    rows = found.rows.select("doc_id", "topic", "argument", "score", F.lit("").alias("reasons"))
    field = lambda name: F.get_json_object("record", f"$.{name}")
    rejects = found.rejects.select(field("doc_id").cast("long"), field("topic"), field("argument"), F.lit(None).cast("double"), F.array_join("reasons", ","))
    return rows.union(rejects)


def q_scan_text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a text file of its own, read back as a corpus."""
    folder = work_dir(spark, "corpus")
    write_fields(table(spark, sf_dir, "benchmark"), "item_id", ["text"], folder)
    rows = scan_text_corpus(spark, folder)
    return rows.select("business_id", F.regexp_replace("html", r"\n\z", "").alias("text"))


def q_business_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as landed records in JSON."""
    folder = work_dir(spark, "records")
    spread_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ID"), F.col("lang").alias("Language"), F.md5("text").alias("Text")).write.json(folder)
    return read_business_records(spark, folder, "ID long, Language string, Text string")


def q_few_shot_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations, a fixed list of 25, as a JSON array of examples."""
    folder = work_dir(spark, "examples")
    nation = table(spark, sf_dir, "nation")
    rows = nation.select(F.col("n_name").alias("topic"), F.lit("x").alias("thema"), F.concat(F.lit('A "'), "n_name", F.lit('"')).alias("argument"), F.lit("pro").alias("label"), F.lit(None).cast("string").alias("reasoning"))
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(folder)
    return read_few_shot(spark, folder).select(*[c.split()[0] for c in FEW_SHOT_SCHEMA.split(", ")])


def q_save_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a result table: written with stamps as Parquet, that table again as CSV under the model's name, and read back."""
    folder = work_dir(spark, "results")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    stamped = spark.read.parquet(save_results(events, folder, 0.8, ["alles", "src1"]))
    path = write_results(stamped, result_path(folder, business_id="20210046", model="org/model-7b"), "csv")
    back = spark.read.schema(stamped.schema).csv(path, header=True, escape='"')
    named = base_name(F.regexp_replace("_metadata.file_path", "/[^/]+$", ""))
    return back.select("*", F.replace(named, safe_model_name(F.lit("org/model-7b")), F.lit("MODEL")).alias("folder"))


def q_collection_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection as a table: created empty, filled, and filled again with what it knows already."""
    docs = spread_table(spark, sf_dir, "documents")
    rows = docs.select("source", "doc_id", F.posexplode(split_sentences(F.col("text"))).alias("sent_id", "sentence"))
    rows = rows.select(F.col("source").alias("business"), F.col("doc_id").cast("string").alias("file"), F.concat_ws(".", "doc_id", "sent_id").alias("number"),
                       F.col("sentence").alias("original_sentence"), F.col("sentence").alias("new_sentence"), F.lit("").alias("context"))
    name = f"collection_{uuid.uuid4().hex}"
    entries = as_entries(rows, "business", "file", F.col("number"))
    table_ = get_or_create(spark, name, path=work_dir(spark, name))
    require_field(table_, "metadata", "url")
    if has_rows(table_):
        raise ValueError("a new collection has no rows")
    for some in (entries, empty_results(entries), entries):
        add_to_collection(spark, name, some)
    return scan_collection(spark.table(name), ["document", "business_id", "metadata.filename", "metadata.url"])


QUERIES = {
    "scan_labelled_csv": q_scan_labelled_csv,
    "scan_text_corpus": q_scan_text_corpus,
    "business_records": q_business_records,
    "few_shot_examples": q_few_shot_examples,
    "save_results": q_save_results,
    "collection_table": q_collection_table,
}

ORACLE = {
    "scan_labelled_csv": """SELECT doc_id, source || chr(10) || '"' || lang AS topic, md5(text) AS argument,
  CASE WHEN doc_id % 7 <> 0 THEN n_chars::DOUBLE END AS score, CASE WHEN doc_id % 7 = 0 THEN 'score' ELSE '' END AS reasons FROM documents""",
    "scan_text_corpus": "SELECT 'field=text' AS business_id, text FROM benchmark",
    "business_records": 'SELECT doc_id AS "ID", lang AS "Language", md5(text) AS "Text" FROM documents',
    "few_shot_examples": """SELECT n_name AS topic, 'x' AS thema, 'A "' || n_name || '"' AS argument, 'pro' AS label, CAST(NULL AS VARCHAR) AS reasoning FROM nation""",
    "save_results": """SELECT event_id, event_type, value, 0.8::DOUBLE AS similarity_threshold, 'alles; src1' AS selected_sources,
  'argument_analysis__business_id_20210046__MODEL' AS folder FROM events""",
    "collection_table": f"""WITH {sql_sentences("s", "documents", "doc_id, source", "text")}
SELECT source || '-' || doc_id || '.' || sent_id AS id, sentence AS document, source AS business_id, CAST(doc_id AS VARCHAR) AS filename,
  'https://www.parlament.ch/de/ratsbetrieb/suche-curia-vista/geschaeft?AffairId=' || source AS url FROM s""",
}
