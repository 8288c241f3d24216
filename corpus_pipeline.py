"""A corpus from raw documents to token ids, in stages; each reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputatio.llm.common import broadcast_if_small, identified, saved, scratch
from disputatio.llm.jaccard_join import jaccard_components
from disputatio.llm.language_id import UNKNOWN, learn_pieces, predict_language
from disputatio.llm.mixing import mix
from disputatio.llm.pii import find_personal_data, redacted, train_span_model
from disputatio.llm.sentencepiece_codec import encode


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language (no letters); a missing language is filled in."""
    learned = learn_pieces(docs, F.lit(True))
    found = predict_language(docs, learned, lang_pred="_lang", score="_score").where(F.col("_lang") != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "_lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group linked by five-word shingles at a similarity of 0.8.

    Rows that share an id are one document, of which one row stays. Rows without an id all stay.
    """
    with scratch(spark):
        found = saved(jaccard_components(docs, size=5, percent=80), "groups")
        gone = saved(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone", keep=True)
        several = saved(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "several", keep=True)
    kept = docs.join(broadcast_if_small(gone, 16), "doc_id", "left_anti")
    if not several.isEmpty():
        several = broadcast_if_small(several, 16)
        kept = kept.join(several, "doc_id", "left_anti").unionByName(kept.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind."""
    found = find_personal_data(docs, train_span_model(docs), base="_base", spans="_spans")
    found = found.withColumn("text", redacted(F.col("text"), F.col("_spans")))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take whole documents as often as the mix wants them, in the order of training.

    The mix is planned on sizes alone; texts join the plan once it stands, and are sorted.
    """
    rows = identified(docs, "_row")
    mixed = mix(rows, carry=["_row"], whole_documents=True)
    plan = saved(mixed.where("taken > 0").select(F.col("_carried__row").alias("_row"), F.explode("positions").alias("_at")), "plan")
    return rows.join(plan, "_row").orderBy("_at", "doc_id").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text."""
    coded = encode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixture),
    ("sentencepiece", token_ids),
]

# Language identification, the boosted trees and piece ids are beyond SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
