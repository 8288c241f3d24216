"""Queries on the texts of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disputatio.llm.jaccard_join import jaccard_components
from disputatio.llm.language_id import learn_pieces, predict_language
from disputatio.llm.pii import KINDS, find_personal_data, joined, train_span_model
from disputatio.llm.quality import score_quality
from disputatio.llm.sentencepiece_codec import decode, encode
from disputatio.llm.substring_dedup import repeated_passages


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out() -> Column:
    """The fold that language identification never learns from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = learn_pieces(docs, ~held_out())
    return predict_language(docs.select("doc_id", "text", held_out().alias("held_out")), learned).drop("text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = find_personal_data(docs.select("doc_id", "text"), train_span_model(docs))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(documents(spark, sf_dir).select("doc_id", "text")))
    return coded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP10 = """WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))) END AS s FROM worded),
classes AS (SELECT s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT rep, len(s) AS n, unnest(s) AS token FROM classes),
common AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM tokens a JOIN tokens b ON a.token = b.token AND a.rep <> b.rep
  AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM common WHERE 100 * k >= 85 * (n + m - k)),
reach AS (SELECT rep AS node, rep AS other FROM classes UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
named AS (SELECT s, component_id FROM classes JOIN low ON rep = node)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM sets d LEFT JOIN named n ON d.s = n.s"""

QUERIES = {
    "op3_language_id": op3_language_id, "op4_quality": op4_quality, "op6_pii": op6_pii,
    "op7_sentencepiece": op7_sentencepiece, "op8_substring_dedup": op8_substring_dedup, "op10_jaccard_join": op10_jaccard_join,
}
ORACLE = {"op10_jaccard_join": OP10}
