"""Queries on vector search: label centroids as topics, the embeddings table as the collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import table
from disputatio.operators.ball_index import build_ball_index, vector_threshold_join
from disputatio.operators.reshape import zip_explode
from disputatio.operators.similarity import (
    above,
    approximate_cosine_join,
    centroids,
    cosine,
    cosine_top_k,
    with_num_matches,
)
from disputatio.session import work_dir

THRESHOLD = 0.1
SHORT_THRESHOLD = 0.2
CLOSE = 0.4


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vector"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_num_matches(cosine_top_k(topics(spark, sf_dir), corpus(spark, sf_dir), threshold=THRESHOLD), ["topic_id"])


def short_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_top_k(topics(spark, sf_dir), corpus(spark, sf_dir), threshold=SHORT_THRESHOLD, k=10, strict=True)


def q_topk_cosine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("topic_id", "corpus_id", F.round("similarity", 6).alias("similarity"))


def q_top10_semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = short_hits(spark, sf_dir).select("topic_id", "corpus_id", F.round("similarity", 6).alias("similarity"))
    return rows.orderBy("topic_id", "corpus_id")


def q_hit_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = short_hits(spark, sf_dir).select(F.col("corpus_id").alias("vec_id"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label").join(found, "vec_id", "left_semi")


def q_similarity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("topic_id", "corpus_id", "rank")


def q_num_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).groupBy("topic_id").agg(F.count(F.lit(1)).alias("num_matches"))


def q_similarity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the centroid of its own label; inclusive test kept, strict test as a flag."""
    rows = table(spark, sf_dir, "embeddings").join(topics(spark, sf_dir).withColumnRenamed("topic_id", "label"), "label")
    scored = rows.select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("vector")), 10).alias("similarity"))
    kept = scored.where(above(F.col("similarity"), SHORT_THRESHOLD))
    return kept.select("vec_id", "label", F.round("similarity", 6).alias("similarity"), above(F.col("similarity"), 0.3, strict=True).alias("close"))


def q_hit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("corpus_id"), F.col("label").cast("string").alias("business_id"), F.concat(F.lit("vector-"), "vec_id").alias("filename")
    )
    rows = hits(spark, sf_dir).join(meta, "corpus_id")
    return rows.select("topic_id", "corpus_id", "business_id", "filename", (F.floor(F.col("similarity") * 100 + 0.5) / 100).alias("similarity"))


def q_zip_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results as parallel arrays per topic (at most k long), turned back into rows."""
    entry = F.struct("rank", "corpus_id", "similarity")
    lists = hits(spark, sf_dir).groupBy("topic_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    arrays = lists.select(
        "topic_id",
        F.transform("e", lambda x: x["corpus_id"]).alias("ids"),
        F.transform("e", lambda x: F.round(1 - x["similarity"], 6)).alias("distances"),
    )
    return zip_explode(arrays, ["topic_id"], {"corpus_id": "ids", "distance": "distances"})


def q_lsh_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = approximate_cosine_join(topics(spark, sf_dir), corpus(spark, sf_dir), threshold=SHORT_THRESHOLD)
    return rows.withColumn("similarity", F.round("similarity", 6))


def q_vector_threshold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label's centroid against all vectors, from an index built first; what the approximate join finds in part."""
    index = build_ball_index(corpus(spark, sf_dir), work_dir(spark, "balls"))
    return vector_threshold_join(topics(spark, sf_dir), index, SHORT_THRESHOLD).withColumn("similarity", F.round("similarity", 6))


def q_vector_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of vectors with a cosine of 0.4 or more, each once."""
    rows = corpus(spark, sf_dir)
    index = build_ball_index(rows, work_dir(spark, "balls"))
    found = vector_threshold_join(rows.withColumnRenamed("corpus_id", "topic_id"), index, CLOSE)
    return found.where("topic_id < corpus_id").withColumn("similarity", F.round("similarity", 6))


SQL_BASE = """WITH cells AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS d FROM embeddings),
topics AS (SELECT label AS topic_id, list(a ORDER BY d) AS cv FROM (SELECT label, d, avg(v) AS a FROM cells GROUP BY ALL) GROUP BY label),
sims AS (SELECT topic_id, vec_id AS corpus_id, label, round(list_cosine_similarity(cv, embedding::DOUBLE[]), 10) AS similarity FROM topics, embeddings)"""


def sql_ranked(threshold: float, k: int, op: str = ">=") -> str:
    return f"""{SQL_BASE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY similarity DESC, corpus_id) AS rn FROM sims WHERE similarity {op} {threshold}),
hits AS (SELECT *, CAST(rn - 1 AS INTEGER) AS rank FROM ranked WHERE rn <= {k})"""


QUERIES = {
    "topk_cosine_join": q_topk_cosine_join,
    "top10_semantic_search": q_top10_semantic_search,
    "hit_semi_join": q_hit_semi_join,
    "similarity_rank": q_similarity_rank,
    "num_matches": q_num_matches,
    "similarity_filter": q_similarity_filter,
    "hit_projection": q_hit_projection,
    "zip_explode": q_zip_explode,
    "lsh_similarity_join": q_lsh_similarity_join,
    "vector_threshold_join": q_vector_threshold_join,
    "vector_self_join": q_vector_self_join,
}

ALL, TEN = sql_ranked(THRESHOLD, 1000), sql_ranked(SHORT_THRESHOLD, 10, ">")

ORACLE = {
    "topk_cosine_join": f"{ALL} SELECT CAST(topic_id AS BIGINT) AS topic_id, corpus_id, round(similarity, 6) AS similarity FROM hits",
    "top10_semantic_search": f"{TEN} SELECT CAST(topic_id AS BIGINT) AS topic_id, corpus_id, round(similarity, 6) AS similarity FROM hits ORDER BY topic_id, corpus_id",
    "hit_semi_join": f"{TEN} SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT corpus_id FROM hits)",
    "similarity_rank": f"{ALL} SELECT CAST(topic_id AS BIGINT) AS topic_id, corpus_id, rank FROM hits",
    "num_matches": f"{ALL} SELECT CAST(topic_id AS BIGINT) AS topic_id, count(*) AS num_matches FROM hits GROUP BY topic_id",
    "similarity_filter": f"""{SQL_BASE} SELECT corpus_id AS vec_id, label, round(similarity, 6) AS similarity, similarity > 0.3 AS close
FROM sims WHERE label = topic_id AND similarity >= {SHORT_THRESHOLD}""",
    "hit_projection": f"""{ALL} SELECT CAST(topic_id AS BIGINT) AS topic_id, corpus_id, CAST(label AS VARCHAR) AS business_id,
'vector-' || corpus_id AS filename, floor(similarity * 100 + 0.5) / 100 AS similarity FROM hits""",
    "vector_threshold_join": f"""{SQL_BASE} SELECT CAST(topic_id AS BIGINT) AS topic_id, corpus_id, round(similarity, 6) AS similarity FROM sims
WHERE similarity >= {SHORT_THRESHOLD}""",
    "vector_self_join": f"""SELECT a.vec_id AS topic_id, b.vec_id AS corpus_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) >= {CLOSE}""",
    "zip_explode": f"{ALL} SELECT CAST(topic_id AS BIGINT) AS topic_id, rank AS pos, corpus_id, round(1 - similarity, 6) AS distance FROM hits",
}
