"""Streaming queries: the tables arrive as a stream, the collected output is compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import table
from catalog.mining import OPTIONS, sql_hits, sql_labelled, topics
from disputatio.session import work_dir
from disputatio.streaming.incremental import observed, start_append, stream_matches, stream_table
from disputatio.streaming.keyed_stop import start_keyed_stop, stop_on_stream


def q_stream_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "documents").schema
    documents = stream_table(spark, sf_dir, schema, "documents*.parquet", partitions=spark.sparkContext.defaultParallelism)
    rows = stream_matches(documents, topics(spark, sf_dir), ["doc_id", "source"], "text", "lang", OPTIONS)
    rows = observed(rows).select("topic_rewritten", "doc_id", "sent_id", F.round("similarity", 6).alias("similarity"), "label")
    folder = work_dir(spark, "stream-matches")
    start_append(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


ROUNDS = 3


def q_stream_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hits of a user's search: views and clicks count as neutral.

    The events land in parts, by number. After each part the stream is started, reads what is new and ends, so every part is a
    micro-batch of its own and every one but the first goes on from the state a former run left.
    """
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    bounds = events.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).first()
    part = F.least(F.floor((F.col("event_id") - bounds.low) * ROUNDS / F.greatest(F.lit(bounds.high - bounds.low), F.lit(1))), F.lit(ROUNDS - 1))
    folder = work_dir(spark, "stream-stop")
    for number in range(ROUNDS):
        events.where(part == number).write.mode("append").parquet(f"{folder}/in")
        rows = stream_table(spark, f"{folder}/in", events.schema)
        kept = stop_on_stream(rows, ["user_id"], ["event_id"], F.col("event_type").isin("view", "click"), "ts", late="3650 days")
        start_keyed_stop(kept.drop("ts"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(events.drop("ts").schema).parquet(f"{folder}/out")


QUERIES = {"stream_matches": q_stream_matches, "stream_early_stop": q_stream_early_stop}

ORACLE = {
    "stream_matches": f"""{sql_hits(1_000_000_000)},{sql_labelled(0.8)}
SELECT topic_rewritten, doc_id, sent_id, round(similarity, 6) AS similarity, label FROM labelled""",
    "stream_early_stop": """WITH s AS (SELECT user_id, event_id, event_type, coalesce(sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM events)
SELECT user_id, event_id, event_type FROM s WHERE seen < 3""",
}
