"""Search on a stream of documents: results arrive as documents do."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from disputatio.operators.similarity import text_matches
from disputatio.operators.stance import is_argument
from disputatio.plans.mining import MiningOptions, build_collection, classify


def stream_table(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    pattern: str = "*.parquet",
    files_per_batch: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Parquet files as a stream, oldest first; ``partitions`` spreads batches of few files over more tasks."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(path)
    return rows if partitions is None else rows.repartition(partitions)


def stream_matches(
    documents: DataFrame, topics: DataFrame, keys: Sequence[str], text: str, lang: str, options: MiningOptions
) -> DataFrame:
    """Classified matches of streamed documents with a static set of topics; rows are only appended.

    Sentences, contexts and matches need nothing but the document and the topics, so there is no state.
    The word lists of the topics are checked for size and sent to the executors.
    """
    sentences = build_collection(documents, keys, text, lang, html=False)
    hits = text_matches(
        topics.select("topic_rewritten").distinct(),
        sentences,
        topic="topic_rewritten",
        corpus_text="new_sentence",
        threshold=options.similarity_threshold,
    )
    # the exchange evens out tasks with many matches and keeps the join's generated code small
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return classify(hits.repartition(tasks), options)


def start_append(rows: DataFrame, out: str, checkpoint: str, name: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append a stream to Parquet files; the checkpoint makes a restart go on where it stopped."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(out)


def cancel(query: StreamingQuery) -> None:
    """Stop a running search. Finished micro-batches stay; a restart with the same checkpoint resumes."""
    query.stop()


def observed(rows: DataFrame, name: str = "progress") -> DataFrame:
    """Count analysed rows and arguments of every micro-batch on the way through."""
    return rows.observe(
        name,
        F.count(F.lit(1)).alias("analyzed"),
        F.coalesce(F.sum(is_argument(F.col("label")).cast("int")), F.lit(0)).alias("arguments"),
    )


class ProgressListener(StreamingQueryListener):
    """Hands the observed counts of each finished micro-batch to a callback."""

    def __init__(self, report: Callable[[int, int, int], None], name: str = "progress"):
        self.report = report
        self.name = name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.report(event.progress.batchId, row["analyzed"], row["arguments"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
