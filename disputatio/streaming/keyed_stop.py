"""Early stop on a stream as a keyed state: one count of neutral rows per open topic, in the RocksDB state store.

Before the exchange every task cuts the rows of a topic at the ``limit``-th neutral one among those it sees, so a
hot topic brings a few rows per task to its state and not all it has. A closed topic keeps its count until the
watermark has passed the stop by ``forget_after_ms``; then a timer clears it, and the state holds open topics only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Names that do not begin with an underscore, as the state's reader renames such columns.
NEUTRAL, TOPIC = "is_neutral", "topic_key"
DAY_MS = 24 * 3600 * 1000


def leading(frame: pd.DataFrame, order: Sequence[str], left: int) -> pd.DataFrame:
    """Rows of one topic in order, up to the neutral row that uses up what is left."""
    frame = frame.sort_values(list(order), kind="stable")
    before = frame[NEUTRAL].cumsum() - frame[NEUTRAL]
    return frame[before < left]


def cut_in_tasks(rows: DataFrame, group: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Drop what cannot pass: rows behind the ``limit``-th neutral row of their topic in the same Arrow batch."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values(list(order), kind="stable")
            neutral = batch[NEUTRAL].astype("int64")
            seen = neutral.groupby([batch[g] for g in group], dropna=False).cumsum() - neutral
            yield batch[seen < limit]

    return rows.mapInPandas(cut, rows.schema)


class KeyedStop(StatefulProcessor):
    """Hands on a topic's rows until its ``limit``-th neutral row, whatever batch that comes in."""

    def __init__(self, order: Sequence[str], limit: int, time: str, forget_after_ms: int):
        self.order, self.limit, self.time, self.forget_after_ms = list(order), limit, time, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.neutrals = handle.getValueState("neutrals", "n int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.neutrals.get()[0] if self.neutrals.exists() else 0
        kept = None
        for frame in rows:
            if before < self.limit:
                # What lies behind the cut so far can go at once.
                kept = leading(frame if kept is None else pd.concat([kept, frame]), self.order, self.limit - before)
        if kept is None or kept.empty:
            return
        found = int(kept[NEUTRAL].sum())
        if found:
            self.neutrals.update((before + found,))
        if before + found >= self.limit:
            last = pd.Timestamp(kept[self.time].max())
            self.handle.registerTimer(int(last.value // 1_000_000) + self.forget_after_ms)
        yield kept.drop(columns=[NEUTRAL, TOPIC])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.neutrals.clear()
        return iter([])

    def close(self) -> None:
        pass


def stop_on_stream(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], neutral: Column, time: str, limit: int = 3, late: str = "1 day", forget_after_ms: int = DAY_MS
) -> DataFrame:
    """The rows of a stream up to each topic's ``limit``-th neutral row, with the columns of the stream.

    ``group`` names the topic, ``order`` the rank inside a micro-batch, ``time`` the event time (a timestamp with time zone).
    Across micro-batches arrival decides. Rows more than ``late`` behind the newest event time are dropped; a topic that comes
    back after its stop has been forgotten starts anew. A null topic is a topic, null ``neutral`` counts as not neutral.
    Whole numbers pass pandas: next to nulls they are exact up to 2^53.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # The topic as a text, as a missing number is no key of the state's reader.
    marked = rows.withColumns({NEUTRAL: F.coalesce(neutral, F.lit(False)), TOPIC: F.to_json(F.struct(*group))})
    cut = cut_in_tasks(marked, [TOPIC], order, limit).withWatermark(time, late)
    processor = KeyedStop(order, limit, time, forget_after_ms)
    return cut.groupBy(TOPIC).transformWithStateInPandas(processor, rows.schema, "append", "EventTime")


def start_keyed_stop(rows: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the rows to Parquet files; a restart with the same checkpoint goes on with the counts it had."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(out)


def open_topics(spark, checkpoint: str) -> DataFrame:
    """The state as a table: ``topic_key, n`` for each topic that has had a neutral row and is not forgotten."""
    reader = spark.read.format("statestore").option("stateVarName", "neutrals")
    return reader.load(checkpoint).select("key.*", "value.n")
