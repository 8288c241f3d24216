"""Early stop with keyed state: several micro-batches with restarts against a plain loop, the state's size, forgetting."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from disputatio.streaming.incremental import stream_table
from disputatio.streaming.keyed_stop import NEUTRAL, cut_in_tasks, open_topics, start_keyed_stop, stop_on_stream
from disputatio.streaming.stateful import stop_with_state

SCHEMA = "topic string, rank long, label string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def rounds(seed, count=3, hot=300):
    r = random.Random(seed)
    out, rank = [], 0
    for number in range(count):
        rows = []
        for _ in range(60):
            rank += 1
            rows.append((r.choice(["a", "b", None, "c", f"t{rank % 9}"]), rank, r.choice(["pro", "neutral", "contra", None]), START + dt.timedelta(hours=number)))
        for _ in range(hot):
            rank += 1
            rows.append(("hot", rank, "neutral" if rank % 50 == 0 else "pro", START + dt.timedelta(hours=number)))
        r.shuffle(rows)
        out.append(rows)
    return out


def plain(batches, limit):
    seen, kept = {}, []
    for batch in batches:
        for row in sorted(batch, key=lambda x: x[1]):
            if seen.get(row[0], 0) < limit:
                kept.append(row[:3])
                seen[row[0]] = seen.get(row[0], 0) + (row[2] == "neutral")
    return kept, seen


def run(spark, folder, batches, **options):
    states = []
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).repartition(4).write.mode("append").parquet(f"{folder}/in")
        rows = stream_table(spark, f"{folder}/in", SCHEMA)
        kept = stop_on_stream(rows, ["topic"], ["rank"], F.col("label") == "neutral", "ts", **options)
        start_keyed_stop(kept, f"{folder}/out", f"{folder}/check").awaitTermination()
        states.append({json.loads(r.topic_key).get("topic"): r.n for r in open_topics(spark, f"{folder}/check").collect()})
    return spark.read.parquet(f"{folder}/out").collect(), states


def test_batches_with_restarts_equal_the_loop(spark, tmp_path):
    batches = rounds(1)
    got, states = run(spark, tmp_path, batches, late="30 days")
    want, seen = plain(batches, 3)
    assert sorted((r.topic or "", r.rank) for r in got) == sorted((t or "", rank) for t, rank, _ in want)
    assert states[-1] == {t: n for t, n in seen.items() if n}


def test_closed_topics_are_forgotten_when_the_watermark_passes(spark, tmp_path):
    late = START + dt.timedelta(days=9)
    batches = [
        [("a", i, "neutral", START) for i in range(3)] + [("b", 10, "neutral", START), ("b", 11, "pro", START)],
        [("b", 20, "pro", late), ("c", 21, "neutral", late)],
        [("c", 30, "pro", late)],
    ]
    got, states = run(spark, tmp_path, batches, late="1 hour", forget_after_ms=3_600_000)
    assert states[0] == {"a": 3, "b": 1}
    assert states[-1] == {"b": 1, "c": 1}
    assert len(got) == 8


def test_a_hot_topic_is_cut_in_the_tasks(spark):
    rows = [("hot", i, i % 10 == 0) for i in range(5000)] + [(None, i, True) for i in range(50)]
    df = spark.createDataFrame(rows, f"topic string, rank long, {NEUTRAL} boolean").repartition(4)
    kept = cut_in_tasks(df, ["topic"], ["rank"], 3)
    counts = {r.topic: r["count"] for r in kept.groupBy("topic").count().collect()}
    assert counts["hot"] < 600 and 3 <= counts[None] <= 12
    assert {r.rank for r in kept.where("topic = 'hot'").collect()} >= set(range(21))


@pytest.mark.parametrize("count", [None, 2])
def test_null_groups_stop_in_versioned_counts(spark, count):
    rows = spark.createDataFrame([(None, i, True) for i in range(6)], "g string, pos long, neutral boolean")
    before = None if count is None else spark.createDataFrame([(None, count)], "g string, neutrals int")
    kept = stop_with_state(rows, before, ["g"], [F.col("pos")], F.col("neutral"), 3)
    assert kept.count() == (3 if count is None else 1)
