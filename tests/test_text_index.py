"""The saved inverted index against all pairs and against the search without it; growth; what a search reads."""

import os
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from disputatio.operators.similarity import text_top_k
from disputatio.operators.text_index import build_text_index, common_words, extend_text_index, indexed_top_k, open_text_index

WORDS = ["the", "of", "law", "forest", "tax", "vote", "über", "new", "old", "house", *[f"w{chr(97 + i)}" for i in range(20)]]


def sentences(seed, count):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(WORDS, weights=[30, 20, 8, 5, 5, 4, 4, 4, 4, 4, *[1] * 20], k=r.randint(1, 9)))) for i in range(count)]
    return rows + [(count, None), (count + 1, ""), (count + 2, "1 2 3"), (count + 3, rows[0][1]), (count + 4, rows[0][1].upper())]


def plain(topics, rows, threshold, k):
    out = set()
    for t in topics:
        a = set(re.findall(r"[^\W\d_]+", t.lower()))
        found = []
        for key, text in rows:
            b = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
            if a and b and len(a & b) / len(a | b) >= threshold:
                found.append((-len(a & b) / len(a | b), key))
        out |= {(t, key, n, min(len(found), k)) for n, (_, key) in enumerate(sorted(found)[:k])}
    return out


def name():
    return f"index_{uuid.uuid4().hex}"


@pytest.mark.parametrize("threshold,k,bound", [(0.25, 1000, 1 << 20), (0.5, 3, 1 << 20), (0.4, 1000, 0), (1.0, 5, 0)])
def test_equals_all_pairs(spark, tmp_path, threshold, k, bound):
    rows = sentences(1, 250)
    asked = [t for _, t in sentences(2, 25) if t] + ["nothing known"]
    corpus = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, token string")
    index = build_text_index(corpus, ["id"], "text", name(), str(tmp_path / "index"), buckets=4)
    topics = spark.createDataFrame([(t,) for t in dict.fromkeys(asked)], "topic string")
    got = indexed_top_k(topics, index, topic="topic", threshold=threshold, k=k, broadcast_bytes=bound)
    assert {(r.topic, r.id, r.rank, r.num_matches) for r in got.collect()} == plain(dict.fromkeys(asked), rows, threshold, k)


def test_growth_keeps_the_order_and_the_known_rows(spark, tmp_path):
    rows, label = sentences(3, 200), name()
    make = lambda some: spark.createDataFrame(some, "id long, text string")
    build_text_index(make(rows[:50]), ["id"], "text", label, str(tmp_path / "index"), buckets=4)
    before = open_text_index(spark, label, ["id"]).tiers
    index = extend_text_index(spark, label, make([(0, "another text"), *rows[40:]]), ["id"], "text")
    assert index.tiers == before
    topics = make(rows[:30]).where("text <> ''").select(F.col("text").alias("topic")).distinct()
    corpus = make(rows)
    want = text_top_k(topics, corpus, topic="topic", corpus_key=["id"], corpus_text="text", threshold=0.3).select("topic", "id", "similarity", "rank", "num_matches")
    got = indexed_top_k(topics, index, topic="topic", threshold=0.3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_search_reads_no_text_and_does_not_move_the_postings(spark, tmp_path):
    corpus = spark.createDataFrame(sentences(4, 100), "id long, text string")
    index = build_text_index(corpus, ["id"], "text", name(), str(tmp_path / "index"), buckets=4)
    topics = spark.createDataFrame([("the new forest law",)], "topic string")
    plan = indexed_top_k(topics, index, topic="topic", threshold=0.3)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "text#" not in physical
    scan = next(line for line in physical.splitlines() if "_postings" in line)
    assert "Bucketed: true" in scan or "Bucketed: false (disabled by query planner)" in scan
    above = physical[: physical.index(scan)].splitlines()[::-1]
    join = next(n for n, line in enumerate(above) if "Join" in line)
    assert "BroadcastHashJoin" in above[join] and not any("Exchange hashpartitioning" in line for line in above[:join])


def test_the_corpus_is_read_once_for_its_common_words(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(_):
        calls.add(1)
        return True

    rows = [(f"the w{chr(97 + i % 26)}",) for i in range(200)] + [(None,), ("",)]
    corpus = spark.createDataFrame(rows, "text string").where(F.udf(seen, "boolean")("text"))
    tiers = common_words(corpus, "text")
    assert tiers[2] == ["the"] and len(tiers[1]) == 26 and not tiers[0]
    assert calls.value == len(rows)


def test_pairs_move_under_the_number_of_their_topic(spark, tmp_path):
    corpus = spark.createDataFrame(sentences(5, 100), "id long, text string")
    index = build_text_index(corpus, ["id"], "text", name(), str(tmp_path / "index"), buckets=4)
    topics = spark.createDataFrame([("the new forest law",)], "topic string")
    plan = indexed_top_k(topics, index, topic="topic", threshold=0.3)._jdf.queryExecution().executedPlan().toString()
    grouped = next(line for line in plan.splitlines()[::-1] if "Aggregate(keys=[" in line and "id#" in line)
    assert "topic#" not in grouped.replace("_topic#", "")


def test_the_bound_on_thresholds_and_the_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, text string")
    index = build_text_index(empty, ["id"], "text", name(), str(tmp_path / "index"), buckets=2)
    topics = spark.createDataFrame([("a b",)], "topic string")
    assert indexed_top_k(topics, index, topic="topic", threshold=0.5).count() == 0
    with pytest.raises(ValueError):
        indexed_top_k(topics, index, topic="topic", threshold=0.1)


def test_common_words_by_tier(spark):
    rows = [(f"the w{chr(97 + i % 26)}{chr(97 + i // 26)}" + (" law" if i % 20 == 0 else ""),) for i in range(400)]
    tiers = common_words(spark.createDataFrame(rows, "text string"), "text")
    assert "the" in tiers[2] and "law" in tiers[1] and sum(map(len, tiers)) == 2


def test_the_index_holds_no_more_than_a_search_reads(spark, tmp_path):
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).removeprefix("file:")
    left = lambda: {f for f in os.listdir(base) if f.startswith("sets-")} if os.path.isdir(base) else set()
    before, label = left(), name()
    make = lambda some: spark.createDataFrame(some, "id long, text string")
    build_text_index(make(sentences(6, 40)), ["id"], "text", label, str(tmp_path / "index"), buckets=4)
    index = extend_text_index(spark, label, make([(1000, "a new forest law"), (0, "known"), (None, "no key")]), ["id"], "text")
    assert index.postings.columns == ["id", "size", "place", "token"] and index.sets.columns == ["id", "tokens"]
    assert {" ".join(sorted(r.tokens.split(" "))) for r in index.sets.where("id = 1000 OR id IS NULL").collect()} == {"a forest law new", "key no"}
    assert index.sets.where("id = 0").count() == 1 and left() == before


def test_pairs_without_enough_words_left_do_not_move(spark, tmp_path):
    corpus = spark.createDataFrame(sentences(7, 100), "id long, text string")
    index = build_text_index(corpus, ["id"], "text", name(), str(tmp_path / "index"), buckets=4)
    topics = spark.createDataFrame([("the new forest law",)], "topic string")
    plan = indexed_top_k(topics, index, topic="topic", threshold=0.3)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    join = next(n for n, line in enumerate(lines) if "BroadcastHashJoin" in line and "token#" in line)
    assert "place#" in lines[join] and "_at#" in lines[join] or any("place#" in line and "_at#" in line for line in lines[join - 2 : join])
    assert plan.count("Exchange hashpartitioning(id#") == 1
