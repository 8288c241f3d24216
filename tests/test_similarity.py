import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from disputatio.operators.evidence import with_best_sentence, with_best_sentence_by_ratio
from disputatio.operators.similarity import (
    _Best,
    _Carried,
    approximate_cosine_join,
    centroids,
    cosine,
    cosine_top_k,
    text_matches,
    text_top_k,
)


def tokens(text):
    return set(re.findall(r"[^\W\d_]+", text.lower()))


def texts(n, seed, copies=0):
    """Random word bags; `copies` of them are one and the same hot text."""
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "a"] * 6 + [f"{c}{d}" for c in "abcdefgh" for d in ("lpha", "eta", "amma", "lt")]
    made = [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 9))) for _ in range(n)]
    return made + ["the of alpha beta"] * copies


def brute(topics, corpus, threshold, k, strict=False):
    out = set()
    for t in topics:
        scored = []
        for i, c in enumerate(corpus):
            a, b = tokens(t), tokens(c)
            if a and b:
                s = len(a & b) / len(a | b)
                if s > threshold or (s == threshold and not strict):
                    scored.append((-s, i))
        for rank, (s, i) in enumerate(sorted(scored)[:k]):
            out.add((t, i, round(-s, 9), rank, min(k, len(scored))))
    return out


@pytest.mark.parametrize("threshold", [0.1, 0.25, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("bound", [64_000_000, 0])
@pytest.mark.parametrize("strict", [False, True])
def test_text_search_equals_brute_force(spark, threshold, bound, strict):
    topics, corpus = sorted(set(texts(12, 1) + ["the of alpha beta", "!"])), texts(60, 2, copies=30)
    t = spark.createDataFrame([(x,) for x in topics], "topic string")
    c = spark.createDataFrame(list(enumerate(corpus)), "id int, body string").repartition(5)
    got = text_top_k(
        t, c, topic="topic", corpus_key=["id"], corpus_text="body", threshold=threshold, k=7, strict=strict, broadcast_bytes=bound, two_level=bound == 0
    )
    rows = {(r["topic"], r["id"], round(r["similarity"], 9), r["rank"], r["num_matches"]) for r in got.collect()}
    assert rows == brute(topics, corpus, threshold, 7, strict)
    assert "body" in got.columns


def test_a_search_with_few_topics_copies_no_sentence(spark):
    """Sentences meet the topics in their own batches: no row per word, no join, and the same hits as by the join."""
    topics = sorted(set(texts(40, 5) + ["ärger the of", "unknown words"]))
    corpus = [*texts(300, 6, copies=25), None, "", "1 2 3", "ÄRGER the The of", "the of a nowhere known"]
    t = spark.createDataFrame([(x,) for x in topics], "topic string")
    c = spark.createDataFrame([(i % 200 if i % 9 else None, x, [i]) for i, x in enumerate(corpus)], "id int, body string, more array<int>").repartition(3)
    got = text_top_k(t, c, topic="topic", corpus_key=["id"], corpus_text="body", threshold=0.3, k=10**6, two_level=False)
    want = text_matches(t, c, topic="topic", corpus_text="body", threshold=0.3)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_text_matches_has_no_cut(spark):
    topics, corpus = sorted(set(texts(5, 3))), texts(30, 4)
    t = spark.createDataFrame([(x,) for x in topics], "topic string")
    c = spark.createDataFrame(list(enumerate(corpus)), "id int, body string")
    got = text_matches(t, c, topic="topic", corpus_text="body", threshold=0.2)
    assert {(r["topic"], r["id"]) for r in got.collect()} == {(a, b) for a, b, *_ in brute(topics, corpus, 0.2, 10**9)}
    shuffled = text_matches(t, c, topic="topic", corpus_text="body", threshold=0.2, broadcast_bytes=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, got.collect()))
    with pytest.raises(ValueError):
        text_matches(t, c, topic="topic", corpus_text="body", threshold=0)


def vectors(n, seed, dim=8):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, dim)).astype(np.float32)
    made[n // 2 :: 7] = made[0]  # copies
    return made


def brute_cosine(topics, corpus, threshold, k, strict):
    unit = lambda m: m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    sims = np.round(unit(topics) @ unit(corpus).T, 10)
    out = set()
    for j, row in enumerate(sims):
        ok = [(-s, i) for i, s in enumerate(row) if s > threshold or (s == threshold and not strict)]
        out |= {(j, i, round(-s, 8), rank) for rank, (s, i) in enumerate(sorted(ok)[:k])}
    return out


@pytest.mark.parametrize("cells", [4_000_000, 60])
@pytest.mark.parametrize("strict", [False, True])
def test_cosine_search_equals_brute_force(spark, cells, strict):
    topics, corpus = vectors(6, 1), vectors(90, 1)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(topics)], "topic_id int, vector array<float>")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "corpus_id long, vector array<float>").repartition(4)
    got = cosine_top_k(t, c, threshold=0.2, k=5, strict=strict, broadcast_cells=cells, block_rows=25)
    rows = {(r["topic_id"], r["corpus_id"], round(r["similarity"], 8), r["rank"]) for r in got.collect()}
    assert rows == brute_cosine(topics, corpus, 0.2, 5, strict)


def test_cosine_without_topics(spark):
    t = spark.createDataFrame([], "topic_id int, vector array<float>")
    c = spark.createDataFrame([(1, [1.0])], "corpus_id long, vector array<float>")
    assert cosine_top_k(t, c, threshold=0.1).collect() == []


def test_cosine_column_and_centroids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 4.0])], "label int, v array<float>")
    mean = {r["topic_id"]: r["vector"] for r in centroids(df, "label", "v").collect()}
    assert mean == {1: [0.5, 0.5], 2: [3.0, 4.0]}
    assert df.select(cosine(F.col("v"), F.array(F.lit(4.0), F.lit(3.0))).alias("c")).collect()[2]["c"] == pytest.approx(24 / 25)


def test_approximate_join_recall(spark, small):
    emb = spark.read.parquet(f"{small}/embeddings.parquet")
    t = centroids(emb, "label", "embedding")
    c = emb.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vector"))
    exact = {(r["topic_id"], r["corpus_id"]) for r in cosine_top_k(t, c, threshold=0.2, k=10**6).collect()}
    near = {(r["topic_id"], r["corpus_id"]) for r in approximate_cosine_join(t, c, threshold=0.2).collect()}
    assert near <= exact
    assert len(near) >= 0.9 * len(exact)


def test_best_sentence(spark):
    rows = [
        ("", "Erster Satz. Zweiter.", "Erster Satz.", 0),
        ("zweiter", "Erster Satz. Zweiter. zweiter.", "Zweiter.", 1),
        ("abc", "", None, None),
    ]
    df = spark.createDataFrame([(q, c) for q, c, *_ in rows], "q string, c string")
    got = with_best_sentence(df, "q", "c").collect()
    assert [(r["best_sentence"], r["best_pos"]) for r in got] == [(s, p) for *_, s, p in rows]


def test_best_sentence_by_ratio_equals_brute_force(spark, small):
    from difflib import SequenceMatcher

    rows = [("abcd", "bcde"), ("", "eins. zwei."), ("xyz", ""), ("drei zwei", "eins. zwei drei. drei zwei eins")]
    df = spark.createDataFrame(rows, "q string, c string")
    got = with_best_sentence_by_ratio(df, "q", "c").collect()
    assert got[0]["best_score"] == 0.75
    for (query, context), row in zip(rows, got):
        sentences = [s.strip() for s in re.findall(r"[^.!?\n]+[.!?]*", context) if s.strip()]
        ratios = [SequenceMatcher(None, query, s).ratio() for s in sentences]
        want = None if not ratios else ratios.index(max(ratios))
        assert row["best_pos"] == want
        assert row["best_sentence"] == (None if want is None else sentences[want])


def test_carried_rows_outlive_those_no_topic_keeps(monkeypatch):
    monkeypatch.setattr("disputatio.operators.similarity.CARRIED_ROWS", 3)
    best = _Best(1, 2)
    rows = _Carried(best)
    for low in range(0, 40, 4):
        ids = np.arange(low, low + 4)
        best.add(0, 1.0 / (1 + np.abs(ids - 17)), ids)
        rows.add(ids, pa.RecordBatch.from_arrays([pa.array([f"row {i}" for i in ids])], ["name"]))
    ids = best.kept[0][1]
    assert sorted(ids) == [16, 17] and rows.of(ids)[0].to_pylist() == [f"row {i}" for i in ids] and rows.count < 12
