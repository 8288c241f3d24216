"""Counted models against plain ones; odd rows; the argument search by vectors."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from disputatio.operators.counted import _places_of_keys, _whole_keys, count_documents, embed_counted, predict_counted, train_counted, vector_search

WORDS = "the of law forest tax vote für gegen new old house pro contra yes no".split()


def texts(seed, count):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS, k=r.randint(1, 12))).capitalize() + ".", r.choice(["a", "b", "b", "c"])) for i in range(count)]


def split(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def plain_bayes(train, rows):
    counts, shares = {}, Counter()
    for _, text, label in train:
        if label is not None:
            shares[label] += 1
            counts.setdefault(label, Counter()).update(split(text))
    known = set().union(*counts.values())
    out = {}
    for key, text, _ in rows:
        scores = []
        for label in sorted(shares):
            total = sum(counts[label].values()) + len(known)
            scores.append((math.log(shares[label] / sum(shares.values())) + sum(math.log((counts[label][w] + 1) / total) for w in split(text) if w in known), label))
        best = max(s for s, _ in scores)
        ordered = sorted((s for s, _ in scores), reverse=True)
        out[key] = (next(x for s, x in scores if s == best), ordered[0] - ordered[1] if len(ordered) > 1 else 0.0)
    return out


def plain_vectors(rows, corpus, dims):
    df, out = Counter(w for _, t, _ in corpus for w in set(split(t))), {}
    for key, text, _ in rows:
        v = [0.0] * dims
        for w, n in Counter(split(text)).items():
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:7], 16) % dims] += n * (1 if h[7] < "8" else -1) * math.log((len(corpus) + 1) / (df[w] + 1))
        norm = math.sqrt(sum(x * x for x in v))
        out[key] = [0.0 if norm < 1e-9 else x / norm for x in v]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, label string, word string").repartition(3)


def test_bayes_equals_the_formula(spark):
    train = [*texts(1, 120), (900, None, "c"), (901, "law law law", None)]
    rows = [*texts(2, 40), (500, None, None), (501, "", None), (502, "unknown words only", None)]
    model = train_counted(frame(spark, train), "text", "label")
    got = {r.id: (r.predicted_label, r.margin) for r in predict_counted(model, frame(spark, rows), ["id"], "text").collect()}
    want = plain_bayes(train, rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_bayes_learns_a_cue(spark):
    rows = [(i, f"{'yes' if i % 2 else 'no'} {' '.join(random.Random(i).choices(WORDS[:10], k=6))}", "pro" if i % 2 else "contra") for i in range(200)]
    model = train_counted(frame(spark, rows[:150]), "text", "label")
    got = predict_counted(model, frame(spark, rows[150:]), ["id", "label"], "text")
    assert got.where("predicted_label = label").count() >= 48


def test_one_label_and_training_without_words(spark):
    model = train_counted(frame(spark, [(1, None, "a"), (2, "", "a")]), "text", "label")
    rows = predict_counted(model, frame(spark, [(7, "law", None)]), ["id"], "text").collect()
    assert [(r.predicted_label, r.margin) for r in rows] == [("a", 0.0)]


@pytest.mark.parametrize("dims", [8, 64])
def test_vectors_equal_the_formula(spark, dims):
    corpus = [*texts(3, 80), (700, None, None), (701, "", None)]
    rows = [*corpus[:20], (700, None, None), (701, "", None), (702, "quite unknown law", None)]
    weights = count_documents(frame(spark, corpus), "text")
    got = {r.id: r.embedding for r in embed_counted(frame(spark, rows), ["id"], "text", weights, dims).collect()}
    want = plain_vectors(rows, corpus, dims)
    assert got.keys() == want.keys()
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_vector_search_ranks_by_cosine(spark):
    corpus = texts(4, 60)
    df = frame(spark, corpus)
    weights = count_documents(df, "text")
    vectors = embed_counted(df, ["id"], "text", weights)
    asked = [(1000 + i, t, None) for i, t in enumerate(dict.fromkeys(t for _, t, _ in texts(5, 6)))]
    topics = spark.createDataFrame([(t,) for _, t, _ in asked], "topic_rewritten string")
    held = vectors.select("id", F.col("id").alias("number"), "embedding")
    got = {(r.topic_rewritten, r.id, r.rank, r.num_matches) for r in vector_search(topics, held, ["id"], "number", "embedding", weights, 0.3, 5).collect()}
    a, b = plain_vectors(asked, corpus, 64), plain_vectors(corpus, corpus, 64)
    want = set()
    for key, text, _ in asked:
        sims = sorted((-round(sum(x * y for x, y in zip(a[key], v)), 10), k) for k, v in b.items())
        kept = [k for s, k in sims if -s >= 0.3][:5]
        want |= {(text, k, n, len(kept)) for n, k in enumerate(kept)}
    assert got == want


def test_rare_words_and_keys_that_repeat(spark, monkeypatch):
    """Words beyond the broadcast ones meet the table by a join, and nothing else moves by word; rows of one key are one row."""
    corpus = [*texts(6, 60), (700, None, None)]
    monkeypatch.setattr("disputatio.operators.counted.FREQUENT_WORDS", 3)
    weights = count_documents(frame(spark, corpus), "text")
    assert weights.frequent.num_rows == 3
    rows = [*corpus[:20], corpus[0], (700, None, None), (702, "quite unknown law", None), (None, "law", None)]
    got = embed_counted(frame(spark, rows), ["id"], "text", weights, 8)
    merged = {}
    for key, text, _ in rows:
        merged[key] = f"{merged.get(key, '')} {text or ''}"
    want = plain_vectors([(k, t, None) for k, t in merged.items()], corpus, 8)
    found = {r.id: r.embedding for r in got.collect()}
    assert found.keys() == want.keys() and got.count() == len(want)
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(found[k], want[k], strict=True))


def test_vectors_are_not_written_and_their_search_reads_them_once(spark):
    """Rows are written once, as numbers of words, and no word moves whose weight is at hand."""
    corpus = texts(7, 60)
    df = frame(spark, corpus)
    weights = count_documents(df, "text")
    calls = spark.sparkContext.accumulator(0)

    def seen(_):
        calls.add(1)
        return True

    vectors = embed_counted(df.where("text IS NOT NULL"), ["id"], "text", weights)
    plan = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_f#") and "explode(_rare" in plan and "_c#" not in plan
    counted = vectors.where(F.udf(seen, "boolean")("id")).withColumn("number", F.col("id"))
    topics = spark.createDataFrame([(corpus[0][1],)], "topic_rewritten string")
    found = vector_search(topics, counted, ["id"], "number", "embedding", weights, 0.3, 5).collect()
    assert len(found) == 5 and calls.value == sum(t is not None for _, t, _ in corpus)


def test_keys_are_not_cut_by_batches():
    rows = [(None, 1), (None, 1), (1, None), (1, 2), (1, 2), (1, 2), (2, 2), (3, 3), (3, 3)]
    whole = pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64()) for n in range(2)], ["a", "b"])
    for size in (1, 2, 4, 9):
        tables = list(_whole_keys((whole.slice(n, size) for n in range(0, len(rows), size)), 2))
        keys = [[tuple(r.values()) for r in t.to_pylist()] for t in tables]
        assert [k for t in keys for k in t] == rows and sum(len(set(t)) for t in keys) == len(set(rows))
        assert all(list(_places_of_keys(t, 2)) == [sorted(set(k), key=k.index).index(x) for x in k] for t, k in zip(tables, keys))
