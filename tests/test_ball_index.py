"""The pruned vector join against all pairs; what is pruned, crowded balls, odd vectors, the saved form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from disputatio.operators.ball_index import _dealt, _reach, build_ball_index, open_ball_index, reachable, vector_threshold_join
from disputatio.operators.similarity import approximate_cosine_join


def cloud(seed, centres, each, dim=12, spread=0.25):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, dim))
    return np.concatenate([m + spread * r.normal(size=(each, dim)) * np.linalg.norm(m) / np.sqrt(dim) for m in middle])


def frame(spark, rows, key, start=0):
    return spark.createDataFrame([(start + i, [float(x) for x in row]) for i, row in enumerate(rows)], f"{key} long, vector array<double>")


def plain(a, b, threshold, strict=False):
    def unit(x):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    sims = np.round(unit(a) @ unit(b).T, 10)
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(sims > threshold if strict else sims >= threshold))}


def pairs(df):
    return {(r.topic_id, r.corpus_id) for r in df.collect()}


@pytest.mark.parametrize("threshold", [-0.2, 0.0, 0.3, 0.8, 0.97, 1.0])
def test_equals_all_pairs(spark, tmp_path, threshold):
    rows, asked = cloud(1, 9, 40), cloud(2, 4, 5)
    rows[3] = rows[200] = 0.0
    rows[50:90] = rows[50]
    asked = np.concatenate([asked, rows[48:53], np.zeros((1, 12)), -rows[7:8]])
    index = build_ball_index(frame(spark, rows, "corpus_id"), str(tmp_path / "index"), slice_rows=16)
    got = vector_threshold_join(frame(spark, asked, "topic_id"), index, threshold, topic_rows=5)
    assert pairs(got) == plain(asked, rows, threshold)


def test_a_crowded_ball_is_cut_in_slices(spark, tmp_path):
    rows = np.concatenate([cloud(3, 1, 600, spread=0.1), cloud(4, 12, 5)])
    index = build_ball_index(frame(spark, rows, "corpus_id"), str(tmp_path / "index"), slice_rows=50)
    most = index.slices.agg(F.max("n")).first()[0]
    assert most <= 120 and index.slices.agg(F.sum("n")).first()[0] == len(rows)


def test_most_of_the_table_is_pruned(spark, tmp_path):
    rows = cloud(5, 30, 60, spread=0.15)
    index = build_ball_index(frame(spark, rows, "corpus_id"), str(tmp_path / "index"), slice_rows=30)
    asked = frame(spark, rows[::60], "topic_id")
    met = reachable(asked, index, 0.95).join(index.slices, ["ball", "slice"]).agg(F.sum("n")).first()[0]
    assert met < 0.25 * 30 * len(rows)
    assert pairs(vector_threshold_join(asked, index, 0.95, strict=True)) == plain(rows[::60], rows, 0.95, True)


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    odd = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [2.0, 0.0]), (None, [3.0, 0.0])]
    corpus = spark.createDataFrame([(*r, "x") for r in odd], "corpus_id long, vector array<double>, ball string")
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "topic_id long, vector array<double>")
    index = build_ball_index(corpus, str(tmp_path / "a"))
    assert pairs(vector_threshold_join(asked, index, 0.9)) == {(9, 1), (9, 7), (9, None)}
    nothing = build_ball_index(corpus.where("corpus_id = 2"), str(tmp_path / "b"))
    assert vector_threshold_join(asked, nothing, 0.9).count() == 0
    assert vector_threshold_join(asked.where("topic_id = 8"), index, 0.9).count() == 0


def test_saved_index_is_read_back_and_hashing_finds_a_part(spark, tmp_path):
    rows, asked = cloud(6, 10, 60), cloud(7, 3, 4)
    corpus, topics = frame(spark, rows, "corpus_id"), frame(spark, asked, "topic_id")
    build_ball_index(corpus, str(tmp_path / "index"))
    exact = pairs(vector_threshold_join(topics, open_ball_index(spark, str(tmp_path / "index")), 0.3))
    near = pairs(approximate_cosine_join(topics, corpus, threshold=0.3))
    assert exact == plain(asked, rows, 0.3)
    assert near <= exact and len(near) >= 0.9 * len(exact)


def test_topics_are_sent_once_per_block(spark, tmp_path):
    """Where nothing can be pruned a vector still goes to a few blocks only, not to every ball."""
    rows = np.random.default_rng(8).normal(size=(900, 12))
    index = build_ball_index(frame(spark, rows, "corpus_id"), str(tmp_path / "index"), slice_rows=40)
    asked = frame(spark, rows, "topic_id")
    found = vector_threshold_join(asked, index, 0.6, topic_rows=300, block_rows=200)
    assert pairs(found) == plain(rows, rows, 0.6)
    assert found.count() == len(plain(rows, rows, 0.6))
    found_slices = index.slices.orderBy("ball", "slice").toArrow()
    ranges = tuple(found_slices.column(c).to_numpy() for c in ("ball", "low", "high"))
    n = found_slices.column("n").to_numpy()
    dealt = _dealt(asked, index, ranges, (np.cumsum(n) - n) // 200, _reach(0.6)).agg(F.sum(F.size("blocks"))).first()[0]
    assert dealt <= 900 * 5 < reachable(asked, index, 0.6).count()
