"""Embedding near-duplicates and exact search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from disputatio.llm.embedding_dedup import embedding_duplicates, linked_pairs
from disputatio.llm.knn import nearest

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
ODD = [(900, None, 1), (901, [], 1), (902, [0.0, 0.0, 0.0], 1), (903, [1.0, None, 0.0], 1), (904, [NAN, 1.0, 0.0], 1), (905, [1.0, INF, 0.0], 1), (906, [1.0, 2.0, 3.0], None)]


def brute_links(rows, threshold):
    def fit(x):
        return x[1] and x[2] is not None and all(c is not None and np.isfinite(c) for c in x[1]) and any(x[1])

    good = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if fit((i, v, l))]
    n = {i: 0 for i, _, _ in rows}
    comp = {i: i for i in n}
    pairs = []
    for x, (i, u, k) in enumerate(good):
        for j, v, l in good[x + 1 :]:
            if k == l and len(u) == len(v) and u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= threshold:
                n[i] += 1
                n[j] += 1
                pairs.append((i, j))
    for _ in comp:
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


@pytest.mark.parametrize("dims,tile", [(3, 16), (40, 16), (40, 2048)])
def test_links_equal_brute_force(spark, frame, dims, tile):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(40, dims))
    picked = base[rng.integers(0, 40, 260)] + rng.normal(size=(260, dims)) * 0.05
    rows = [(i, [float(c) for c in v], int(i % 3 > 0)) for i, v in enumerate(picked)]
    rows += [(500 + i, rows[0][1], 0) for i in range(30)] + [(600, [2 * c for c in rows[0][1]], 0), (601, rows[0][1][:2], 0)] + ODD
    got = embedding_duplicates(frame(rows, VECTORS), threshold=0.98, tile_rows=tile).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_links(rows, 0.98)
    assert len(got) == len(rows)


def test_no_usable_vectors(spark, frame):
    assert embedding_duplicates(frame([], VECTORS)).collect() == []
    got = embedding_duplicates(frame(ODD, VECTORS)).collect()
    assert all(r.n_links == 0 and r.kept and r.component_id == r.vec_id for r in got) and len(got) == len(ODD)


def test_bound_loses_no_pair():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 50)) * np.geomspace(1, 0.01, 50)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = linked_pairs(x, x, 0.9, step=7)
    found = set(zip(i.tolist(), j.tolist()))
    assert {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.9))} <= found


def brute_top(rows, k):
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    out = set()
    width = max(len(v) for _, v in good)
    good = [(i, np.pad(v, (0, width - len(v)))) for i, v in good]
    for q, u in good:
        if q % 5 == 0:
            best = sorted((-int(u @ v), i) for i, v in good if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("dims,pivots,qb,db", [(2, 8, 16, 64), (16, 8, 16, 64), (16, 64, 1024, 32768)])
def test_top_k_equals_brute_force(spark, frame, dims, pivots, qb, db):
    rng = np.random.default_rng(dims + pivots)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(rng.normal(size=(400, dims)).round(1))]
    rows += [(1000 + i, rows[5][1], 1) for i in range(40)] + [(2000, [9.0], 1), (2005, [-0.001, 0.5], 1)] + [x for x in ODD if x[0] != 906]
    got = nearest(frame(rows, VECTORS), F.col("vec_id") % 5 == 0, 5, pivots=pivots, query_block=qb, data_block=db).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute_top(rows, 5)


def test_top_k_of_few(spark, frame):
    ask = F.col("vec_id") % 5 == 0
    assert nearest(frame([], VECTORS), ask).collect() == []
    assert nearest(frame([(1, [1.0], 0)], VECTORS), ask).collect() == []
    assert nearest(frame([(5, [1.0], 0)], VECTORS), ask).collect() == []
    got = nearest(frame([(5, [1.0], 0), (7, [2.0], 0), (6, [2.0], 0)], VECTORS), ask).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 6, 131072), (2, 7, 131072)]


def test_links_of_null_and_repeated_ids(spark, frame):
    a, near, b, far = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(7, a, 1), (None, near, 1), (3, [1.0, 0.2, 0.0], 1), (9, b, 1), (9, far, 1), (9, far, 2), (4, far, 2), (None, [0.0, 1.0, 1.0], 1), (None, [0.0, 1.0, 1.0], 1), (9, b, 1), (None, None, 1)]
    got = embedding_duplicates(frame(rows, VECTORS), threshold=0.99).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    want = [(7, 1, 3, False), (None, 2, 3, False), (3, 1, 3, True), (9, 1, 9, True), (9, 1, 9, True), (9, 0, 9, True), (9, 1, 4, False), (4, 1, 4, True)]
    want += [(None, 1, None, True)] * 2 + [(None, 0, None, True)]
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)


@pytest.mark.parametrize("copies", [1, 12, 150])
def test_top_k_of_repeated_ids(spark, frame, copies):
    rng = np.random.default_rng(copies)
    rows = [(i % 90, [float(c) for c in v], 0) for i, v in enumerate(rng.normal(size=(200, 4)).round(1))]
    rows += [(10, rows[0][1], 0)] * copies + [(10, [9.0, 0.0, 0.0, 0.0], 0), (None, [99.0, 99.0, 99.0, 99.0], 0)]
    got = nearest(frame(rows, VECTORS), F.col("vec_id") % 5 == 0, 3, pivots=8, query_block=16, data_block=64).collect()
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v, _ in rows if i is not None]
    want = []
    for at, (q, u) in enumerate(good):
        if q % 5 == 0:
            best = sorted((-int(u @ v), i) for n, (i, v) in enumerate(good) if n != at)[:3]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)
