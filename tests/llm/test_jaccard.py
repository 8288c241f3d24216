"""The Jaccard join and its parts against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from disputatio.llm.components import connected_components
from disputatio.llm.group_links import BITS, LOWEST, meetings
from disputatio.llm.jaccard_join import COARSE, Bands, allocate, jaccard_components, segment_rows
from disputatio.llm.shingles import Words, bitmap

DOCS = "doc_id long, text string"


def shingle_set(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(size, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, percent=85, size=4):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    comp = {i: i for i, _ in sets if i is not None}
    pairs = [(i, j) for x, (i, s) in enumerate(sets) for j, t in sets[x + 1 :] if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t)]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(comp[i], comp[j])
            if comp[i] != low or comp[j] != low:
                comp[i] = comp[j] = low
                changed = True
    return sorted(((i, len(s), comp.get(i)) for i, s in sets), key=str)


def got_rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1, 1, 2])] = [f"e{rng.randrange(10**6)}"] * rng.choice([0, 1, 1])
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, frame, seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for length in (4, 9, 12, 20, 40, 80, 150, 400):
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        for n in range(18):
            texts.append(" ".join(edited(rng, base, rng.randrange(0, max(2, length // 16)))))
    for _ in range(40):
        own = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([10, 30, 60, 200]))]
        at = rng.randrange(len(own))
        texts.append(" ".join(own[:at] + passage + own[at:]))
    texts += [texts[3].upper(), texts[30] + "\t", "a", "A", "a b", "b a", "a b c d", "A  B\nC D", "é É", "É é", "", " \n"] + [texts[50]] * 30
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(9000, None), (9000, None), (None, texts[0]), (3, texts[7]), (3, texts[3])]
    want = brute(rows)
    assert got_rows(jaccard_components(frame(rows, DOCS, extra=("n", "item", "key", "band", "tokens")))) == want
    assert len({c for _, _, c in want}) < len(rows) - 60


def test_lower_threshold_and_size(spark, frame):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(edited(rng, base, rng.randrange(9)))) for i in range(60)]
    assert got_rows(jaccard_components(frame(rows, DOCS), size=5, percent=80)) == brute(rows, 80, 5)


def test_no_rows(spark, frame):
    assert got_rows(jaccard_components(frame([], DOCS))) == []
    assert got_rows(jaccard_components(frame([(1, None), (2, "")], DOCS))) == [(1, 0, 1), (2, 0, 2)]


def test_very_long_text(spark, frame):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-2000])), (3, " ".join(words[:-6000])), (4, "x " * 30_000)]
    assert got_rows(jaccard_components(frame(rows, DOCS))) == brute(rows)


def test_pigeonhole_bounds():
    bands = Bands(85)
    for n in range(1, 400):
        for p in range(n, bands.largest(n) + 1):
            # The largest difference of sets of n and p tokens at this threshold, by trying all overlaps.
            most = max((n + p - 2 * k for k in range(n + 1) if 100 * k >= 85 * (n + p - k)), default=None)
            if most:
                shared = {b: own for b, own, _ in bands.of(n)}.keys() & {b for b, _, _ in bands.of(p)}
                assert shared
                for x in (n, p):
                    assert all(own >= most and every >= own for b, own, every in bands.of(x) if b in shared and b == bands.of(n)[0][0])


def test_words_and_bitmap():
    texts = ["A b\tC", None, "", "é  x\x0by\x0cz \x1c w", "a"]
    words = Words(pa.array(texts))
    counts = [words.first[i + 1] - words.first[i] for i in range(len(texts))]
    assert counts == [len((t or "").encode().split()) for t in texts]
    part = Words(pa.array(["q" * 50, *texts, None]).slice(1, len(texts)))
    assert (part.hash == words.hash).all() and (part.first == words.first).all()
    again = Words(pa.array(["zz a B c a"]))
    assert again.hash[1] == words.hash[0] == again.hash[4] and again.hash[2] == words.hash[1]
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 100).astype(np.uint64)
    y = np.concatenate([x[:90], rng.integers(0, 2**63, 7).astype(np.uint64)])
    assert sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(bitmap(x), bitmap(y))) <= 17


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    label = {x: x for p in links for x in p if x is not None}
    for _ in range(100):
        for a, b in links:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {x: label[x] for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def isolated_pairs(rng, sizes, percent, size, copies):
    """Texts in pairs that share words with nobody else: a text and its beginning, at the threshold and just below it."""
    rows, want = [], {}
    for n in sizes:
        most = n - -(-percent * n // 100)
        for lost in [most] * copies + [most + 1]:
            words = [f"w{rng.randrange(10**12)}" for _ in range(n + size - 1)]
            at = len(rows)
            rows += [(at, " ".join(words)), (at + 1, " ".join(words[: len(words) - lost]))]
            want[at], want[at + 1] = at, at if lost <= most else at + 1
    return rows, want


@pytest.mark.parametrize(("percent", "size"), [(85, 4), (80, 5)])
def test_isolated_pairs_at_the_threshold(spark, frame, percent, size):
    """Only tokens from segments of a single one are missing in many of them."""
    rows, want = isolated_pairs(random.Random(7), [n for n in range(4, 320) if n - -(-percent * n // 100) > 0], percent, size, 5)
    got = {r.doc_id: r.component_id for r in jaccard_components(frame(rows, DOCS), size=size, percent=percent).collect()}
    assert [i for i in want if got[i] != want[i]] == []


def without_shared_coarse_segment(rng, percent, size, sizes, wanted):
    """Texts in linked pairs of which some share no coarse segment, with the number of such pairs."""
    bands, rows, apart = Bands(percent), [], 0
    while apart < wanted:
        n = rng.choice(sizes)
        lost = n - -(-percent * n // 100)
        words = [f"w{rng.randrange(10**12)}" for _ in range(n + size - 1)]
        pair = [" ".join(words), " ".join(words[: len(words) - lost])]
        found = Words(pa.array(pair))
        keys = [{k for _, keys, _ in segment_rows(found.shingles(i, size), bands, COARSE) for k in keys.tolist()} for i in range(2)]
        if not keys[0] & keys[1]:
            rows += [(2 * apart, pair[0]), (2 * apart + 1, pair[1])]
            apart += 1
    return rows


@pytest.mark.parametrize(("percent", "size", "sizes"), [(80, 5, [5, 6]), (50, 4, [2, 3, 4, 6])])
def test_sets_in_too_few_segments(spark, frame, percent, size, sizes):
    """Sets with fewer segments than they need may share none; at 50 % some lack units in the fine round, too."""
    rows = without_shared_coarse_segment(random.Random(8), percent, size, sizes, 20)
    assert got_rows(jaccard_components(frame(rows, DOCS), size=size, percent=percent)) == brute(rows, percent, size)


def test_no_more_units_than_needed(spark):
    """Sets that share all segments find every unit at the same price, and still buy only what they need."""
    rows = [(100 + seg, item, 0, seg, 0, 3, True) for item in range(6) for seg in range(8)]
    # One more set has a segment that nobody shares, a free unit.
    rows += [(100 + seg if seg else 99, 6, 0, seg, 0, 3, True) for seg in range(8)]
    rows = spark.createDataFrame(rows, "key long, item long, band int, seg int, kind int, need int, lone boolean")
    sets = spark.createDataFrame([], "item long, n long, " + ", ".join(f"{w} long" for w in BITS))
    members = allocate(rows, sets, 80).groupBy("item").agg(F.sum("ask").alias("asked"), F.max("rank").alias("rank")).collect()
    assert {r.item: (r.asked, r.rank) for r in members} == {**{i: (3, 0) for i in range(6)}, 6: (2, 1)}


def test_second_units_go_with_the_first(spark):
    """A segment looked up with one token more or less is asked for once, for both units."""
    rows = [(10 * seg + kind, item, 0, seg, kind, 3, False) for item in range(4) for seg in range(5) for kind in (0, 1)]
    # A segment without one of its tokens is another's segment as it is.
    rows += [(10 * seg + 1, 9, 0, 5 + seg, 0, 3, False) for seg in range(5)]
    rows = spark.createDataFrame(rows, "key long, item long, band int, seg int, kind int, need int, lone boolean")
    sets = spark.createDataFrame([], "item long, n long, " + ", ".join(f"{w} long" for w in BITS))
    asked = allocate(rows, sets, 80).where("kind = 0").groupBy("item").agg(F.sum("ask").alias("asked")).collect()
    assert {r.item: r.asked for r in asked if r.item < 4} == dict.fromkeys(range(4), 3)


def test_pairs_with_many_keys_meet_once(spark):
    """Pairs of unlike parts are formed at one of the keys that a side asks for, and at all where none of the smallest is common."""
    keys = {1: range(60), 2: range(60), 3: range(10, 60), 4: range(100, 100 + 2 * LOWEST), 5: range(99 + 2 * LOWEST, 160), 6: range(0, 60, 7), 7: range(60)}
    ask = {6: 0}
    part = {7: 1}
    rows = [(k, i, 0, ask.get(i, 1), 50, 0, 0, 0, 0, part.get(i, i)) for i, some in keys.items() for k in some]
    rest = spark.createDataFrame(rows, "key long, item long, kind int, ask int, n long, " + ", ".join(f"{w} long" for w in BITS) + ", part long")
    allowed = (F.col("x.kind") == 0) & (F.col("y.kind") == 0) & (F.greatest("x.ask", "y.ask") >= 1)
    got = [(r.a, r.b) for r in meetings(rest, 80, allowed, (F.col("kind") == 0) & (F.col("ask") >= 1), F.col("kind") == 0).collect()]
    want = {(i, j) for i in keys for j in keys if i < j and set(keys[i]) & set(keys[j]) and part.get(i, i) != part.get(j, j)}
    assert set(got) == want
    assert all(got.count(p) == 1 for p in want)
    assert (4, 5) in want
