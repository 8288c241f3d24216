"""Collocations against plain counting of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from disputatio.llm.phrases import Groups, Sketch, bucket, collocations, column, count_pairs, count_words, suffixes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=2000):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            counts.update((lang, *words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1))
    wanted = {k: v for k, v in counts.items() if len(k) > 2 and v >= least}
    covered = set()
    for (lang, *w), f in wanted.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                if 100 * f >= 80 * counts[(lang, *w[i : i + n])]:
                    covered.add((lang, *w[i : i + n]))
    out = []
    for (lang, *w), a in wanted.items():
        if (lang, *w) in covered:
            continue
        cuts = [(2_000_000 * a // (counts[(lang, *w[:k])] + counts[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), counts[(lang, *w[:k])], counts[(lang, *w[k:])]))
    out.sort()
    ranked, seen = [], Counter()
    for lang, score, a, phrase, l, r in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, l, r, sizes[lang], -score))
    return ranked


def texts(seed, count):
    r = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "Ä", "ä", "x-y", "1", "'s", "deep", "learning", "new", "york", "city", "\x0e", " "]
    rows = []
    for _ in range(count):
        said = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "", "?!"]) for _ in range(r.randint(0, 80)))
        rows.append((r.choice(["en", "en", "de", None]), r.choice([said, said + " new york city deep learning", said.upper()])))
    return rows + [("fr", None), ("fr", ""), ("fr", " ., "), (None, None), ("en", "the " * 3000), ("en", "new york " * 500)]


def check(spark, frame, rows, least, **options):
    df = frame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string", extra=("word", "n", "h1", "group", "a", "k", "score")).repartition(5)
    got = sorted(tuple(r) for r in collocations(df, least=least, **options).collect())
    assert got == sorted(plain(rows, least, options.get("top", 2000)))


def test_equals_plain_counting(spark, frame):
    check(spark, frame, texts(1, 150), 3)


def test_small_budget_makes_prefixes_longer(spark, frame):
    check(spark, frame, texts(2, 120), 4, budget=40)


def test_a_full_sketch_changes_nothing(spark, frame):
    check(spark, frame, texts(3, 80), 30, sketch_bits=6)


def test_top_of_each_language(spark, frame):
    check(spark, frame, texts(4, 120), 2, top=7)


def test_one_document_with_a_third_of_all_rows(spark, frame):
    rows = texts(5, 60) + [("en", "copied line of a page, the new york city. ")] * 60
    check(spark, frame, rows, 10, budget=100)


def test_nothing_frequent_and_empty_table(spark):
    for rows in ([("en", "a b c")], []):
        df = spark.createDataFrame(rows, "lang string, text string")
        assert collocations(df, least=5).count() == 0


def test_groups_keep_to_the_budget(spark):
    rows = texts(6, 150)
    docs = spark.createDataFrame(rows, "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    words = count_words(docs).cache()
    everything = Sketch(words.count(), 20).fill(words.select("h1"), lambda b: column(b, "h1"))
    pairs = count_pairs(docs, everything).cache()
    linked = Sketch(pairs.count(), 20).fill(pairs.select("pair"), lambda b: column(b, "pair"))
    budget = 60
    groups = Groups(words, pairs, budget)
    table = suffixes(docs, linked, groups).toArrow()
    keys = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2", "h3")], axis=1)
    pair = bucket(keys[:, 0], keys[:, 1])
    of, n = table.column("group").to_numpy(), table.column("n").to_numpy()
    heavy = np.isin(pair, groups.heavy_pairs)
    load = np.bincount(of[~heavy], n[~heavy])
    assert words.agg(F.max("n")).first()[0] > budget and groups.count > 10 and heavy.any()
    # A group is filled to the budget by whole cells, the last of which may pass it.
    assert load.max() <= 3 * budget
    # Prefixes of one word lie in one group, of heavy words in one per pair, of heavy pairs in one per three words.
    light = ~np.isin(keys[:, 0], groups.heavy_words)
    for kind, key in ((light, keys[:, :1]), (~light & ~heavy, pair[:, None]), (~light & heavy, np.column_stack([pair, keys[:, 2]]))):
        assert len(np.unique(np.column_stack([key[kind], of[kind].astype(np.uint64)]), axis=0)) == len(np.unique(key[kind], axis=0))
    words.unpersist(), pairs.unpersist()


@pytest.mark.parametrize("bits", [6, 20])
def test_sketch_lets_all_members_pass(spark, bits):
    df = spark.range(5000).selectExpr("xxhash64(id) AS h1")
    sketch = Sketch(5000, bits).fill(df, lambda b: column(b, "h1"))
    keys = column(df.toArrow().combine_chunks().to_batches()[0], "h1")
    assert sketch.has(keys).all()
    assert sketch.has(keys + np.uint64(1)).mean() < (0.1 if bits == 20 else 1.01)
