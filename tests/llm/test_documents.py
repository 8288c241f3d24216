"""Quality, repeated passages and the pipeline on small inputs."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from disputatio.llm.quality import VOTES, Kinds, Texts, label_model, pattern_of, score_quality, votes_of
from disputatio.llm.substring_dedup import repeated_passages, tuned_bands
from tests.llm.test_jaccard import brute
from tests.llm.test_pii import plain

DOCS = "doc_id long, text string"


def test_label_model_weighs_the_labellers():
    """Three detectors of one sort of junk each, a noisy one, and a labeller that likes nearly everything."""
    rng = np.random.default_rng(0)
    sort = rng.choice(4, 6000, p=[0.85, 0.05, 0.05, 0.05])
    votes = np.zeros((6000, 5))
    for k in (1, 2, 3):
        votes[:, k - 1] = -((rng.random(6000) < np.where(sort == k, 0.95, 0.002)).astype(float))
    votes[:, 3] = -(rng.random(6000) < 0.02).astype(float)
    votes[:, 4] = rng.random(6000) < 0.9
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, accuracy = label_model(patterns, counts.astype(float))
    assert ((post > 0.5)[back.ravel()] == (sort == 0)).mean() > 0.85
    assert (post[back.ravel()][(sort > 0) & (votes[:, :3] < 0).any(1)] < 0.5).all()
    assert accuracy.shape == (2, 5) and (accuracy >= 0.5).all()


def test_quality_separates_the_labelled(spark, small):
    scores = {r.doc_id: r.quality for r in score_quality(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    good, bad = ([scores[i] for i, q in labels.items() if q == k] for k in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) > 0.95


def test_quality_of_odd_texts(spark, frame):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word " * 40000), (5, "fine words make a fine sentence here."), (5, "fine words make a fine sentence here."), (None, "A!!")]
    got = score_quality(frame(rows, DOCS, extra=("_n", "quality", "weak_label", *VOTES))).collect()
    assert len(got) == len(rows) and all(0 <= r.quality <= 1 for r in got)
    assert all(r.quality == 0 for r in got if r.doc_id in (1, 2, 3))
    assert score_quality(frame([], DOCS)).collect() == []


def plain_votes(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    n, size = max(len(words), 1), max(len(t), 1)
    kinds = [unicodedata.category(c) for c in t]
    letters, short = sum(k[0] == "L" for k in kinds), len(words) < 30
    per_sentence = n / (sum(c in ".!?" for c in t) + 1)
    alarm = [
        sum(c in "*&%$#!|~^<>{}[]=\\" for c in t) / size > 0.05,
        kinds.count("Lu") / max(letters, 1) > 0.5,
        not short and 1 - len(set(words)) / n > 0.85,
        t.count("|") / n > 0.2,
        not 2 <= letters / n <= 12,
        letters / size < 0.6,
    ]
    length = -1 if len(words) < 3 else int(len(words) > 50)
    sentences = 0 if short else -1 if per_sentence > 100 else int(3 < per_sentence < 40)
    return [-int(a) for a in alarm] + [length, sentences]


def plain_tokens(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    kind = lambda c: {"Lu": "A", "Ll": "a"}.get(unicodedata.category(c), "0" if "0" <= c <= "9" else None)
    shape = lambda w: "".join(k or "".join(g) for k, g in itertools.groupby(w, kind))
    return [("word", w) for w in words] + [("shape", shape(w)) for w in words]


def test_quality_votes_and_tokens_match_a_plain_version():
    odd = [None, "", " \n", "ÀÉ Größe ǅ x", "a" * 50, "日本語 テキスト。", "\x1f\u00a0 one|two || three", "😀 A1b22C.", "same " * 40, "A!! B?? " * 60, "one two three. " * 40, "x\ty\x0bz\x0c"]
    rng = random.Random(9)
    odd += ["".join(rng.choice("aBß7 .!|é\n\t%語") for _ in range(rng.randrange(400))) for _ in range(200)]
    texts = Texts(pa.array(odd, pa.string()), Kinds())
    assert texts.votes().tolist() == [plain_votes(t) for t in odd]
    assert (votes_of(pattern_of(texts.votes())) == texts.votes()).all()
    row, bucket = texts.tokens(1 << 60)
    names = {}
    for i, t in enumerate(odd):
        got = bucket[row == i].tolist()
        want = plain_tokens(t)
        assert len(got) == len(want)
        for b, w in zip(got, want):
            assert names.setdefault(w, b) == b
    assert len(set(names.values())) == len(names)


def sentence(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) + "."


def test_repeated_passages(spark, frame):
    rng = random.Random(3)
    passage = " ".join(sentence(rng, rng.randrange(6, 15)) for _ in range(7))
    long = sentence(rng, 90)[:-1]
    line = sentence(rng, 12)
    rows = []
    for i in range(60):
        body = [sentence(rng, rng.randrange(5, 20)) for _ in range(8)]
        if i % 3 == 0:
            body.insert(4, passage)
        if i % 3 == 1:
            body.insert(3, f"{sentence(rng, 6)[:-1]} {long} {sentence(rng, 6)}")
        rows.append((i, (line + "\n" + " ".join(body)) if i % 2 else " ".join(body)))
    copy = rows[2][1].split()
    copy[30] = "edited"
    rows += [(100, rows[5][1]), (100, rows[5][1]), (101, " ".join(copy)), (102, None), (103, ""), (104, "x " * 30000), (None, rows[8][1])]
    df = frame(rows, DOCS, extra=("words", "unit", "item", "print", "start", "n"))
    got = [r for r in repeated_passages(df).collect()]
    assert len(got) == len(rows) - 1
    by = {r.doc_id: r for r in got}
    texts = dict(rows)
    cut = lambda i: "".join(texts[i][int(a) : int(b)] for a, b in (s.split(":") for s in by[i].spans.split(",") if s))
    assert by[0].removed_words == 0 and by[1].removed_words == 0
    for i in range(3, 60, 3):
        assert passage[20:-20] in cut(i) and by[i].removed_words < by[i].n_words
    for i in range(4, 60, 3):
        assert 0.7 * len(long) < len(cut(i)) < 1.3 * len(long)
    assert all(by[i].removed_words == 0 for i in range(2, 60, 3) if i != 8)
    assert by[None].removed_words == 0 and by[8].removed_words == by[8].n_words
    assert by[100].removed_words == by[100].n_words and by[101].removed_words > 0.8 * by[101].n_words
    assert by[102].n_words == by[103].n_words == 0 and by[104].n_words == 30000 and by[104].removed_words == 0
    assert repeated_passages(frame([], DOCS)).collect() == []


def random_words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def removed_places(text, spans):
    """Numbers of the words of a text that lie in its spans."""
    cuts = [tuple(map(int, s.split(":"))) for s in spans.split(",") if s]
    places = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return {i for i, (a, b) in enumerate(places) if any(s <= a and b <= e for s, e in cuts)}


def test_passages_match_a_plain_version(spark, frame):
    """Planted passages of 31 to 70 words, some quoted in part by an earlier document, against all windows of 51 words."""
    rng = random.Random(5)
    docs, lengths = [], []
    for n in (31, 45, 50, 51, 51, 52, 55, 60, 70):
        for k in range(20):
            passage = random_words(rng, n)
            parts = [passage] * 3 if k % 2 else [passage[: n // 2], passage, passage]
            for part in parts:
                docs.append(random_words(rng, rng.randrange(0, 90)) + part + random_words(rng, rng.randrange(0, 90)))
    phrases = [random_words(rng, 4) for _ in range(40)]
    docs += [random_words(rng, 30) + x + ["."] + random_words(rng, 30) for x in phrases]
    docs.append([w for x in phrases for w in (*x, ".")])
    line = random_words(rng, 60)
    docs += [random_words(rng, 5) + line + random_words(rng, 5 + i % 20) for i in range(200)]
    rows = [(i, " ".join(w.upper() if i % 2 else w for w in d)) for i, d in enumerate(docs)]
    got = {r.doc_id: r for r in repeated_passages(frame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    seen, beyond, total = set(), 0, 0
    for i, d in enumerate(docs):
        windows = [(tuple(d[a : a + 51]), a) for a in range(len(d) - 50)]
        want = {a + j for w, a in windows if w in seen for j in range(51)}
        have = removed_places(rows[i][1], got[i].spans)
        assert want <= have and len(have) == got[i].removed_words
        # Paragraphs linked by Jaccard similarity may add some words at the ends of a passage, never a passage.
        assert want or not have
        beyond, total = beyond + len(have - want), total + len(want)
        seen |= {w for w, _ in windows}
    assert beyond < 0.02 * total


def test_passages_where_the_first_document_has_no_id(spark, frame):
    rng = random.Random(8)
    text = random_words(rng, 160)
    copies = [text[:80] + [w] + text[80:] for w in ("one", "two", "three")]
    for ids in ((0, 2, 3), (None, 2, 3)):
        got = {r.doc_id: r for r in repeated_passages(frame([(i, " ".join(c)) for i, c in zip(ids, copies)], DOCS)).collect()}
        assert [got[i].removed_words for i in ids] == [0, 161, 161]


def test_bands():
    assert tuned_bands(0.8, 2, 0.995) == 6
    assert 1 - (1 - 0.8**2) ** 6 >= 0.995 > 1 - (1 - 0.8**2) ** 5


def test_stages_equal_a_plain_version(spark, small, tmp_path):
    """Stages whose result plain code can give, each on what the stage before kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "personal_data", "mixing", "sentencepiece"]
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        steps[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
        if name != "sentencepiece":
            assert docs.columns == before.columns and docs.count() > 0
    before, after = steps["language_id"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if r["text"] and any(c.isalpha() for c in r["text"])}
    before, after = steps["near_duplicates"]
    groups = brute([(r["doc_id"], r["text"]) for r in before], 80, 5)
    assert {r["doc_id"] for r in after} == {i for i, _, c in groups if i == c}
    before, after = steps["personal_data"]
    changed = {r["doc_id"]: r for r in after}
    for r in before:
        want, at = "", 0
        spans = sorted((int(s), int(e), k.upper()) for k, s, e in (x.split(":") for x in plain(r["text"]).split(",") if x))
        for s, e, k in spans:
            if s >= at:
                want += r["text"][at:s] + f"[{k}]"
            at = max(at, e)
        assert changed[r["doc_id"]]["text"] == want + r["text"][at:]
        assert changed[r["doc_id"]]["n_chars"] == len(changed[r["doc_id"]]["text"])
    before, after = steps["mixing"]
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == texts[r["doc_id"]] for r in after)
    assert max(sum(r["doc_id"] == i for r in after) for i in list(texts)[:50]) <= 2
    words = sum(len(r["text"].split()) for r in before)
    assert sum(len(r["text"].split()) for r in after) == pytest.approx(1.5 * words, rel=0.2)
    before, after = steps["sentencepiece"]
    assert sorted(r["doc_id"] for r in before) == sorted(r["doc_id"] for r in after)
    assert all(r["n_tokens"] == len(r["ids"]) > 0 for r in after)


def test_stages_on_odd_documents(spark, frame, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    text = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, text, "en", None, 60), (3, text, "en", None, 60), (None, text, None, "a", 60), (4, "x@y.cc " + text, "en", "b", 66), (5, "12 34", "de", "b", 5), (6, "word " * 30000, "en", "b", 150000)]
    for k, df in enumerate((frame(rows, schema), frame([], schema))):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, "").write.parquet(str(tmp_path / f"{name}{k}"))
            columns, docs = docs.columns, spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if name == "near_duplicates" and k == 0:
                assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 3, 6]
            if name != "sentencepiece":
                assert docs.columns == columns
        assert (docs.count() > 0) == (k == 0)
