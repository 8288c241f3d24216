"""SentencePiece coding against plain search and the library's decoder; language identification on held-out rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from disputatio.llm import language_id
from disputatio.llm.language_id import Segmenter, learn_pieces, marked as marked_word, predict_language
from disputatio.llm.pieces import PIECE_MODEL, SPACE, load_pieces
from disputatio.llm.queries_text import held_out, op3_language_id, op7_sentencepiece
from disputatio.llm.sentencepiece_codec import Viterbi, decode, encode

VOCABULARY = load_pieces()
SCORES = {p: (s, i) for i, (p, s, byte) in enumerate(VOCABULARY) if p and not byte}
BYTES = {int(p[3:5], 16): i for i, (p, _, byte) in enumerate(VOCABULARY) if byte}
UNKNOWN = min(s for s, _ in SCORES.values() if s > -1e8) - 10
TEXTS = [
    "Hello  world", " a ", "", " ", "été — naïve 日本語 🎉\n\ttab", "x" * 3000, "no▁space ▁", "a\u0000b", "ﬁ ①  ", "word " * 2000, "\r\n", "Straße, größer.",
]


def plain(word):
    """Best ids of a word by a loop over ends and starts; spaces are marked by ``SPACE``, a foreign one by None."""
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        top = None
        for start in range(end - 1, max(-1, end - 17), -1):
            part = word[start:end]
            if None not in part and "".join(part) in SCORES:
                gain, ids = SCORES["".join(part)][0], [SCORES["".join(part)][1]]
            elif len(part) == 1:
                gain, ids = UNKNOWN, [BYTES[b] for b in (part[0] or SPACE).encode()]
            else:
                continue
            if top is None or best[start][0] + gain > top[0]:
                top = (best[start][0] + gain, best[start][1] + ids)
        best.append(top)
    return best[-1][1]


def marked(text):
    return [None if c == SPACE else SPACE if c == " " else c for c in text]


def test_viterbi_equals_a_plain_search():
    words = [" Hello", "  world", " größer", " naïve", " 日本語", " 🎉x", " ▁a▁", " antidisestablishmentarianism", " xxxxxxxxxx", " the", " a", "   "]
    assert [np.frombuffer(x, np.int32).tolist() for x in Viterbi(VOCABULARY).encode(words)] == [plain(marked(w)) for w in words]


def test_round_trip(spark, frame):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, TEXTS[0]])]
    df = frame(rows, "doc_id long, text string", extra=("ids", "decoded", "piece"))
    got = {r.doc_id: r for r in decode(encode(df)).collect()}
    assert {i: r.decoded for i, r in got.items()} == dict(rows)
    assert got[len(TEXTS)].ids is None and got[2].ids == []
    for i, text in enumerate(TEXTS):
        if SPACE not in text and text:
            assert library.decode(got[i].ids) == text
        if text and len(text) < 100:
            assert got[i].ids == plain(marked(" " + text))
    assert encode(frame([], "doc_id long, text string")).collect() == []


def test_every_document_round_trips(spark, small):
    got = op7_sentencepiece(spark, small).collect()
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r.round_trip and r.n_tokens > 0 for r in got)


def all_cuts(word):
    for n in range(len(word)):
        for cuts in itertools.combinations(range(1, len(word)), n):
            yield [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))]


@pytest.mark.parametrize("stretch", [1, 2, 3, 48])
def test_forward_sums_all_segmentations(monkeypatch, stretch):
    monkeypatch.setattr(language_id, "STRETCH", stretch)
    pieces = ["", "a", "b", "ab", "ba", SPACE, SPACE + "a", "aba"]
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces) + 1), 2)
    model, words = Segmenter(pieces, p), [SPACE + "abab", SPACE + "cab", SPACE + "a", SPACE + "bbbab"]
    number = {x: i for i, x in enumerate(pieces) if x}
    got = model.log_probabilities(words)
    for k in range(2):
        def value(part):
            return p[k][number[part]] if part in number else p[k][-1] if len(part) == 1 else 0.0

        for i, w in enumerate(words):
            assert got[k, i] == pytest.approx(math.log(sum(math.prod(map(value, c)) for c in all_cuts(w))))
    # Expected uses, by weighing every segmentation.
    want = np.zeros(len(pieces) + 1)
    for w, n in zip(words, (1, 2, 3, 4)):
        cuts = [(math.prod(p[0][number[x]] if x in number else p[0][-1] if len(x) == 1 else 0.0 for x in c), c) for c in all_cuts(w)]
        total = sum(v for v, _ in cuts)
        for v, c in cuts:
            for x in c:
                if v:
                    want[number.get(x, len(pieces))] += n * v / total
    assert Segmenter(pieces, p[:1]).expected(words, np.array([1.0, 2, 3, 4])) == pytest.approx(want)


def test_marked_words():
    assert marked_word("²") == "" and marked_word("a" * 100) == SPACE + "a" * 100


def test_long_words_are_summed_whole():
    """Against sums of logarithms, which never leave their range."""
    pieces = ["", "a", "b", "ab", "ba", SPACE, SPACE + "a", "aba", "b" * 40]
    p = np.random.default_rng(1).dirichlet(np.ones(len(pieces) + 1), 2)
    number = {x: i for i, x in enumerate(pieces) if x}
    words = [SPACE + "ab" * 1500 + "c" * 400, SPACE + "b" * 3000, SPACE + "a" * 47, SPACE + "a" * 48]
    got = Segmenter(pieces, p).log_probabilities(words)
    for k in range(2):
        for i, w in enumerate(words):
            logs = [0.0]
            for end in range(1, len(w) + 1):
                terms = [logs[end - n] + math.log(p[k][number[w[end - n : end]]]) for n in range(1, min(40, end) + 1) if w[end - n : end] in number]
                if w[end - 1] not in number:
                    terms.append(logs[end - 1] + math.log(p[k][-1]))
                most = max(terms)
                logs.append(most + math.log(sum(math.exp(t - most) for t in terms)))
            assert got[k, i] == pytest.approx(logs[-1], rel=1e-9)
    uses = Segmenter(pieces, p[:1]).expected(words, np.ones(4))
    lengths = np.array([len(x) for x in pieces] + [1])
    assert uses @ lengths == pytest.approx(sum(map(len, words)))


def test_sample_is_the_smallest_hashes(spark, frame, monkeypatch):
    """However hashes are binned, the same documents teach."""
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} der die", "en" if i % 3 else "de") for i in range(300)]
    df = frame(rows, "doc_id long, text string, lang string")
    want = {}
    for lang in ("en", "de"):
        ids = [r.doc_id for r in df.where(f"lang = '{lang}'").orderBy(F.xxhash64("doc_id"), "doc_id").limit(20).collect()]
        want[lang] = ids
    only = df.where(F.col("doc_id").isin(want["en"] + want["de"]))
    for bins in (1 << 2, 1 << 16):
        monkeypatch.setattr(language_id, "BINS", bins)
        assert np.allclose(learn_pieces(df, F.lit(True), sample=20, rounds=1)[2], learn_pieces(only, F.lit(True), rounds=1)[2])


def test_held_out_accuracy(spark, small):
    got = {r.doc_id: r for r in op3_language_id(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("out", held_out()).collect()
    assert len(got) == len(docs)
    assert all(got[r.doc_id].held_out == r.out and 0 <= got[r.doc_id].score <= 1 for r in docs)
    hits = [got[r.doc_id].lang_pred == r.lang for r in docs if r.out and r.lang]
    assert sum(hits) / len(hits) >= 0.95


def test_odd_texts(spark, frame):
    schema = "doc_id long, text string, lang string"
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(5)] + [(10 + i, "der hund und die katze auf dem dach", "de") for i in range(5)]
    rows += [(20, None, "en"), (21, "", "de"), (22, "123 ²³ ...", None), (23, "日本語", None), (24, "der " * 50000, None), (25, "x" * 5000, "fr"), (25, "x" * 5000, "fr")]
    df = frame(rows, schema, extra=("score", "lang_pred", "learn", "n"))
    learned = learn_pieces(df, F.col("doc_id") < 20)
    assert learned[0] == ["de", "en"]
    got = {r.doc_id: r for r in predict_language(df, learned).collect()}
    assert [got[i].lang_pred for i in (0, 10, 20, 21, 22, 24)] == ["en", "de", "und", "und", "und", "de"]
    assert got[23].lang_pred in ("de", "en") and got[20].score == 0.0 and got[0].lang == "en"
    empty = frame([], schema)
    nothing = learn_pieces(empty, F.lit(True))
    assert nothing[0] == [] and predict_language(empty, nothing).collect() == []
    assert {r.lang_pred for r in predict_language(df, nothing).collect()} == {"und"}
