"""The block-matching ratio against difflib, ties and long sentences included."""

import random
from difflib import SequenceMatcher

import pytest

from disputatio.operators import evidence
from disputatio.operators.evidence import closest, matched


def plain(query, sentences):
    ratios = [SequenceMatcher(None, query, s).ratio() for s in sentences]
    top = max(range(len(ratios)), key=ratios.__getitem__, default=None)
    return (None, None) if top is None else (top, ratios[top])


@pytest.mark.parametrize("letters", ["ab", "abc ", "abcdefghijklmnop äé🎉."])
def test_matched_equals_difflib(letters):
    r = random.Random(letters)
    for n in range(600):
        a, b = ("".join(r.choices(letters, k=r.choice([0, 1, 3, 8, 9, 40, 130]))) for _ in range(2))
        if n % 5 == 0:
            b = a[len(a) // 3 :] + b + a[: len(a) // 2]
        assert matched(a, b) == sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks()), (a, b)


def test_long_sentences_leave_frequent_characters_out():
    r = random.Random(5)
    for n in range(200):
        letters = "".join(map(chr, range(97, 97 + r.choice([3, 20, 26])))) + "".join(map(chr, range(0x400, 0x400 + r.choice([0, 100, 400]))))
        a = "".join(r.choices(letters, k=r.choice([50, 300])))
        b = "".join(r.choices(letters, k=r.choice([199, 200, 201, 350]))) + a[: n % 50]
        assert matched(a, b) == sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


def test_closest_is_the_first_best():
    r = random.Random(7)
    words = ["law", "tax", "vote", "the", "a", "of", "", "äöü"]
    for _ in range(300):
        query, *sentences = (" ".join(r.choices(words, k=r.choice([0, 1, 2, 6, 30]))) for _ in range(r.choice([1, 2, 5, 9])))
        assert closest(query, sentences) == plain(query, sentences)


def test_sentences_out_of_reach_are_not_compared(monkeypatch):
    seen = []
    monkeypatch.setattr(evidence, "matched", lambda a, b: seen.append(b) or matched(a, b))
    assert closest("the new law", ["zzz", "the new law", "qqqq law"]) == (1, 1.0) and seen == ["the new law"]
