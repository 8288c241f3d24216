"""Language identification by unigram pieces, summed over all segmentations of a word."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disputatio.llm.common import broadcast_if_small, saved
from disputatio.llm.pieces import PIECE_MODEL, SPACE, PieceIndex, codes, equal_lengths, load_pieces

UNKNOWN = "und"
# Sums are brought back to one after this many letters, so that they stay in range; the letters' arcs are in memory for as many at a time.
STRETCH = 48
# Every letter's probability is scaled by this factor inside the forward algorithm, for the same reason.
SCALE = 20.0
# Parts of the range of hashes among which the smallest ones of a language are looked for.
BINS = 1 << 16
# Words kept with their scores in one task.
KEPT = 200_000

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def marked(word: str) -> str:
    """A word as the segmenter sees it: its letters after a word start; empty where there is no letter."""
    letters = "".join(filter(str.isalpha, word))
    return SPACE + letters if letters else ""


class Segmenter:
    """Probabilities of words under several piece distributions; the last piece id stands for a letter outside the vocabulary."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray):
        self.index, self.p = PieceIndex(pieces), probabilities
        self.outside = len(pieces)

    def _arcs(self, chars: np.ndarray):
        found = []
        for size, ids in self.index.places(chars):
            if size == 1:
                ids = np.where(ids < 0, self.outside, ids)
            found.append((size, ids, np.where(ids[None] >= 0, self.p[:, ids], 0.0) * SCALE**size))
        return found

    def _stretches(self, length: int) -> list[tuple[int, int, int]]:
        """From where arcs may come, begin and end of each stretch of a word."""
        return [(max(0, at - self.index.longest), at, min(at + STRETCH, length)) for at in range(0, length, STRETCH)]

    @staticmethod
    def _to_one(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last axis with its largest value brought to one, and the log of the factor."""
        most = x.max(-1)
        return x / most[..., None], np.log(most)

    def _forward(self, chars: np.ndarray):
        """Summed probabilities up to every place, a stretch at a time: where it lies, its arcs, the sums, the log they are to be shifted by."""
        kinds, rows = len(self.p), len(chars)
        carry, shift = np.ones((kinds, rows, 1)), np.zeros((kinds, rows))
        for low, begin, end in self._stretches(chars.shape[1]):
            arcs = self._arcs(chars[:, low:end])
            carry, log = self._to_one(carry[:, :, low - begin - 1 :])
            shift = shift + log
            alpha = np.concatenate([carry, np.zeros((kinds, rows, end - begin))], axis=2)
            for at in range(begin - low + 1, end - low + 1):
                for size, _, p in arcs[:at]:
                    alpha[:, :, at] += alpha[:, :, at - size] * p[:, :, at - size]
            carry = alpha
            yield (low, begin, end), arcs, alpha, shift

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Log of the summed probability of all segmentations: distributions by words."""
        out = np.zeros((len(self.p), len(words)))
        for some in equal_lengths(words, 50_000):
            chars = codes([words[i] for i in some]).astype(np.uint64)
            for _, _, alpha, shift in self._forward(chars):
                last = alpha[:, :, -1], shift
            out[:, some] = np.log(last[0]) + last[1] - chars.shape[1] * math.log(SCALE)
        return out

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected uses of every piece (forward-backward) under the one distribution there is."""
        total = np.zeros(self.outside + 1)
        for some in equal_lengths(words, 50_000):
            chars = codes([words[i] for i in some]).astype(np.uint64)
            # Sums are kept for the whole word; arcs are looked up again on the way back.
            sums = [(place, alpha[0], shift[0]) for place, _, alpha, shift in self._forward(chars)]
            whole = np.log(sums[-1][1][:, -1]) + sums[-1][2]
            carry, back = np.ones((len(chars), 1)), np.zeros(len(chars))
            for (low, begin, end), alpha, shift in reversed(sums):
                arcs, first = self._arcs(chars[:, low:end]), begin - low
                carry, log = self._to_one(carry)
                back = back + log
                # What later stretches hand back lies at the end of this one.
                beta = np.concatenate([np.zeros((len(chars), end - low + 1 - carry.shape[1])), carry], axis=1)
                for at in range(end - low, first, -1):
                    for size, _, p in arcs[:at]:
                        beta[:, at - size] += p[0, :, at - size] * beta[:, at]
                weight = times[some] * np.exp(shift + back - whole)
                for size, ids, p in arcs:
                    # Arcs that end in this stretch.
                    start = slice(max(0, first + 1 - size), ids.shape[1])
                    here = alpha[:, start] * p[0][:, start] * beta[:, start.start + size : start.stop + size] * weight[:, None]
                    used = ids[:, start] >= 0
                    total += np.bincount(ids[:, start][used], here[used], len(total))
                carry = beta[:, : first + 1]
        return total


def learn_pieces(
    docs: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    sample: int = 400, rounds: int = 3, smoothing: float = 0.05, model: str = PIECE_MODEL,
) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and piece probabilities per language, by expectation maximisation over all segmentations.

    Fitted on the whole texts of ``sample`` documents per language, those of smallest id hash among the rows that
    ``learn_from`` admits and that have a language; that bound does not depend on the table's size. Per round the
    tasks return expected counts, which are summed per language and piece; the vocabulary bounds what reaches the driver.
    """
    pieces = [p.lower() if not byte else "" for p, _, byte in load_pieces(model)]
    first: dict[str, int] = {}
    pieces = [p if p and all(c.isalpha() for c in p.lstrip(SPACE)) and first.setdefault(p, i) == i else "" for i, p in enumerate(pieces)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), learn_from.alias("learn"))
    rows = rows.where(F.col("learn") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = rows.select("doc_id", "lang").distinct().select("*", F.xxhash64("doc_id").alias("h"))
    ids = ids.withColumn("bin", F.shiftright("h", 64 - BINS.bit_length() + 1))
    # Counts per part of the hash range tell which parts the smallest hashes lie in; only those are ranked.
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("bin")) - F.col("n")
    bins = ids.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n")).withColumn("before", upto).where(F.col("before") < sample)
    bins = bins.groupBy("lang").agg(F.max("bin").alias("last"))
    near = ids.join(broadcast_if_small(saved(bins, "bins"), 32), "lang").where("bin <= last")
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    chosen = saved(ranked.where(F.col("n") <= sample).select("doc_id", "lang"), "sample")
    texts = rows.select("doc_id", "text", "lang").join(broadcast_if_small(chosen, 64), ["doc_id", "lang"], "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, group in batch.groupby("lang"):
                found = Counter(m for t in group["text"] for w in words_of(t) if (m := marked(w)))
                if found:
                    yield pd.DataFrame({"lang": name, "word": list(found), "n": list(found.values())})

    words = texts.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    words = saved(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = [r[0] for r in words.select("lang").distinct().orderBy("lang").collect()]
    used = sum(1 for p in pieces if p) + 1
    probabilities = np.full((len(langs), len(pieces) + 1), 1.0 / used)
    for _ in range(rounds):
        now = probabilities

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals: dict[str, np.ndarray] = {}
            for batch in batches:
                for name, group in batch.groupby("lang"):
                    k = langs.index(name)
                    got = Segmenter(pieces, now[k : k + 1]).expected(group["word"].tolist(), group["n"].to_numpy(float))
                    totals[name] = totals.get(name, 0.0) + got
            for name, total in totals.items():
                ids = np.flatnonzero(total)
                yield pd.DataFrame({"lang": name, "piece": ids, "n": total[ids]})

        sums = words.mapInPandas(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros((len(langs), len(pieces) + 1))
        table[[langs.index(x) for x in sums["lang"]], sums["piece"]] = sums["n"]
        probabilities = (table + smoothing) / (table.sum(1, keepdims=True) + smoothing * used)
    return langs, pieces, probabilities


def predict_language(docs: DataFrame, learned: tuple[list[str], list[str], np.ndarray], text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its posterior probability (languages equally likely beforehand, six decimals).

    A text's probability is the product over its words of the probability summed over all ways to cut the word
    into pieces. Null, text without a letter, and anything while no language is learned give ``und`` and 0. Ties go to the
    language that sorts first. Columns of those names are replaced; all others stay.
    """
    langs, pieces, probabilities = learned
    columns = [c for c in docs.columns if c not in (lang_pred, score)]
    schema = docs.select(*columns).withColumn(lang_pred, F.lit("")).withColumn(score, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number = Segmenter(pieces, probabilities), {}
        values = np.zeros((0, len(langs)))
        for batch in batches:
            texts = batch.column(columns.index(text)).to_pylist()
            names, scores = [], []
            for at in range(0, len(texts), 500):
                lines = [words_of(t) if t else [] for t in texts[at : at + 500]]
                if len(number) > KEPT:
                    number, values = {}, np.zeros((0, len(langs)))
                fresh = sorted({w for line in lines for w in line if w not in number})
                seen = [marked(w) for w in fresh]
                sums = model.log_probabilities(seen).T if langs else np.zeros((len(fresh), 0))
                sums[[not x for x in seen]] = np.nan
                number |= zip(fresh, range(len(number), len(number) + len(fresh)))
                values = np.concatenate([values, sums])
                for line in lines:
                    rows = values[list(map(number.__getitem__, line))] if langs else values[:0]
                    rows = rows[~np.isnan(rows[:, 0])] if len(rows) else rows
                    if not len(rows):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    total = rows.sum(0)
                    best = int(total.argmax())
                    names.append(langs[best])
                    scores.append(round(float(1.0 / np.exp(total - total[best]).sum()), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*columns, lang_pred, score])

    return docs.select(*columns).mapInArrow(run, schema)
