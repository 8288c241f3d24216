"""Quality of documents from overlapping heuristics, learned without labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from disputatio.llm.common import saved
from disputatio.llm.shingles import mixed, slices

VOTES = ("symbols", "capitals", "repeats", "bars", "word_length", "letters", "length", "sentences")
SYMBOLS, MARKS = "*&%$#!|~^<>{}[]=\\", ".!?"

# What a character is; the flags of one character add up.
SPACE, UPPER, LOWER, LETTER, DIGIT, SYMBOL, BAR, MARK = (1 << i for i in range(8))
_BASE = 0x9E3779B97F4A7C15


class Kinds:
    """Flags of code points, looked up once for every character that occurs."""

    def __init__(self):
        self.flags, self.known = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)

    def of(self, chars: np.ndarray) -> np.ndarray:
        new = np.unique(chars[~self.known[chars]])
        self.flags[new], self.known[new] = [self._flags(chr(c)) for c in new.tolist()], True
        return self.flags[chars]

    def _flags(self, c: str) -> int:
        kind = unicodedata.category(c)
        letter = {"Lu": UPPER, "Ll": LOWER}.get(kind, LETTER if kind[0] == "L" else 0)
        space = SPACE * (c == " " or "\t" <= c <= "\r")
        return space + letter + DIGIT * ("0" <= c <= "9") + SYMBOL * (c in SYMBOLS) + BAR * (c == "|") + MARK * (c in MARKS)


def _word_hashes(chars: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and a hash of its characters. The last character is a space."""
    before = np.concatenate([[True], space[:-1]])
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(chars) - 1, np.uint64(_BASE))]))
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(chars) - 1, np.uint64(pow(_BASE, -1, 2**64)))]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((chars + np.uint64(1)) * powers, dtype=np.uint64)])
    return start, mixed((sums[end] - sums[start]) * inverse[start], 1)


class Texts:
    """Words and character counts of a part of a text column; null counts as empty."""

    def __init__(self, texts: pa.Array, kinds: Kinds):
        # A space closes every row.
        rows = [(x or "") + " " for x in texts.to_pylist()]
        self.rows = len(rows)
        self.chars = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.flags = kinds.of(self.chars)
        self.size = np.fromiter(map(len, rows), np.int64, len(rows)) - 1
        self.edge = np.concatenate([[0], np.cumsum(self.size + 1)])
        start, self.hash = _word_hashes(self.chars.astype(np.uint64), (self.flags & SPACE) > 0)
        self.n = np.diff(np.searchsorted(start, self.edge))
        self.row = np.repeat(np.arange(self.rows), self.n)

    def count(self, flag: int) -> np.ndarray:
        return np.add.reduceat((self.flags & flag) > 0, self.edge[:-1], dtype=np.int64)

    def distinct_words(self) -> np.ndarray:
        first = np.unique(mixed(self.hash + mixed(self.row.astype(np.uint64), 2), 3), return_index=True)[1]
        return np.bincount(self.row[first], minlength=self.rows)

    def votes(self) -> np.ndarray:
        """A row per text: the labellers' votes, 1 good, -1 bad, 0 none."""
        size, n, letters = np.maximum(self.size, 1), np.maximum(self.n, 1), self.count(UPPER | LOWER | LETTER)
        per_sentence, mean, short = n / (self.count(MARK) + 1), letters / n, self.n < 30
        alarms = {
            "symbols": self.count(SYMBOL) / size > 0.05,
            "capitals": self.count(UPPER) / np.maximum(letters, 1) > 0.5,
            "repeats": ~short & (1 - self.distinct_words() / n > 0.85),
            "bars": self.count(BAR) / n > 0.2,
            "word_length": (mean < 2) | (mean > 12),
            "letters": letters / size < 0.6,
            "length": self.n < 3,
            "sentences": ~short & (per_sentence > 100),
        }
        praise = {"length": self.n > 50, "sentences": ~short & (per_sentence > 3) & (per_sentence < 40)}
        return np.stack([np.where(alarms[v], -1, praise.get(v, np.zeros(self.rows, bool))) for v in VOTES], axis=1)

    def tokens(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and bucket of every word and of every word's shape, where runs of upper case, lower case and digits are one character each."""
        run = self.flags & (UPPER | LOWER | DIGIT)
        kept = np.concatenate([[True], (run[1:] != run[:-1]) | (run[1:] == 0)])
        run, chars = run[kept], self.chars[kept].astype(np.uint64)
        # Shape characters lie beyond all code points.
        shaped = np.where(run > 0, run + np.uint64(0x110000), chars)
        shapes = _word_hashes(shaped, (self.flags[kept] & SPACE) > 0)[1]
        both = np.concatenate([mixed(self.hash, 4), mixed(shapes, 5)])
        return np.concatenate([self.row, self.row]), (both % np.uint64(buckets)).astype(np.int64)


def pattern_of(votes: np.ndarray) -> np.ndarray:
    """One number per combination of votes."""
    return (votes + 1) @ 3 ** np.arange(votes.shape[1])


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(VOTES)) % 3 - 1


def label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 50, trust: tuple[float, float] = (0.95, 0.6), lean: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "good" per vote pattern, and the accuracies of each labeller's bad and good votes.

    A vote is right with the accuracy of its labeller, for bad and good votes apart. Expectation and maximisation alternate, from "any
    bad vote is bad". Good and bad are equally likely beforehand, as such votes do not tell the balance. Accuracies lean on
    ``trust`` with ``lean`` times the weight of the votes: junk of one sort alarms one labeller alone, and without that lean
    the others would outvote it.
    """
    bad, good = (votes < 0) * counts[:, None], (votes > 0) * counts[:, None]
    post = np.where((votes < 0).any(1), 0.05, np.where((votes > 0).any(1), 0.95, 0.5))
    accuracy = np.zeros((2, votes.shape[1]))
    for _ in range(rounds):
        for k, (cast, right) in enumerate(((bad, 1 - post), (good, post))):
            n = cast.sum(0)
            accuracy[k] = np.clip((right @ cast + (lean * n + 1) * trust[k]) / ((1 + lean) * n + 1), 0.5, 0.99)
        weight = np.log(accuracy / (1 - accuracy))
        post = 1 / (1 + np.exp(-np.clip((votes > 0) @ weight[1] - (votes < 0) @ weight[0], -500, 500)))
    return post, accuracy


def score_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 4000, buckets: int = 1 << 14, rounds: int = 50) -> DataFrame:
    """One row per document: ``doc_id, weak_label, quality``.

    ``weak_label`` is the label model's probability that the document is good, given its votes; the model sees the counts
    of all documents per vote pattern (at most three to the number of labellers). ``quality`` is the score of a logistic regression on
    hashed words and word shapes, fitted to the weak labels of ``sample`` documents of smallest id hash. Null and empty
    texts have quality 0 and do not take part in fitting. Repeated rows count each.

    Texts are read twice, for the votes and for the scores; between them only ids and vote patterns are kept.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = rows.schema["doc_id"]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds()
        for batch in batches:
            for at, part in slices(batch.column(1)):
                texts = Texts(part, kinds)
                columns = [batch.column(0).slice(at, len(part)), pa.array(texts.n), pa.array(pattern_of(texts.votes()).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "pattern"])

    voted = saved(rows.mapInArrow(vote, StructType([key, StructField("n", LongType()), StructField("pattern", IntegerType())])), "votes")
    voted = voted.where("n > 0")
    # As many rows as there are vote patterns, which the number of labellers bounds.
    patterns = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("count")).orderBy("pattern").collect()
    weak = np.full(3 ** len(VOTES), 0.5)
    if patterns:
        seen = np.array([r["pattern"] for r in patterns])
        weak[seen] = label_model(votes_of(seen), np.array([r["count"] for r in patterns], float), rounds)[0].round(9)
    chosen = voted.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds()
        for batch in batches:
            for _, part in slices(batch.column(0)):
                texts = Texts(part, kinds)
                row, bucket = texts.tokens(buckets)
                order = np.argsort(row, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * texts.n)]).astype(np.int32)), pa.array(bucket[order]).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(weak[pattern_of(texts.votes())])], ["tokens", "weak_label"])

    fit = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("text").mapInArrow(label, "tokens array<string>, weak_label double").where("size(tokens) > 0")
    counted = CountVectorizerModel.from_vocabulary([str(b) for b in range(buckets)], "tokens", "counts").transform(fit) if patterns else None
    weights, bias = np.zeros(buckets), 0.0
    if counted is not None:
        unit = Normalizer(inputCol="counts", outputCol="features").transform(counted)
        fit = saved(unit.select("features", (F.col("weak_label") > 0.5).cast("double").alias("label"), F.abs(F.col("weak_label") * 2 - 1).alias("weight")), "fit")
        # Labels of one kind only teach nothing: every text with words then has a quality of one half.
        if fit.select("label").distinct().count() > 1:
            model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50, standardization=False).fit(fit)
            weights, bias = model.coefficients.toArray(), float(model.intercept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Kinds()
        for batch in batches:
            for at, part in slices(batch.column(1)):
                texts = Texts(part, kinds)
                row, bucket = texts.tokens(buckets)
                cells, counts = np.unique(row * buckets + bucket, return_counts=True)
                row, norm = cells // buckets, np.sqrt(np.bincount(cells // buckets, counts.astype(float) ** 2, texts.rows))
                total = np.bincount(row, counts * weights[cells % buckets], texts.rows) / np.maximum(norm, 1) + bias
                some = texts.n > 0
                quality = np.where(some, np.round(1 / (1 + np.exp(-np.clip(total, -500, 500))), 6), 0.0)
                labels = np.where(some, weak[pattern_of(texts.votes())], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(labels), pa.array(quality)], ["doc_id", "weak_label", "quality"])

    return rows.mapInArrow(score, StructType([key, StructField("weak_label", DoubleType()), StructField("quality", DoubleType())]))
