"""Encoding texts as pieces of a fixed vocabulary, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputatio.llm.pieces import FOREIGN, PIECE_MODEL, SPACE, PieceIndex, codes, equal_lengths, load_pieces

# Text handled at once, in characters, and words kept between batches.
SLICE, KEPT = 2_000_000, 300_000

_UNIT = re.compile(" +[^ ]*")


class Viterbi:
    """Best segmentation of words: the largest sum of piece scores; among equal sums the shorter last piece.

    A character that no piece covers costs more than any piece and becomes its UTF-8 bytes.
    """

    def __init__(self, vocabulary: list[tuple[str, float, bool]]):
        self.index = PieceIndex([p if p and not byte else "" for p, _, byte in vocabulary])
        self.scores = np.array([s for _, s, _ in vocabulary])
        usual = [s for p, s, byte in vocabulary if p and not byte and s > -1e8]
        self.unknown = min(usual, default=0.0) - 10.0
        self.bytes = {int(p[3:5], 16): i for i, (p, _, byte) in enumerate(vocabulary) if byte}

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word as 32-bit integers. Words of one length advance together, character by character."""
        out: list[bytes] = [b""] * len(words)
        for part in equal_lengths(words):
            some = [words[i] for i in part]
            chars = codes([w.replace(SPACE, "\U0010ffff").replace(" ", SPACE) for w in some]).astype(np.uint64)
            if any(SPACE in w for w in some):
                chars[codes(some) == ord(SPACE)] = FOREIGN
            rows, length = chars.shape
            found = list(self.index.places(chars))
            best = np.full((rows, length + 1), -np.inf)
            best[:, 0] = 0.0
            back = np.zeros((rows, length + 1), np.int32)
            piece = np.full((rows, length + 1), -1, np.int32)
            gains = [(size, ids, np.where(ids >= 0, self.scores[ids], self.unknown if size == 1 else -np.inf)) for size, ids in found]
            for end in range(1, length + 1):
                for size, ids, gain in gains[:end]:
                    now = best[:, end - size] + gain[:, end - size]
                    better = now > best[:, end]
                    best[better, end] = now[better]
                    back[better, end] = size
                    piece[better, end] = ids[better, end - size]
            # Walk back all words at once; a word that has arrived at its start stays there.
            at = np.full(rows, length)
            steps = []
            every = np.arange(rows)
            while at.any():
                live = at > 0
                steps.append(np.where(live, piece[every, at], -2))
                at = at - np.where(live, back[every, at], 0)
                steps[-1] = np.where(steps[-1] == -1, -3 - at, steps[-1])
            ids = np.stack(steps[::-1], axis=1)
            whole = (ids > -3).all(1)
            for i, word, line, ok in zip(part.tolist(), some, ids, whole.tolist()):
                line = line[line != -2]
                if not ok:
                    line = np.array([x for p in line.tolist() for x in ([p] if p >= 0 else [self.bytes[b] for b in word[-3 - p].encode("utf-8", "surrogatepass")])])
                out[i] = line.astype(np.int32).tobytes()
        return out


def _slices(texts: list[str | None]) -> Iterator[slice]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", model: str = PIECE_MODEL) -> DataFrame:
    """Add the piece ids of each text as ``array<int>``, in the column ``ids`` (replaced if there is one).

    The text is segmented into pieces of largest summed score (a Viterbi search with the model file's scores), as
    SentencePiece's unigram encoder does; a model file trained by merging gives other ids than its own merge
    order, but they decode to the same text. A space goes before the text, spaces are written as pieces, characters
    outside the vocabulary become bytes, and nothing is normalised: decoding gives back every text exactly.
    No piece holds a space after another character, so texts fall apart into units that start with spaces; units
    are segmented once per task and kept. Null stays null, an empty text has no ids.
    """
    vocabulary = load_pieces(model)
    inner = [p for p, _, _ in vocabulary if SPACE in p.lstrip(SPACE)]
    if inner:
        raise ValueError(f"pieces with an inner space are not supported: {inner[:3]}")
    columns = [c for c in df.columns if c != ids]
    schema = df.select(*columns).withColumn(ids, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known = Viterbi(vocabulary), {}
        for batch in batches:
            texts = batch.column(columns.index(text)).to_pylist()
            for part in _slices(texts):
                units = [None if t is None else _UNIT.findall(" " + t) if t else [] for t in texts[part]]
                fresh = sorted({u for line in units if line for u in line if u not in known})
                if len(known) + len(fresh) > KEPT:
                    known = {}
                    fresh = sorted({u for line in units if line for u in line})
                known |= zip(fresh, coder.encode(fresh))
                joined = [b"" if line is None else b"".join(map(known.__getitem__, line)) for line in units]
                ends = np.cumsum([0] + [len(x) // 4 for x in joined])
                offsets = pa.array(ends.astype(np.int32), mask=np.array([x is None for x in units] + [False]))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(joined), np.int32)))
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*columns, ids])

    return df.select(*columns).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", model: str = PIECE_MODEL) -> DataFrame:
    """Add the text of each list of ids. Null stays null, no ids are an empty text; ids of control pieces add nothing."""
    vocabulary = load_pieces(model)
    parts = [bytes([int(p[3:5], 16)]) if byte else p.replace(SPACE, " ").encode() for p, _, byte in vocabulary]
    columns = [c for c in df.columns if c != text]
    schema = df.select(*columns).withColumn(text, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(columns.index(ids))
            flat, ends, gone = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)))]), lists.is_null().to_pylist()
            out = []
            for i, null in enumerate(gone):
                line = flat[int(ends[i]) : int(ends[i + 1])].tolist()
                out.append(None if null else b"".join(map(parts.__getitem__, line)).decode("utf-8", "replace")[1:])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*columns, text])

    return df.select(*columns).mapInArrow(run, schema)
