"""Hashed word shingles of batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text handled at once, in bytes.
SLICE = 2_000_000

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scramble 64-bit values; every salt gives another function."""
    x = (x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(30)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a text column of about equal bytes, with the row at which each starts."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + SLICE, "right")))
        yield start, texts.slice(start, end - start)
        start = end


class Words:
    """Hashes of the words of a part of a text column, in order, with the first word of every row.

    Words are runs of bytes other than ASCII white space; A-Z count as lower case. A word's hash is a polynomial over
    its bytes, taken from sums over the whole part.
    """

    def __init__(self, texts: pa.Array):
        # Bytes have no letters but A-Z to lower; a space closes every row.
        rows = [(x or "").encode().lower() + b" " for x in texts.to_pylist()]
        self.data = np.frombuffer(b"".join(rows), np.uint8)
        edge = np.cumsum([0, *map(len, rows)])
        space = np.concatenate([[True], _SPACES[self.data]])
        self.start = np.flatnonzero(space[:-1] & ~space[1:])
        self.end = np.flatnonzero(~space[:-1] & space[1:])
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(self.data), _BASE)]))
        back = np.uint64(pow(int(_BASE), -1, 2**64))
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(self.data), back)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[self.data] * powers[:-1], dtype=np.uint64)])
        self.hash = mixed((sums[self.end] - sums[self.start]) * inverse[self.start], 1)
        self.first = np.searchsorted(self.start, edge)

    def shingles(self, row: int, size: int) -> np.ndarray:
        """Distinct shingles of a row, sorted; with fewer words than ``size``, all of them as one."""
        return distinct_shingles(self.hash[self.first[row] : self.first[row + 1]], size)


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """The shingle of ``width`` words that starts at each word, as long as one fits."""
    count = max(0, len(words) - width + 1)
    out = np.full(count, np.uint64(width))
    for i in range(width):
        out = out * _STEP + words[i : count + i]
        out = out ^ (out >> np.uint64(32))
    return mixed(out, 2)


def distinct_shingles(words: np.ndarray, size: int) -> np.ndarray:
    return np.unique(rolled(words, min(size, len(words)))) if len(words) else words


def fingerprint(tokens: np.ndarray, salt: int) -> int:
    """A number that depends on a set of tokens, not on their order."""
    return int(mixed(tokens, salt).sum(dtype=np.uint64).astype(np.int64))


def bitmap(tokens: np.ndarray, words: int = 4) -> list[int]:
    """Parities of the tokens' places in ``64 * words`` cells: two sets differ in as many tokens as bits at least."""
    cells = (mixed(tokens, 3) % np.uint64(64 * words)).astype(np.int64)
    odd = (np.bincount(cells, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()
