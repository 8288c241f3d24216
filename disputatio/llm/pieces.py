"""A fixed public vocabulary of pieces, and all places where pieces occur in batches of words."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# SentencePiece writes a space as this character.
SPACE = "▁"
# A space character that was in the text itself; no piece holds this code.
FOREIGN = 0x110000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(path: str = PIECE_MODEL) -> list[tuple[str, float, bool]]:
    """Piece, score and whether it is a byte, by id; control pieces have an empty string. Read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.vocab_size()):
        plain = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        out.append((model.id_to_piece(i) if plain else "", model.get_score(i), model.is_byte(i)))
    return out


def equal_lengths(words: list[str], cells: int = 200_000):
    """Index arrays of words of one length, a bounded number of characters at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(order, cuts):
        if len(part) and lengths[part[0]]:
            step = max(1, cells // int(lengths[part[0]]))
            for at in range(0, len(part), step):
                yield part[at : at + step]


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(words), -1)


@dataclass
class PieceIndex:
    """Pieces by the hash of their characters, as sorted keys behind a table that rules most substrings out."""

    pieces: list[str]
    longest: int = 0
    keys: np.ndarray = field(default=None, repr=False)
    ids: np.ndarray = field(default=None, repr=False)
    table: np.ndarray = field(default=None, repr=False)
    bits: int = 20

    def __post_init__(self):
        kept = [i for i, p in enumerate(self.pieces) if p]
        self.longest = max((len(self.pieces[i]) for i in kept), default=1)
        hashes = np.zeros(len(kept), np.uint64)
        texts = [self.pieces[i] for i in kept]
        for part in equal_lengths(texts):
            m = codes([texts[i] for i in part])
            h = np.zeros(len(m), np.uint64)
            for j in range(m.shape[1]):
                h = (h + m[:, j] + np.uint64(1)) * _FACTOR
                h ^= h >> np.uint64(29)
            hashes[part] = h
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(kept, np.int32)[order]
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def places(self, chars: np.ndarray):
        """For each piece length: ids of the piece that starts at each place of each word, or -1 where there is none."""
        rows, length = chars.shape
        h = np.zeros((rows, length), np.uint64)
        for size in range(1, min(self.longest, length) + 1):
            h = (h[:, : length - size + 1] + chars[:, size - 1 :] + np.uint64(1)) * _FACTOR
            h ^= h >> np.uint64(29)
            out = np.full(h.shape, -1, np.int32)
            maybe = np.flatnonzero(self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)].ravel())
            if len(maybe):
                wanted = h.ravel()[maybe]
                at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                hit = self.keys[at] == wanted
                out.ravel()[maybe[hit]] = self.ids[at[hit]]
            yield size, out
