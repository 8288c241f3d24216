"""Secrets in texts: fixed formats, and strings whose entropy in a sliding window is too high for words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex")
ENTROPY = "entropy"

# Fixed formats, with the least length that counts (for an assignment, of its second group).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Entropies are sums of whole numbers, so that every engine finds the same windows.
SCALE = 1 << 20


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of ``characters`` of at least ``window`` of them; a window needs ``bits`` of entropy a character."""

    name: str
    characters: str
    window: int
    bits: float

    @property
    def most(self) -> int:
        """Largest sum of n * log2(n) over a window's counts that leaves ``bits``."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * SCALE)


CLASSES = (CharacterClass("hexadecimal", "0-9A-Fa-f", 20, 2.9), CharacterClass("base64", "A-Za-z0-9+/_-", 20, 3.8))

# What looks like a secret and is none: runs without or of digits alone, identifiers, placeholders, alphabets.
ALLOWED = (
    "^[^0-9]*$", "^[0-9]*$", "^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    "example|EXAMPLE|sample|dummy|placeholder|xxxx|XXXX", "01234567|abcdefgh|ABCDEFGH",
)
# Words right before a span that say it is public: a check sum or a version.
ALLOWED_BEFORE = r"(?:commit|sha1|sha256|sha384|sha512|md5|checksum|digest|integrity|uuid)[^A-Za-z0-9]{0,3}"
BEFORE = 16

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))


def scaled(n: int) -> int:
    """n * log2(n) as a whole number."""
    return round(n * math.log2(n) * SCALE) if n else 0


def dense_parts(run: str, window: int, most: int) -> list[tuple[int, int]]:
    """The parts of a run that windows of high entropy cover; windows that overlap or touch make one part.

    A step to the next window changes the counts of two characters, and their sum by two differences.
    """
    step = [scaled(n + 1) - scaled(n) for n in range(window + 1)]
    counts: dict[str, int] = {}
    total, out = 0, []
    for i, entering in enumerate(run):
        n = counts.get(entering, 0)
        counts[entering], total = n + 1, total + step[n]
        if i >= window:
            leaving = run[i - window]
            n = counts[leaving] - 1
            counts[leaving], total = n, total - step[n]
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


class Scanner:
    """Compiled patterns; made once for each task."""

    def __init__(self, classes: Sequence[CharacterClass], allowed: Sequence[str], before: str):
        # Runs of one class are whole, so a least length in the pattern finds the runs that are long enough.
        self.assign = re.compile(ASSIGN, re.I | re.A)
        self.formats = {"access": re.compile(f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}"), "hex": re.compile(f"[0-9a-f]{{{LEAST['hex']},}}")}
        self.runs = [(c, re.compile(f"[{c.characters}]{{{c.window},}}")) for c in classes]
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed)) if allowed else None
        self.before = re.compile(f"(?:{before})\\Z") if before else None
        # What any text with a span must match, for the filter over whole batches.
        self.gates = [f"(?i){ASSIGN}", "AKIA[A-Z0-9]{16}", *[f"[{c.characters}]{{{c.window}}}" for c in classes]]

    def base(self, text: str) -> list[tuple[int, int, str]]:
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
        for kind, pattern in self.formats.items():
            found += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
        return [(start, end, KINDS[rank]) for start, rank, end in sorted(found)]

    def dense(self, text: str) -> list[tuple[int, int]]:
        """Spans of high entropy that no allow-list knows."""
        found = []
        for c, pattern in self.runs:
            for run in pattern.finditer(text):
                for start, end in dense_parts(run.group(), c.window, c.most):
                    start, end = run.start() + start, run.start() + end
                    if self.allowed and self.allowed.search(text[start:end]) or self.before and self.before.search(text[max(0, start - BEFORE) : start]):
                        continue
                    found.append((start, end))
        return united(found)

    def scan(self, text: str) -> tuple[list[dict], list[dict]]:
        base = self.base(text)
        taken = united([(start, end) for start, end, _ in base])
        added, at = [], 0
        for start, end in self.dense(text):
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if at == len(taken) or taken[at][0] >= end:
                added.append((start, end, ENTROPY))
        rank = [*KINDS, ENTROPY].index
        as_rows = lambda spans: [{"start": s, "kind": k, "end": e} for s, e, k in spans]
        return as_rows(base), as_rows(sorted(base + added, key=lambda x: (x[0], rank(x[2]), x[1])))


def find_secrets(
    docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans",
    classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED, before: str = ALLOWED_BEFORE,
) -> DataFrame:
    """Add two columns of spans (``start, kind, end``; code points, end exclusive): the fixed formats, and all that is found.

    Candidates are the runs of each character class that hold a window at least. A window slides over a candidate with
    counts kept up to date; where its Shannon entropy reaches the class's bits, it is dense. Dense windows that overlap or
    touch make a span, unless the allow-list knows its text or the words right before it. Spans of several classes that
    overlap are united. Those that overlap no fixed format are added with the kind ``entropy``. Spans are ordered by start, then kind.

    A scan without a shuffle: four patterns run over whole Arrow batches first, and only texts that match one are read by Python.
    Null and empty texts have no spans; a text of any length is read whole, its runs step by step. Repeated rows are separate rows.
    An empty table gives an empty table. Columns named like ``base`` or ``spans`` are replaced, all others stay.
    """
    columns = [c for c in docs.columns if c not in (base, spans) or c == text]
    rows = docs.select(*columns)
    at = columns.index(text)
    out = T.StructType([*rows.schema.fields, T.StructField("_base", SPANS), T.StructField("_spans", SPANS)])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed, before)
        for batch in batches:
            texts = batch.column(at)
            hit = pa.array([False] * len(texts), pa.bool_())
            for gate in scanner.gates:
                hit = pc.or_(hit, pc.fill_null(pc.match_substring_regex(texts, gate), False))
            found = [scanner.scan(t.as_py()) if h else ([], []) for t, h in zip(texts, hit.to_pylist())]
            arrays = [pa.array([f[i] for f in found], _ARROW_SPANS) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "_base", "_spans"])

    found = rows.mapInArrow(scanned, out)
    kept = [F.col(c) for c in columns if c not in (base, spans)]
    return found.select(*kept, F.col("_base").alias(base), F.col("_spans").alias(spans))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
