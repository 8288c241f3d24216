"""Secrets against the formats by Python's expressions, a plain entropy, and the SQL on odd texts."""

import hashlib
import math
import random
import re
import string

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from disputatio.llm.queries_secrets import OP12, op12_secrets
from disputatio.llm.secrets import ALLOWED, ALLOWED_BEFORE, CLASSES, KINDS, CharacterClass, dense_parts, find_secrets, joined

PATTERNS = {
    "assign": r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA([A-Z0-9]+)",
    "hex": r"([0-9a-f]+)",
}
LEAST = {"assign": 6, "access": 16, "hex": 24}
RANDOM = random.Random(5)


def noise(letters, n):
    return "".join(RANDOM.choices(letters, k=n))


BASE64 = string.ascii_letters + string.digits + "+/"
KEY = "q8Zr1VtB7xKp0LmW3cYd9NsJ5hGf2TuA"
TEXTS = [
    "password=hunter22 and Token : 'abc' SECRET:\"a.b=c-d\" api_key=xyz api_key = x1y2z3 apikey:abcdef", "token: token: abcdef and token: secret: abcdefgh",
    "AKIA" + "A" * 15 + " AKIA" + "B7" * 8 + " AKIAAKIA" + "C" * 14, "f" * 23 + " " + "0f" * 12 + "g" + "a1" * 40, f"key {KEY} end", f"é🎉 {KEY}é🎉{KEY[::-1]} x",
    f"commit {noise('0123456789ABCDEF', 40)} sha256:{KEY}", "123e4567-E89b-12d3-a456-426614174000", "1234567890" * 6, "abcdefghijklmnopqrstuvwxyz0123456789", f"EXAMPLE{KEY} {KEY}xxxx{KEY}",
    f"secret={KEY}", f"{KEY}/{noise('ab', 60)}/{KEY}1{KEY}", noise(BASE64, 5000), noise("0123456789ABCDEF", 3000), "a" * 30000, "=" * 3000, "token=" * 2000, f"ſecret=abcdefg toKen=abcdefg {KEY}",
    "getElementsByTagNameAndClassNameOrIdentifier2", "", None, " ", KEY, KEY, f"{'A1b2' * 9}{KEY}", f"{noise('0123456789abcdefABCDEF', 25)}-{KEY}", f"\n{KEY}\r\n{KEY}\t",
]


def plain_base(text):
    found = []
    for rank, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text, re.A):
            if len(m.group(1)) >= LEAST[kind]:
                found.append((m.start(), rank, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def entropy(window):
    return sum(-window.count(c) / len(window) * math.log2(window.count(c) / len(window)) for c in set(window))


def plain(text):
    """Base spans, and those covered by windows of enough entropy, each window counted anew."""
    text = text or ""
    base, dense = plain_base(text), set()
    for c in CLASSES:
        for run in re.finditer(f"[{c.characters}]+", text):
            parts = []
            for i in range(len(run.group()) - c.window + 1):
                if entropy(run.group()[i : i + c.window]) >= c.bits - 1e-7:
                    if parts and i <= parts[-1][1]:
                        parts[-1][1] = i + c.window
                    else:
                        parts.append([i, i + c.window])
            for s, e in parts:
                s, e = s + run.start(), e + run.start()
                if not any(re.search(p, text[s:e]) for p in ALLOWED) and not re.search(ALLOWED_BEFORE + r"\Z", text[max(0, s - 16) : s]):
                    dense |= set(range(s, e)) | {(s, e)}
    spans = sorted(x for x in dense if isinstance(x, tuple))
    merged = []
    for s, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    added = [(s, "entropy", e) for s, e in merged if not any(b < e and s < f for b, _, f in base)]
    return base, sorted(base + added, key=lambda x: (x[0], [*KINDS, "entropy"].index(x[1])))


def words(spans):
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def test_spans_equal_a_plain_search(spark, frame):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4])]
    df = frame(rows, "doc_id long, text string", extra=("base", "spans", "start", "_base", "_gap"))
    got = find_secrets(df.drop("_base")).select("doc_id", "_gap", joined(F.col("base")).alias("b"), joined(F.col("spans")).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        base, spans = plain(TEXTS[r.doc_id])
        assert (r.b, r.s, r._gap) == (words(base), words(spans), "x"), TEXTS[r.doc_id]


def test_planted_keys_are_added_and_prose_is_not(spark):
    keys = [noise(BASE64 + "_-", 40) for _ in range(60)] + [noise("0123456789ABCDEF", 40) for _ in range(60)]
    prose = ["".join(RANDOM.choices(["tion", "en", "schver", "keit", "the", "oua"], k=9)) for _ in range(120)]
    rows = [(i, f"some words {k} and more") for i, k in enumerate(keys + prose)]
    got = {r.doc_id: r.spans for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(bool(got[i]) for i in range(120)) >= 118
    assert not any(got[i] for i in range(120, 240))


def test_parameters(spark):
    df = spark.createDataFrame([(1, "aaaabbbb abcdefgh")], "doc_id long, text string")
    own = [CharacterClass("letters", "a-z", 4, 2.0)]
    got = find_secrets(df, classes=own, allowed=(), before="").first()
    assert [(s.start, s.kind, s.end) for s in got.spans] == [(9, "entropy", 17)]
    assert find_secrets(df, classes=own).first().spans == []


def test_windows_step_by_step():
    run = noise(BASE64, 400) + "a" * 60 + noise(BASE64, 90)
    c = CLASSES[1]
    want = {i for i in range(len(run) - c.window + 1) if entropy(run[i : i + c.window]) >= c.bits}
    covered = {j for i in want for j in range(i, i + c.window)}
    assert {j for s, e in dense_parts(run, c.window, c.most) for j in range(s, e)} == covered


def test_empty_table(spark):
    got = find_secrets(spark.createDataFrame([], "doc_id long, text string, base string"))
    assert got.columns == ["doc_id", "text", "base", "spans"] and got.count() == 0


@pytest.mark.parametrize("text", TEXTS)
def test_sql_says_the_same(text):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([1]), "text": pa.array([text], pa.string())}))
    doc_id, *counts, digest, spans = con.execute(OP12).fetchall()[0]
    base, every = plain(text)
    assert spans == words(every)
    assert counts == [sum(k == kind for _, k, _ in base) for kind in KINDS]
    assert digest == hashlib.sha256(words(base).encode()).hexdigest()


def test_query_over_documents(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = op12_secrets(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        base, spans = plain(texts[r.doc_id])
        assert (r.base_sha256, r.spans) == (hashlib.sha256(words(base).encode()).hexdigest(), words(spans))
