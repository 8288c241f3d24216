"""Conversation repair against a plain search over all edits, row by row."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pyarrow as pa
import pytest

from disputatio.llm.conversation_repair import FINAL, Step, lightest, repair_conversations, summarised
from disputatio.llm.queries_repair import OP11, damaged

FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def plain(rows):
    """``rows``: (turn, role, text) after damage, nulls as None in the turn only."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in rows if t is not None}
    kinds = faults(rows)
    # Roles so far decide what may follow; every derivation is kept as (cost, edits, lines) by its last role.
    best = {"": (0, "", ())}

    def better(to, at, x):
        if at not in to or x < to[at]:
            to[at] = x

    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for at, (cost, audit, lines) in list(out.items()):
                new = follows[at][-1]
                better(out, new, (cost + 3, audit + "I", (*lines, names[new] + ":")))
        return out

    for (_, role, text), fault in zip(rows, kinds):
        after = {}
        for at, (cost, audit, lines) in inserted(best).items():
            better(after, at, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = cost + 3 * (fault == "truncated")
            if role[:1] and role[:1] in follows[at]:
                better(after, role[:1], (more, audit + "K", (*lines, f"{role}:{text}")))
            new = follows[at][-1]
            better(after, new, (more + 3, audit + "R", (*lines, f"{names[new]}:{text}")))
        best = after
    cost, audit, lines = min(x for at, x in inserted(best).items() if at in ("", "a"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        said = out.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        said += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def conversations(seed, count, longest, texts=("Yes.", "No", "  ", "Why? \n", "é!", "a\nb.", "x")):
    r = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(r.randint(0, longest)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "ultra", None])
            rows.append((conv, r.choice([turn, turn, turn, turn + 3, None]), role, r.choice([*texts, f"text {turn}.", f"t{turn}", None])))
    return rows


def check(spark, frame, rows, **options):
    df = frame(rows, "conv_id long, turn long, role string, text string", extra=("block", "whole", "copies", "partition", "said", "new", "cut")).repartition(3)
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in summarised(repair_conversations(damaged(df), copies="copies", **options)).collect()}
    want = {conv: plain(said) for conv, said in plain_damage(rows).items()}
    assert got == want


def test_short_conversations(spark, frame):
    check(spark, frame, conversations(1, 60, 9) + [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (10**15, 0, None, "")])


def test_long_conversations_in_parts(spark, frame):
    rows = conversations(2, 6, 90) + [(99, i, "user" if i % 3 else "assistant", f"line {i}.") for i in range(300)] + [(98, 5, "assistant", "Same.")] * 400
    check(spark, frame, rows, block_rows=7)
    check(spark, frame, rows, block_rows=1)


def test_one_conversation_with_most_rows(spark, frame):
    rows = [(1, i // 2, ["user", "assistant"][i % 2], f"line {i % 700}.") for i in range(3000)] + conversations(3, 10, 6)
    df = spark.createDataFrame([(*r, 1) for r in rows if None not in r], "conv_id long, turn long, role string, text string, copies int")
    parts = repair_conversations(df, copies="copies", block_rows=50)
    by_part = parts.where("conv_id = 1").count()
    assert by_part > 20
    said = {}
    for conv, *row in (r for r in rows if None not in r):
        said.setdefault(conv, []).append(tuple(row))
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in summarised(parts).collect()}
    assert got == {conv: plain(x) for conv, x in said.items()}


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi"), (1, 3, "user", "Hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = repair_conversations(df).collect()
    assert r.whole is False or r.block >= 0
    assert [(x.role, x.text) for x in r.repaired][:3] == [("system", "Be brief."), ("user", ""), ("assistant", "Hello.")]
    assert (r.duplicate, r.truncated) == (1, 1)


def test_lightest_is_the_least_of_all():
    """All derivations of short inputs, enumerated without any pruning."""
    r = random.Random(9)
    moves = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    given = "uuau"

    def every(steps, state, inserts):
        if not steps:
            if state in FINAL:
                yield 0, ""
        else:
            head, *rest = steps
            for c, a in every(rest, state, inserts):
                yield c + 4 * head.times, "D" + a
            if head.kind != "D":
                for c, a in every(rest, moves[state][given[state]], inserts):
                    yield c + 3 + 3 * head.cut, "R" + a
                if head.kind in moves[state]:
                    for c, a in every(rest, moves[state][head.kind], inserts):
                        yield c + 3 * head.cut, "K" + a
        if inserts:
            for c, a in every(steps, moves[state][given[state]], inserts - 1):
                yield c + 3, "I" + a

    for _ in range(60):
        steps = [Step(r.choice("suaouaD"), r.random() < 0.3) for _ in range(r.randint(0, 4))]
        assert next(iter(lightest(steps, 0, FINAL).values())) == min(every(steps, 0, 4))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert summarised(repair_conversations(df)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_sql_says_the_same(seed):
    rows = conversations(10 + seed, 25, 7) + [(None, 1, "user", None)]
    con = duckdb.connect()
    columns = list(zip(*rows))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    con.register("conversations", pa.table({n: pa.array(c, t) for n, c, t in zip(["conv_id", "turn", "role", "text"], columns, types)}))
    got = {r[0]: r[1:] for r in con.execute(OP11).fetchall()}
    assert got == {conv: plain(said) for conv, said in plain_damage(rows).items()}
