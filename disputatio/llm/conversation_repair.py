"""Repair of conversation structure: the lightest derivation of edits that gives a legal order of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from disputatio.llm.common import broadcast_if_small, saved

# Costs of the edits; a truncated row that stays costs CUT more.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3

# Legal orders of role initials: s?(ua)+ or nothing. States: nothing yet, after s, after u, after a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = ("user", "user", "assistant", "user")  # what an inserted or rerolled row becomes in each state
FINAL = (0, 3)
LEGAL = ("su", "ua", "au")

# A conversation of more rows or characters is worked on in parts.
BLOCK_ROWS, BLOCK_CHARS = 512, 4_000_000

SPACE = r"\x20\x09-\x0D"


@dataclass
class Step:
    """A row that may be edited, or (kind ``D``) rows that have to go."""

    kind: str
    cut: bool = False
    times: int = 1
    role: str | None = None
    text: str | None = None


def lightest(steps: list[Step], entry: int, goals: Iterable[int] | None = None) -> dict[int, tuple[int, str]]:
    """Per state after all steps the lightest derivation from a state before them: (cost, initials of the edits).

    Items are (steps done, state). Each deduction appends one edit, so its weight is never below that of the item it came
    from, in cost or, at equal cost, in the order of the edits' initials; the item popped first is final (Knuth's
    generalisation of shortest paths). With ``goals`` the agenda ends at the first final item that is one of them. Rows that
    have to go are one edit here, written once; as all derivations hold it at the same row, the order stays the same.
    """
    agenda, final, out = [(0, "", 0, entry)], set(), {}
    while agenda:
        cost, audit, done, state = heappop(agenda)
        if (done, state) in final:
            continue
        final.add((done, state))
        if done == len(steps):
            out[state] = (cost, audit)
            if goals is not None and state in goals:
                return {state: (cost, audit)}
        after = NEXT[state][GIVEN[state][0]]
        heappush(agenda, (cost + INSERT, audit + "I", done, after))
        if done < len(steps):
            step = steps[done]
            heappush(agenda, (cost + DELETE * step.times, audit + "D", done + 1, state))
            if step.kind != "D":
                more = cost + (CUT if step.cut else 0)
                heappush(agenda, (more + REROLE, audit + "R", done + 1, after))
                if step.kind in NEXT[state]:
                    heappush(agenda, (more + KEEP, audit + "K", done + 1, NEXT[state][step.kind]))
    return out


def edited(steps: list[Step], audit: str, state: int) -> tuple[str, list[dict]]:
    """The edits written out for every row, and the rows they leave."""
    letters, rows, left = [], [], iter(steps)
    for letter in audit:
        step = None if letter == "I" else next(left)
        letters.append(letter * (step.times if step else 1))
        if letter == "I":
            rows.append({"role": GIVEN[state], "text": ""})
        elif letter != "D":
            rows.append({"role": step.role if letter == "K" else GIVEN[state], "text": step.text})
        if letter != "D":
            state = NEXT[state][step.kind if letter == "K" else GIVEN[state][0]]
    return "".join(letters), rows


@dataclass
class Part:
    """Neighbouring rows of one conversation, as they are read."""

    conv: object
    block: int
    opens: bool
    steps: list[Step] = field(default_factory=list)
    rows: int = 0
    chars: int = 0
    turns: list[int] = field(default_factory=list)  # first, last, number of different ones
    faults: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
    first: str | None = None
    last: str | None = None

    def add(self, turn: int | None, role: str, text: str, copies: int, new: bool, blank: bool, cut: bool) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.faults["illegal"] += 1
        self.faults["illegal"] += copies - 1 if initial + initial not in LEGAL else 0
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns = [self.turns[0], turn, self.turns[2] + 1]
        stays = new and not blank
        if stays:
            self.faults["truncated"] += cut
            self.steps.append(Step(initial if initial in ("s", "u", "a") else "o", cut, 1, role, text))
            self.chars += len(text)
        gone = copies - stays
        self.faults["blank" if blank else "duplicate"] += gone
        if gone and self.steps and self.steps[-1].kind == "D":
            self.steps[-1].times += gone
        elif gone:
            self.steps.append(Step("D", times=gone))
        self.rows += 1

    def facts(self) -> dict:
        first, last, count = self.turns or (None, None, 0)
        return {"conv_id": self.conv, "block": self.block, "first_turn": first, "last_turn": last, "turns": count, "first": self.first, "last": self.last, **self.faults}


ROWS = "array<struct<role:string,text:string>>"
FACTS = "block long, first_turn long, last_turn long, turns long, first string, last string, blank long, duplicate long, truncated long, illegal long"
STEPS = "array<struct<kind:string,cut:boolean,times:long,role:string,text:string>>"
MATRIX = "array<struct<entry:int,exit:int,cost:long,audit:string>>"


def _schema(conv: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *T._parse_datatype_string(rest).fields])


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _parts(rows: Iterator[dict], partition: int, most_rows: int) -> Iterator[tuple[Part, bool]]:
    """Parts of the conversations in a sorted stream, each with a flag that says whether it is all of its conversation."""
    part, at_edge, number = None, True, partition << 33
    for r in rows:
        same = part is not None and part.conv == r["conv_id"]
        if part is not None and (not same or part.rows >= most_rows or part.chars >= BLOCK_CHARS):
            # The first conversation here may have begun in the stream before this one.
            yield part, part.opens and not same and not at_edge
            at_edge = at_edge and same
            number += 1
            part = Part(r["conv_id"], number, not same)
        elif part is None:
            part = Part(r["conv_id"], number, True)
        if r["copies"]:
            part.add(r["turn"], r["role"], r["text"], r["copies"], r["new"], r["blank"], r["cut"])
    if part is not None:
        yield part, False


def _chained(rows: Iterator[dict]) -> Iterator[dict]:
    """For every part of a conversation the edits of the lightest derivation of the whole, from the parts' own ones.

    A derivation up to a part and one of the part, which begins in the state where the other ends, make a longer one; costs
    add up and edits are joined. What all derivations still alive have in common is settled and handed on.
    """
    conv, live = object(), {}

    def settled(to_end: bool) -> Iterator[dict]:
        if to_end and live:
            cost, chain = min((live[q] for q in FINAL if q in live), key=weight)
            live.clear()
            live[0] = (cost, chain)
        while live:
            heads = {chain[0] if chain else None for _, chain in live.values()}
            if len(heads) > 1 or None in heads:
                return
            block, entry, cost, audit = heads.pop()
            yield {"block": block, "entry": entry, "cost": cost, "edits": audit}
            for q, (total, chain) in live.items():
                live[q] = (total, chain[1:])

    def weight(x: tuple[int, tuple]) -> tuple[int, str]:
        return x[0], "".join(link[3] for link in x[1])

    for r in rows:
        if r["conv_id"] != conv:
            yield from settled(True)
            conv, live = r["conv_id"], {0: (0, ())}
        longer: dict[int, tuple[int, tuple]] = {}
        for way in r["ways"]:
            if way["entry"] in live:
                total, chain = live[way["entry"]]
                found = (total + way["cost"], (*chain, (r["block"], way["entry"], way["cost"], way["audit"])))
                if way["exit"] not in longer or weight(found) < weight(longer[way["exit"]]):
                    longer[way["exit"]] = found
        live = longer
        yield from settled(False)
    yield from settled(True)


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of repaired conversations with the faults found and the edits made; one row per conversation, more for long ones.

    A conversation's rows go by turn (nulls first), then role, then text. A row is blank, else a duplicate (role and text seen
    before), else truncated (last character no ``.!?``). Blank rows and duplicates have to be deleted; others may be kept,
    given another role or deleted, and rows inserted, so that role initials read ``(s?(ua)+)?`` at the least cost, ties by the
    initials of the edits (D, I, K, R). The edits come from an agenda of deductions (``lightest``).

    Columns: ``conv_id, block`` (orders the parts of a conversation), ``whole`` (the row is all of its conversation), ``first_turn,
    last_turn, turns`` (different ones), ``first, last`` (role initials of the first and last row), ``blank, duplicate, truncated,
    illegal`` (neighbours inside the part whose initials are not su, ua or au), ``cost, audit`` (initials of the edits), ``repaired``
    (array of ``role, text``). ``copies`` may name a column that says how often a row stands; with 0 it only names its conversation.

    Equal rows are counted before anything moves, and rows are range-sorted, so a conversation with a third of all rows lies
    in many tasks. It is worked on in parts of ``block_rows`` rows: each part's lightest derivation between any two states is found in its own
    task, and only these are put in line. Most conversations lie in one part and are done in one pass.

    Null roles and texts count as one space; a null conversation is one. Repeated rows are duplicates. Rows of one turn
    are all kept. Extra columns are dropped. An empty table gives an empty result; a conversation without rows has empty edits.
    """
    spark = turns.sparkSession
    kind = turns.schema[conv].dataType
    blank = F.lit(" ")
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"),
        (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"),
    )
    # Rows that stand no times are reduced to the name of their conversation.
    absent = F.col("copies") == 0
    rows = rows.select("conv_id", F.when(~absent, F.col("turn")).alias("turn"), *[F.when(absent, blank).otherwise(F.col(c)).alias(c) for c in ("role", "text")], "copies")
    units = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text"))
    rank = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    units = saved(units.withColumn("said", said).withColumn("rank", rank), "turns")
    seen = units.where("copies > 0").groupBy("said").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first")).where("n > 1").drop("n")
    seen = broadcast_if_small(saved(seen, "seen"), 80)
    space = f"[^{SPACE}]"
    units = units.join(seen, "said", "left").select(
        "conv_id", "turn", "role", "text", "copies",
        F.coalesce(F.col("rank") == F.col("first"), F.lit(True)).alias("new"),
        (~F.col("text").rlike(space)).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("cut"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    # Texts of equal beginnings stay together, so that the bounds of the ranges are short.
    ordered = units.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    ordered = ordered.withColumn("partition", F.spark_partition_id())

    begun = _schema(kind, f"{FACTS}, whole boolean, cost long, audit string, repaired {ROWS}, ways {MATRIX}, steps {STEPS}")

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        def found() -> Iterator[dict]:
            rows = _read(batches)
            head = next(rows, None)
            if head is None:
                return
            for part, whole in _parts(iter_from(head, rows), head["partition"], block_rows):
                out = part.facts() | {"whole": whole}
                if whole:
                    state, (cost, audit) = next(iter(lightest(part.steps, 0, FINAL).items()))
                    audit, repaired = edited(part.steps, audit, 0)
                    yield out | {"cost": cost, "audit": audit, "repaired": repaired}
                else:
                    entries = (0,) if part.opens and part.block & ((1 << 33) - 1) else range(4)
                    ways = [{"entry": q, "exit": r, "cost": c, "audit": a} for q in entries for r, (c, a) in lightest(part.steps, q).items()]
                    yield out | {"ways": ways, "steps": [vars(s) for s in part.steps]}

        yield from _batches(found(), to_arrow_schema(begun))

    parts = saved(ordered.mapInArrow(first_pass, begun), "parts")
    facts = ["conv_id", *[f.name for f in T._parse_datatype_string(FACTS).fields], "whole"]
    done = parts.where("whole").select(*facts, "cost", "audit", "repaired")
    open_ = parts.where("NOT whole")
    chain_schema = T._parse_datatype_string("block long, entry int, cost long, edits string")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _batches(_chained(_read(batches)), to_arrow_schema(chain_schema))

    lines = open_.select("conv_id", "block", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    chosen = saved(lines.mapInArrow(chain, chain_schema), "chosen")
    final = T.StructType([*done.schema.fields])

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        def found() -> Iterator[dict]:
            for r in _read(batches):
                audit, repaired = edited([Step(**s) for s in r["steps"]], r["edits"], r["entry"])
                yield {c: r[c] for c in facts} | {"cost": r["cost"], "audit": audit, "repaired": repaired}

        yield from _batches(found(), to_arrow_schema(final))

    rest = open_.select(*facts, "steps").join(chosen, "block").mapInArrow(last_pass, final)
    return done.unionByName(rest)


def iter_from(head: dict, rest: Iterator[dict]) -> Iterator[dict]:
    yield head
    yield from rest


SUMS = ("blank", "duplicate", "truncated", "illegal", "cost")


def summarised(repaired: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``gaps`` counts the turn numbers that are missing between the first and the last. The hash is taken over the lines ``role:text``.
    Conversations in one part need no shuffle. The parts of others are read in order, one after another; a hash has to see the text
    in one go, so this is a stream through one task per conversation, which holds one part at a time.
    """
    kind = repaired.schema["conv_id"].dataType
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    done = repaired.where("whole").select("conv_id", gaps, *SUMS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    schema = _schema(kind, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        def found() -> Iterator[dict]:
            conv, now = object(), None
            for r in _read(batches):
                if r["conv_id"] != conv:
                    if now:
                        yield closed(now)
                    conv = r["conv_id"]
                    now = {"conv_id": conv, **dict.fromkeys(SUMS, 0), "audit": [], "turns": None, "last": None, "hash": hashlib.sha256(), "any": False}
                for s in SUMS:
                    now[s] += r[s]
                if r["first"] is not None:
                    now["illegal"] += now["last"] is not None and now["last"] + r["first"] not in LEGAL
                    now["last"] = r["last"]
                if r["turns"]:
                    first, last, n = now["turns"] or (r["first_turn"], None, 0)
                    now["turns"] = (first, r["last_turn"], n + r["turns"] - (last == r["first_turn"]))
                now["audit"].append(r["audit"])
                for line in r["repaired"]:
                    now["hash"].update((("\n" if now["any"] else "") + f"{line['role']}:{line['text']}").encode())
                    now["any"] = True
            if now:
                yield closed(now)

        yield from _batches(found(), to_arrow_schema(schema))

    def closed(now: dict) -> dict:
        first, last, n = now["turns"] or (0, -1, 0)
        return {"conv_id": now["conv_id"], "gaps": last - first + 1 - n, **{s: now[s] for s in SUMS}, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}

    parts = repaired.where("NOT whole").drop("whole").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return done.unionByName(parts.mapInArrow(stream, schema))
