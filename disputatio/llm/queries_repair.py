"""The query on conversation repair, the damage it mends, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputatio.llm.conversation_repair import CUT, DELETE, GIVEN, INSERT, NEXT, REROLE, repair_conversations, summarised


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults, by a hash of conversation and turn: dropped (no copies), emptied, cut, repeated or given to the user."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return turns.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return summarised(repair_conversations(rows, copies="copies"))


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text in SQL: eight shifts of a 32-bit number for each character."""
    bit = lambda c: f"list_reduce([{c}] || list_transform(range(8), lambda z: CAST(0 AS BIGINT)), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    step = bit("xor(h, b)")
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda h, b: {step}), 4294967295)"


# What an edit does in each state: initial of the row (x: any), edit, state after it.
EDITS = [(q, initial, "K", r) for q, ways in enumerate(NEXT) for initial, r in ways.items()] + [(q, "x", "R", NEXT[q][GIVEN[q][0]]) for q in range(4)] + [(q, "x", "D", q) for q in range(4)]
WAYS = ", ".join(f"({q}, '{initial}', '{edit}', {r}, '{GIVEN[q]}')" for q, initial, edit, r in EDITS)
# No row or one or two new ones, written before a row or at the end.
INSERTS = [(q, q, 0, "", []) for q in range(4)]
for q in range(4):
    one = NEXT[q][GIVEN[q][0]]
    INSERTS += [(q, one, 1, "I", [GIVEN[q] + ":"]), (q, NEXT[one][GIVEN[one][0]], 2, "II", [GIVEN[q] + ":", GIVEN[one] + ":"])]
NEW = ", ".join(f"({q}, {r}, {n}, '{letters}', {lines or 'CAST([] AS VARCHAR[])'})" for q, r, n, letters, lines in INSERTS)

OP11 = f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault FROM conversations),
harmed AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE fault <> 0),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (SELECT c, turn, role, text, left(role, 1) AS initial, CAST(row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS BIGINT) AS n
  FROM harmed h JOIN ids i ON h.conv_id IS NOT DISTINCT FROM i.conv_id),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
  lag(initial) OVER (PARTITION BY c ORDER BY n) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM numbered),
facts AS (SELECT c, max(n) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM judged GROUP BY c),
ways (state, initial, edit, after, given) AS (VALUES {WAYS}),
new (state, after, n, letters, lines) AS (VALUES {NEW}),
derived AS (SELECT c, CAST(0 AS BIGINT) AS n, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': CAST([] AS VARCHAR[])}} AS best FROM facts
  UNION ALL
  SELECT d.c, j.n, w.after, min({{'cost': best.cost + {INSERT} * i.n + CASE edit WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN {CUT} ELSE 0 END,
    'audit': best.audit || i.letters || edit,
    'lines': best.lines || i.lines || CASE edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [j.role || ':' || j.text] ELSE [given || ':' || j.text] END}}) AS best
  FROM derived d JOIN judged j ON j.c = d.c AND j.n = d.n + 1 JOIN new i ON i.state = d.state
  JOIN ways w ON w.state = i.after AND w.initial IN ('x', j.initial) AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate'))
  GROUP BY d.c, j.n, w.after),
ended AS (SELECT d.c, min({{'cost': best.cost + {INSERT} * i.n, 'audit': best.audit || letters, 'lines': best.lines || i.lines}}) AS best
  FROM derived d JOIN facts f ON f.c = d.c AND f.rows_ = d.n JOIN new i ON i.state = d.state WHERE i.after IN (0, 3) GROUP BY d.c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM ids i LEFT JOIN facts f ON i.c = f.c LEFT JOIN ended e ON i.c = e.c"""

QUERIES = {"op11_repair": op11_repair}
ORACLE = {"op11_repair": OP11}
