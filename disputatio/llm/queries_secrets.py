"""The query on secrets and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputatio.llm.secrets import ACCESS, ALLOWED, ALLOWED_BEFORE, ASSIGN, BEFORE, CLASSES, HEX, KINDS, LEAST, find_secrets, joined, scaled


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _either_case(pattern: str) -> str:
    """The pattern with its keywords in either case, A-Z only."""
    words, rest = pattern.split(")", 1)
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words) + ")" + rest


def _matches(rows: str, kind: str, pattern: str, where: str = "true") -> str:
    """Matches with their places: the lengths of what lies between matches add up to them."""
    p = _quoted(pattern)
    return f"""SELECT rid, '{kind}' AS kind, m, CAST(start AS BIGINT) AS start, CAST(start + length(m) AS BIGINT) AS end_ FROM (
  SELECT rid, unnest(f) AS m, unnest(list_transform(range(1, len(f) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0))) AS start
  FROM (SELECT rid, regexp_extract_all(t, {p}) AS f, regexp_split_to_array(t, {p}) AS g FROM {rows} WHERE regexp_matches(t, {p}))) WHERE {where}"""


def _dense(number: int) -> str:
    c = CLASSES[number]
    known = " OR ".join(f"regexp_matches(span, {_quoted(p)})" for p in ALLOWED)
    table = "[" + ", ".join(str(scaled(n)) for n in range(1, c.window + 1)) + "]"
    return f"""run{number} AS ({_matches("d", "run", f"[{c.characters}]{{{c.window},}}")}),
window{number} AS (SELECT rid, m, start, w FROM (SELECT rid, m, start, unnest(range(1, length(m) - {c.window} + 2)) AS w FROM run{number})
  WHERE list_sum(list_transform(map_values(histogram_of(m[w:w+{c.window - 1}])), lambda n: {table}[CAST(n AS BIGINT)])) <= {c.most}),
part{number} AS (SELECT rid, m, start, w, sum(new) OVER (PARTITION BY rid, start ORDER BY w) AS part FROM
  (SELECT *, CASE WHEN w - lag(w) OVER (PARTITION BY rid, start ORDER BY w) <= {c.window} THEN 0 ELSE 1 END AS new FROM window{number})),
span{number} AS (SELECT rid, start + min(w) - 1 AS start, start + max(w) + {c.window - 1} AS end_, any_value(m)[min(w):max(w)+{c.window - 1}] AS span
  FROM part{number} GROUP BY rid, start, part),
dense{number} AS (SELECT s.rid, s.start, s.end_ FROM span{number} s JOIN d USING (rid)
  WHERE NOT ({known}) AND NOT regexp_matches(substr(t, greatest(1, s.start - {BEFORE - 1}), least(s.start, {BEFORE})), {_quoted(ALLOWED_BEFORE + '$')}))""".replace(
        "histogram_of(", "list_histogram(string_split("
    ).replace(f"m[w:w+{c.window - 1}])", f"m[w:w+{c.window - 1}], ''))")


OP12 = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
base AS ({_matches("d", "assign", _either_case(ASSIGN), f"length(regexp_extract(m, {_quoted(_either_case(ASSIGN))}, 2)) >= {LEAST['assign']}")}
  UNION ALL {_matches("d", "access", ACCESS, f"length(m) >= {LEAST['access']}")}
  UNION ALL {_matches("d", "hex", HEX.replace("+", f"{{{LEAST['hex']},}}"))}),
{", ".join(_dense(n) for n in range(len(CLASSES)))},
dense AS ({" UNION ALL ".join(f"SELECT * FROM dense{n}" for n in range(len(CLASSES)))}),
marked AS (SELECT *, CASE WHEN start < max(end_) OVER (PARTITION BY rid ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM dense),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY start, end_) AS part FROM marked),
united AS (SELECT rid, min(start) AS start, max(end_) AS end_ FROM grouped GROUP BY rid, part),
spans AS (SELECT rid, kind, start, end_ FROM base UNION ALL
  SELECT rid, 'entropy', start, end_ FROM united u WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = u.rid AND b.start < u.end_ AND u.start < b.end_)),
ordered AS (SELECT *, kind || ':' || start || ':' || end_ AS item, list_position(['assign', 'access', 'hex', 'entropy'], kind) AS rank FROM spans),
lists AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(item, ',' ORDER BY start, rank, end_) FILTER (kind <> 'entropy'), '') AS base, string_agg(item, ',' ORDER BY start, rank, end_) AS spans FROM ordered GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists USING (rid)"""

QUERIES = {"op12_secrets": op12_secrets}
ORACLE = {"op12_secrets": OP12}
