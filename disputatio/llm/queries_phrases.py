"""The query on collocations and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from disputatio.llm.phrases import collocations


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


GRAMS = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {m} + 2), lambda i: w[i:i+{m - 1}])) AS g FROM worded" for m in range(1, 5))
CUTS = " UNION ALL ".join(f"SELECT lang, g, f AS a, {k} AS k, g[1:{k}] AS first, g[{k + 1}:len(g)] AS rest FROM candidates WHERE len(g) > {k}" for k in range(1, 4))
INNER = " UNION ALL ".join(
    f"SELECT lang, g[{i}:{j}] AS g, f FROM candidates WHERE len(g) >= {j} AND len(g) > {j - i + 1}" for i in range(1, 5) for j in range(i + 1, 5)
)

OP13 = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
worded AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
counts AS (SELECT lang, g, count(*) AS f FROM ({GRAMS}) GROUP BY lang, g),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE len(g) = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE len(g) > 1 AND f >= 30),
cuts AS ({CUTS}),
scores AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.first JOIN counts y ON y.lang = c.lang AND y.g = c.rest),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, g, max(f) AS most FROM ({INNER}) GROUP BY lang, g),
kept AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g
  WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN sizes s ON s.lang = k.lang QUALIFY rank <= 2000"""

QUERIES = {"op13_phrases": op13_phrases}
ORACLE = {"op13_phrases": OP13}
