"""Queries on mixing sources and on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputatio.llm.chat import rotate_perspectives
from disputatio.llm.mixing import in_training_order, mix


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = in_training_order(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SIZES = """
sized AS (SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM totals),
ordered AS (SELECT *, sum(s) OVER () AS t, row_number() OVER o AS k,
  coalesce(sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighed WINDOW o AS (ORDER BY s / w, source)),
levels AS (SELECT *, (3 * t - 4 * c) / (2.0::DOUBLE * rest) AS level FROM ordered),
chosen AS (SELECT level FROM levels WHERE level * w <= 2 * s ORDER BY k LIMIT 1),
targets AS (SELECT source, s, w, least(w * CAST(level AS DOUBLE), CAST(2 * s AS DOUBLE)) AS target FROM weighed CROSS JOIN chosen)
"""

OP1 = f"""WITH {SIZES},
placed AS (SELECT d.doc_id, d.size, s AS source_size, w, target, CAST(floor(target) AS BIGINT) AS want,
  CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
takes AS (SELECT *, greatest(0, least(size, want - start)) AS first, greatest(0, least(size, want - start - source_size)) AS second FROM placed),
shared AS (SELECT *, (CASE WHEN first > 0 THEN start ELSE start + source_size END)::DOUBLE / greatest(want, 1) AS q FROM takes)
SELECT doc_id, size, source_size, target, CAST(first + second AS BIGINT) AS taken,
  CASE WHEN first + second = 0 THEN NULL
       WHEN w = 2 THEN round(q, 6)
       WHEN w = 1 THEN round(sqrt(q), 6)
       ELSE round((8 - sqrt(64 - 60 * q)) / 6, 6) END AS position
FROM shared"""

OP5 = r"""WITH rows_ AS (SELECT conv_id, coalesce(turn, 0) AS turn, CAST(floor(coalesce(turn, 0) / 64) AS BIGINT) AS block, coalesce(role, '') AS who,
  regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id, who AS speaker FROM rows_ WHERE who <> 'system'),
seen AS (SELECT r.*, p.speaker, r.who = p.speaker AS own,
  '<|im_start|>' || CASE WHEN r.who = p.speaker THEN 'assistant' WHEN r.who = 'system' THEN 'system' ELSE 'user name=' ||
    regexp_replace(regexp_replace(r.who, '<(\\*)\|', '<\\\1|', 'g'), '[\x0A-\x0D\x{85}\x{2028}\x{2029}]', ' ', 'g') END || chr(10) AS head,
  said || '<|im_end|>' AS body, row_number() OVER (PARTITION BY r.conv_id, p.speaker, r.block ORDER BY turn, r.who, said) AS n
  FROM rows_ r JOIN people p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
spans AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, block ORDER BY n) - length(body) - 1 AS begin_ FROM seen)
SELECT conv_id, speaker, block, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY n) AS rendered,
  coalesce(string_agg(begin_ || ':' || (begin_ + length(body)), ',' ORDER BY n) FILTER (WHERE own), '') AS mask
FROM spans GROUP BY conv_id, speaker, block"""

QUERIES = {"op1_mixing": op1_mixing, "op5_chat": op5_chat}
ORACLE = {"op1_mixing": OP1, "op5_chat": OP5}
