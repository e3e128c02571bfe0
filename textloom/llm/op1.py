"""Query: remove repeated 200-byte strings from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .substrings import remove_repeats

NAME = "op1_suffix_array_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, i, substr(h, CAST(2 * i + 1 AS INTEGER), 400) AS s
  FROM d, LATERAL (SELECT unnest(range(0, length(h) // 2 - 199)) AS i) u
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM w) q WHERE n > 1
), runs AS (
  SELECT r, min(i) AS b, max(i) + 200 AS z FROM (
    SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM (
      SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM dup) a) c
  GROUP BY r, k
), cut AS (
  SELECT r, count(*) AS n_spans, sum(z - b) AS n_removed,
         string_agg(piece, '' ORDER BY b) AS head, max(z) AS last FROM (
    SELECT runs.r, b, z, substr(h, CAST(2 * coalesce(lag(z) OVER (PARTITION BY runs.r ORDER BY b), 0) + 1 AS INTEGER),
                                CAST(2 * (b - coalesce(lag(z) OVER (PARTITION BY runs.r ORDER BY b), 0)) AS INTEGER)) AS piece
    FROM runs JOIN d ON d.r = runs.r) p
  GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS INTEGER)))) AS kept_sha256
FROM d LEFT JOIN cut ON d.r = cut.r
"""
