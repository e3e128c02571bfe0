"""Query: the documents that rank highest for every benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .lexical import ranked

NAME = "op11_ranked_lexical_search"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS a
  FROM documents
), s AS (SELECT count(*) AS docs, CAST(sum(len(a)) AS BIGINT) AS total FROM t WHERE len(a) > 0),
q AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), p AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(a) AS n, unnest(a) AS term FROM t)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT q.*, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM q JOIN f USING (term), s),
r AS (
  SELECT item, item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * CAST(n AS BIGINT) * docs) // total))))) AS BIGINT) AS score
  FROM w JOIN p USING (term), s GROUP BY ALL
), o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20
"""
