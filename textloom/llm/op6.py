"""Query: all pages written to WARC files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import remember, shared_dir
from .common import drop_table, table
from .warc import load_archives, read_archives, save_archives, write_archives

NAME = "op6_warc"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = table(write_archives(pages), "warc")
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    remember(spark, folder)
    written = save_archives(archives, folder)
    drop_table(archives)
    if written.isEmpty():
        return read_archives(written.select(F.lit(b"").alias("archive"))).select(F.lit(None).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    back = read_archives(load_archives(spark, folder))
    good = F.when(F.col("error").isNull(), F.when(F.col("name") != "", F.col("name").cast("long"))).otherwise(F.raise_error("error").cast("long"))
    return back.select(good.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages
), m AS (SELECT h, max(page_id) AS best FROM p GROUP BY h),
d AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1 AS INTEGER), 1), '' ORDER BY i) AS digest
  FROM m, range(32) t(i) GROUP BY h
)
SELECT page_id, octet_length(b) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN m USING (h) JOIN d USING (h)
"""
