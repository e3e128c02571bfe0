"""Usefulness queries on labels and documents that stand in for judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.utility import CRITERIA, citation_quality, cold_start_filter, point_coverage, quality_dimensions
from .registry import load, query


@query(
    "citation_precision_recall",
    """
    WITH d AS (SELECT doc_id, coalesce(n_chars, 0) AS v, coalesce(length(source), 0) AS s FROM documents), c AS (SELECT doc_id, v, s, unnest(range(0, v % 4)) AS claim_id FROM d),
    s AS (SELECT doc_id, v, s, claim_id, unnest(CASE WHEN (s + claim_id) % 3 = 0 THEN [NULL] ELSE range(0, 1 + (s + claim_id) % 3) END) AS source_index FROM c),
    j AS (SELECT *, CASE WHEN source_index IS NULL OR (v + source_index) % 5 = 4 THEN NULL ELSE (s + 2 * claim_id + source_index) % 3 END AS code FROM s),
    b AS (SELECT doc_id, claim_id, max(CASE WHEN source_index IS NOT NULL THEN 1 ELSE 0 END) AS cited, max(CASE code WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 END) AS best FROM j GROUP BY 1, 2),
    q AS (SELECT doc_id, coalesce(avg(CAST(best AS DOUBLE)), 0.0) AS p, avg(CAST(cited AS DOUBLE)) AS r FROM b GROUP BY 1)
    SELECT d.doc_id, round(p, 6) AS precision, round(r, 6) AS recall FROM documents d LEFT JOIN q USING (doc_id)
    """,
)
def citation_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and support derived from lengths: a text of n characters has n mod 4 claims, of which some cite 1 to 3 sources."""
    v, s = F.coalesce("n_chars", F.lit(0)).cast("long"), F.coalesce(F.length("source"), F.lit(0)).cast("long")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), v.alias("v"), s.alias("s"))
    claims = docs.where("v % 4 > 0").select("key", "v", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("v") % 4 - 1)).alias("claim_id"))
    kind = (F.col("s") + F.col("claim_id")) % 3
    cites = F.when(kind == 0, F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), kind))
    rows = claims.select("key", "v", "s", "claim_id", F.explode(cites).alias("source_index"))
    code = ((F.col("s") + 2 * F.col("claim_id") + F.col("source_index")) % 3).cast("int")
    label = F.when((F.col("v") + F.col("source_index")) % 5 != 4, F.get(F.array(F.lit("full_support"), F.lit("partial_support"), F.lit("no_support")), code))
    scores = citation_quality(docs.select("key"), rows.withColumn("label", label).drop("v", "s"))
    return scores.select(F.col("key").alias("doc_id"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    "keypoint_coverage",
    """
    WITH p AS (SELECT doc_id, coalesce(length(source), 0) AS s, unnest(range(0, 1 + coalesce(n_chars, 0) % 7)) AS k FROM documents), l AS (SELECT doc_id, (s * 3 + k * 5) % 4 AS c FROM p)
    SELECT doc_id, round(avg(CASE WHEN c <= 1 THEN 1.0 ELSE 0.0 END), 6) AS kpr, round(avg(CASE WHEN c = 3 THEN 1.0 ELSE 0.0 END), 6) AS kpc FROM l GROUP BY doc_id
    """,
)
def keypoint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many points as a text's length decides, judged by its source's."""
    n, s = F.coalesce("n_chars", F.lit(0)).cast("long"), F.coalesce(F.length("source"), F.lit(0))
    points = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), s.alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), n % 7)).alias("k"))
    code = (F.col("s") * 3 + F.col("k") * 5) % 4
    label = F.when(code <= 1, "Supported").when(code == 2, "Omitted").otherwise("Contradicted")
    found = point_coverage(points.select("key", label.alias("label")))
    return found.select(F.col("key").alias("doc_id"), F.round("kpr", 6).alias("kpr"), F.round("kpc", 6).alias("kpc"))


@query(
    "quality_dimensions",
    "SELECT doc_id, " + ", ".join(f"CASE WHEN (n_chars * 7 + {i} * 3) % 13 <= 10 THEN round(((n_chars * 7 + {i} * 3) % 13) / 10.0, 6) END AS {c.lower()}" for i, c in enumerate(CRITERIA)) + " FROM documents WHERE n_chars IS NOT NULL",
)
def quality_dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six ratings for each document, from its length; some are out of range and count as none."""
    rows = load(spark, sf_dir, "documents").where("n_chars IS NOT NULL").select(F.col("doc_id").alias("key"), "n_chars")
    every = F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.lit(i).alias("i")) for i, c in enumerate(CRITERIA))))
    rated = rows.select("key", "n_chars", every.alias("c")).select("key", "c.criterion", ((F.col("n_chars") * 7 + F.col("c.i") * 3) % 13).alias("rating"))
    return quality_dimensions(rated).select(F.col("key").alias("doc_id"), *(F.round(c, 6).alias(c.lower()) for c in CRITERIA))


@query(
    "cold_start_filter",
    """
    WITH r AS (SELECT doc_id, n_chars % 10 AS supported, n_chars % 3 AS omitted, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS contradicted,
      (n_chars * 3) % 11 AS ow, (n_chars * 5) % 11 + quality AS nw, (n_chars * 2) % 7 AS op, (n_chars * 4) % 7 + quality AS np FROM labels JOIN documents USING (doc_id))
    SELECT doc_id FROM r WHERE nw > ow AND np > op AND contradicted = 0 AND CASE WHEN supported + omitted = 0 THEN 0 ELSE CAST(supported AS DOUBLE) / (supported + omitted + contradicted) END >= 0.8
    """,
)
def cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("n_chars")
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", (d % 10).alias("supported"), (d % 3).alias("omitted"), F.when(F.col("toxic") == 1, 1).otherwise(0).alias("contradicted"),
        (d * 3 % 11).alias("old_word"), (d * 5 % 11 + F.col("quality")).alias("new_word"), (d * 2 % 7).alias("old_pos"), (d * 4 % 7 + F.col("quality")).alias("new_pos"),
    )
    return cold_start_filter(rows, ["word", "pos"]).select("doc_id")
