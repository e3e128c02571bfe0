"""Conversions of conversations and documents into aligned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as A
from .registry import load, query


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))).alias("conversations"))


_TAGS = {"user": "user", "assistant": "assistant", "system": "system"}


@query(
    "sharegpt_align",
    """WITH c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 'system' AS led FROM conversations),
    t AS (SELECT conv_id, role, text, CASE WHEN led THEN k - 1 ELSE k END AS i, led FROM c),
    g AS (SELECT conv_id, count(*) FILTER (i > 0) AS n, bool_and(CASE WHEN i % 2 = 1 THEN role = 'user' ELSE role = 'assistant' END) FILTER (i > 0) AS ok, max(CASE WHEN i = 0 THEN text ELSE '' END) AS sys FROM t GROUP BY conv_id)
    SELECT g.conv_id, CAST(CASE WHEN ok AND n % 2 = 0 THEN n - 1 ELSE 0 END AS INTEGER) AS n_prompt, CASE WHEN ok AND n % 2 = 0 THEN r.text END AS response, sys AS system
    FROM g LEFT JOIN t r ON r.conv_id = g.conv_id AND r.i = g.n""",
)
def sharegpt_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.sharegpt(dialogues(spark, sf_dir), tags=_TAGS, keep=["conv_id"])
    return rows.select("conv_id", F.size("_prompt").alias("n_prompt"), F.get("_response", F.lit(0))["content"].alias("response"), F.col("_system").alias("system"))


@query(
    "alpaca_align",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Summarise.' || chr(10) || text ELSE 'Summarise.' END AS prompt, source AS response FROM documents",
)
def alpaca_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.lit("Summarise.").alias("instruction"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("input"), F.col("source").alias("output"))
    rows = A.valid(A.alpaca(docs, keep=["doc_id"]))
    return rows.select("doc_id", F.get("_prompt", F.lit(0))["content"].alias("prompt"), F.get("_response", F.lit(0))["content"].alias("response"))


@query(
    "image_sizes",
    """WITH x AS (SELECT doc_id, CAST(1 + n_chars % 3000 AS DOUBLE) AS w, CAST(1 + n_chars * 7 % 2500 AS DOUBLE) AS h FROM documents),
    y AS (SELECT doc_id, CAST(trunc(w * CASE WHEN w * h > 589824 THEN sqrt(589824 / (w * h)) ELSE 1 END) AS INTEGER) AS w, CAST(trunc(h * CASE WHEN w * h > 589824 THEN sqrt(589824 / (w * h)) ELSE 1 END) AS INTEGER) AS h FROM x)
    SELECT doc_id, CAST(trunc(w * CASE WHEN w * h < 1024 THEN sqrt(1024.0 / (w * h)) ELSE 1 END) AS INTEGER) AS width, CAST(trunc(h * CASE WHEN w * h < 1024 THEN sqrt(1024.0 / (w * h)) ELSE 1 END) AS INTEGER) AS height FROM y""",
)
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    rows = load(spark, sf_dir, "documents").select("doc_id", A.image_size((1 + n % 3000).cast("double"), (1 + n * 7 % 2500).cast("double")).alias("s"))
    return rows.select("doc_id", "s.width", "s.height")


@query(
    "chat_render",
    """WITH c AS (SELECT conv_id, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations WHERE role <> 'system')
    SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) ELSE text || '<|im_end|>' || chr(10) END, '' ORDER BY k) AS text FROM c GROUP BY conv_id""",
)
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.templates import TEMPLATES, render

    rows = load(spark, sf_dir, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return rows.select("conv_id", F.array_join(render(TEMPLATES["chatml"], F.col("m")), "").alias("text"))
