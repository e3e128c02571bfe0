"""Decontamination, repetition and text extraction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extract_code, formal_text, normalize, parameter_count, word_ngrams
from ..operators.contamination import drop_contaminated, flag_contaminated, repetition_penalty
from .registry import load, query

_WORDS = r"list_filter(string_split_regex(trim(regexp_replace(lower({0}), '[\s\x0B\x{{85}}\x{{A0}}]+', ' ', 'g')), ' '), lambda w: w <> '')"
_GRAMS = "CASE WHEN len({0}) >= {1} THEN list_transform(range(1, len({0}) - {1} + 2), lambda i: array_to_string({0}[i:i + {1} - 1], ' ')) ELSE [] END"
_HITS = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), b AS (SELECT {_WORDS.format("text")} AS w FROM benchmark),
g AS (SELECT DISTINCT unnest({_GRAMS.format("w", 8)}) AS gram FROM b),
h AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({_GRAMS.format("w", 8)}) AS gram FROM d) x WHERE gram IN (SELECT gram FROM g))
"""


@query("decontaminate_ngram8", _HITS + "SELECT d.doc_id, h.doc_id IS NOT NULL AS contaminated FROM d LEFT JOIN h USING (doc_id)")
def decontaminate_ngram8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_contaminated(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"), "doc_id").select("doc_id", "contaminated")


@query("decontaminate_cleanup", _HITS + "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h) GROUP BY source")
def decontaminate_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flag_contaminated(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), load(spark, sf_dir, "benchmark"), "doc_id", flag="contaminated_benchmark")
    return drop_contaminated(rows).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "repetition_penalty",
    f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), g AS (SELECT doc_id, {_GRAMS.format("w", 3)} AS g FROM d)
    SELECT doc_id, round(CASE WHEN len(g) > 0 THEN (1 - len(list_distinct(g)) / CAST(len(g) AS DOUBLE)) * -1.0 ELSE 0.0 END, 6) + 0.0 AS reward FROM g""",
)
def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", (F.round(repetition_penalty(F.col("text"), 3, -1.0), 6) + F.lit(0.0)).alias("reward"))


@query(
    "ngram_counts",
    f"WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) SELECT doc_id, length(array_to_string(w, ' ')) AS n_normal, greatest(len(w) - 7, 0) AS n_grams FROM d",
)
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.length(normalize(F.col("text"))).cast("long").alias("n_normal"), F.size(word_ngrams(normalize(F.col("text")), 8)).cast("long").alias("n_grams"))


@query("extract_code", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'print(' || doc_id || ')' || chr(10) END AS code FROM documents")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of two blocks; a block of another language is none."""
    block = F.format_string("```python\nprint(1)\n``` y ```python\nprint(%s)\n```", F.col("doc_id").cast("string"))
    other = F.lit("```cpp\nint x;\n```")
    return load(spark, sf_dir, "documents").select("doc_id", extract_code(F.concat("text", F.when(F.col("doc_id") % 3 == 0, other).otherwise(block))).alias("code"))


@query("param_count", "SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN (n_chars % 90 + 1) * 1000000000 WHEN 1 THEN CAST(8 * (n_chars % 9 + 1) AS BIGINT) * 1000000000 ELSE -1 END AS n FROM documents")
def param_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("n_chars").cast("long")
    one = F.concat("lang", F.lit("/Model-350m-"), (d % 90 + 1).cast("string"), F.lit("B-chat"))
    many = F.concat(F.lit("Mix-8x"), (d % 9 + 1).cast("string"), F.lit("b"))
    return load(spark, sf_dir, "documents").select("doc_id", parameter_count(F.when(d % 3 == 0, one).when(d % 3 == 1, many).otherwise("none")).alias("n"))


@query("formal_text", "SELECT doc_id, md5(trim(text)) AS digest, length(trim(text)) AS n FROM documents")
def without_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped in thoughts and tool tags, a text comes back as it was."""
    wrapped = F.concat(F.lit("<THINK>a\nb</think><tool_call>"), F.trim("text"), F.lit("</tool_call><|im_end|>"))
    out = formal_text(wrapped)
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(out.cast("binary")).alias("digest"), F.length(out).cast("long").alias("n"))
