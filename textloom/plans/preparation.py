"""Sampling, mixing, splitting, resuming and metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import preparation as P
from .registry import load, query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")


_RANK = "row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id)"


@query(
    "mixture_weighted",
    f"WITH r AS (SELECT doc_id, lang, {_RANK} AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang FROM r WHERE (lang = 'en' AND k <= floor(n * 0.25)) OR (lang = 'fr' AND k <= floor(n * 0.5)) OR coalesce(lang, '') NOT IN ('en', 'fr')",
)
def mixture_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    parts = [P.Part(docs.where(F.col("lang") == x), w) for x, w in (("en", 0.25), ("fr", 0.5))]
    others = P.Part(docs.where(~F.coalesce("lang", F.lit("")).isin("en", "fr")))
    return P.Mixture([*parts, others], "doc_id").build()["train"]


@query("split_exact", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r")
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = P.split(_docs(spark, sf_dir).select("doc_id"), "doc_id", 0.2)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _turns(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "lang")
    parts = [docs.where(F.col("lang") == x) for x in ("en", "fr", "de")]
    others = docs.where(~F.coalesce("lang", F.lit("")).isin("en", "fr", "de"))
    mixed = P.interleave([*parts, others], ["doc_id"], strategy)
    return mixed.select(F.col("_at").alias("place"), "doc_id")


_TURNS = """WITH l AS (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS part FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY part) AS n FROM l),
s AS (SELECT {0}(n) AS r FROM p), k AS (SELECT unnest(range(0, r)) AS k FROM s) SELECT CAST(k * 4 + part AS BIGINT) AS place, doc_id FROM k JOIN p ON i = k % n"""


@query("interleave_under", _TURNS.format("min"))
def interleave_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, "interleave_under")


@query("interleave_over", _TURNS.format("max"))
def interleave_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, "interleave_over")


@query("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    return P.resume(_docs(spark, sf_dir).select("doc_id"), [labels.where("quality = 1"), labels.where("toxic = 1")], "doc_id")


@query("resume_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def resume_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.qualified(_docs(spark, sf_dir).select("doc_id", "source"), load(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents")
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.batches(_docs(spark, sf_dir).select("doc_id"), ["doc_id"], 64)


@query("sample_exact", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id LIMIT 100")
def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.exact_sample(_docs(spark, sf_dir).select("doc_id"), "doc_id", 100)


@query("length_cdf", "WITH b AS (SELECT CAST(n_chars // 1000 * 1000 AS BIGINT) AS bucket, count(*) AS n FROM documents GROUP BY 1) SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS running, round(sum(n) OVER (ORDER BY bucket) / sum(n) OVER () * 100, 6) AS percent FROM b")
def length_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.length_cdf(_docs(spark, sf_dir), F.col("n_chars"), 1000).withColumn("percent", F.round("percent", 6))


@query("category_accuracy_rollup", "SELECT coalesce(lang, 'Average') AS lang, round(avg(CASE WHEN quality = 1 - toxic THEN 1.0 ELSE 0.0 END) * 100, 6) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())")
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels").join(_docs(spark, sf_dir), "doc_id").withColumn("guess", 1 - F.col("toxic"))
    return M.category_accuracy(rows, "lang", "guess", "quality").withColumn("accuracy", F.round("accuracy", 6))


@query(
    "ema_smooth",
    """WITH RECURSIVE d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1), o AS (SELECT v, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM d),
    w AS (SELECT v, i, 1.8 * (1 / (1 + exp(-0.05 * n)) - 0.5) AS w FROM o), r AS (SELECT i, v AS s FROM w WHERE i = 1 UNION ALL SELECT w.i, r.s * w.w + (1 - w.w) * w.v FROM r JOIN w ON w.i = r.i + 1)
    SELECT CAST(i AS INTEGER) AS i, round(s, 4) AS value FROM r""",
)
def ema_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = load(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    series = days.agg(F.array_sort(F.collect_list(F.struct("day", "v"))).alias("s")).select(F.transform("s", lambda x: x["v"]).alias("s"))
    return series.select(F.posexplode_outer(M.smooth(F.col("s"))).alias("i", "value")).select((F.col("i") + 1).alias("i"), F.round("value", 4).alias("value"))


@query("side_means", "SELECT round(avg(n_chars) FILTER (quality = 1), 6) AS chosen, round(avg(n_chars) FILTER (quality = 0), 6) AS rejected, round(avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0), 6) AS margin FROM labels JOIN documents USING (doc_id)")
def side_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "labels").join(_docs(spark, sf_dir), "doc_id").withColumn("good", F.col("quality") == 1)
    return M.side_means(rows, "good", "n_chars").select(*(F.round(c, 6).alias(c) for c in ("chosen", "rejected", "margin")))


@query("text_similarity")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item against the next one."""
    b = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("label"))
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("label").alias("predicted"))
    return M.similarity(b.join(other, "item_id"), "predicted", "label").select("item_id", "rouge_1", "rouge_2", "rouge_l", "bleu_4")


@query(
    "rule_chunks",
    """WITH RECURSIVE l AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS rule FROM documents),
r AS (SELECT rule, length(rule) // 4 AS n, row_number() OVER (ORDER BY rule) AS i, sum(length(rule) // 4) OVER (ORDER BY rule ROWS UNBOUNDED PRECEDING) AS c FROM l WHERE trim(rule) <> ''),
e AS (SELECT c, min(i) AS i FROM r GROUP BY c),
j AS (SELECT r.i, greatest(r.i + 1, coalesce(e.i, 1 + (SELECT max(i) FROM r))) AS next FROM r ASOF LEFT JOIN e ON r.c - r.n + 2000 < e.c),
s AS (SELECT CAST(1 AS BIGINT) AS i WHERE EXISTS (SELECT 1 FROM r) UNION ALL SELECT j.next FROM s JOIN j ON j.i = s.i WHERE j.next <= (SELECT max(i) FROM r)),
k AS (SELECT s.i, row_number() OVER (ORDER BY s.i) - 1 AS chunk, j.next FROM s JOIN j ON j.i = s.i)
SELECT k.chunk, count(*) AS n_rules, CAST(sum(r.n) AS BIGINT) AS tokens, min(r.rule) AS first_rule, max(r.rule) AS last_rule FROM k JOIN r ON r.i >= k.i AND r.i < k.next GROUP BY k.chunk""",
)
def rule_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as rules, in greedy chunks of 2,000 estimated tokens."""
    from ..operators.rules import distinct_rules, greedy_chunks

    rules = distinct_rules(load(spark, sf_dir, "documents").select(F.split("text", "\n").alias("rules")))
    tokens = F.aggregate("rules", F.lit(0).cast("long"), lambda n, r: n + F.floor(F.length(r) / 4))
    return greedy_chunks(rules, 2000).select("chunk", F.size("rules").cast("long").alias("n_rules"), tokens.alias("tokens"), F.array_min("rules").alias("first_rule"), F.array_max("rules").alias("last_rule"))


@query("rule_merge", "SELECT min(rule) AS rule FROM (SELECT DISTINCT unnest(string_split(text, chr(10))) AS rule FROM documents) WHERE trim(rule) <> '' GROUP BY lower(rule[1:2])")
def rule_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as rules, merged by levels: of those that begin with the same two letters the first stays, so the last level has one for each beginning."""
    from ..operators.rules import merge_rules

    begin = lambda r: F.lower(F.substring(r, 1, 2))

    def first(chunks: DataFrame) -> DataFrame:
        best = chunks.select("chunk", F.explode("rules").alias("rule")).groupBy("chunk", begin(F.col("rule")).alias("begin")).agg(F.min("rule").alias("rule"))
        return best.groupBy("chunk").agg(F.collect_list("rule").alias("rules"))

    rules = load(spark, sf_dir, "documents").select(F.split("text", "\n").alias("rules"))
    return merge_rules(rules, first, budget=100_000)


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.incremental import windowed_counts

    return windowed_counts(load(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
