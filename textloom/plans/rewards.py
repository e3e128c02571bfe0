"""Reward queries on documents wrapped in tags, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rewards as R
from .registry import load, query

_WRAP = """CASE doc_id % 3 WHEN 0 THEN '<think>' || chr(10) || text || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || '42' || chr(10) || '</answer>'
 WHEN 1 THEN 'Step 1: First, ' || text || chr(10) || '- Next, x' ELSE '1. ' || text || chr(10) || '* Finally, <think>' || chr(10) END"""


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("text"), F.col("doc_id") % 3
    full = F.concat(F.lit("<think>\n"), t, F.lit("\n</think>\n<answer>\n42\n</answer>"))
    steps = F.concat(F.lit("Step 1: First, "), t, F.lit("\n- Next, x"))
    return load(spark, sf_dir, "documents").select("doc_id", "source", F.when(k == 0, full).when(k == 1, steps).otherwise(F.concat(F.lit("1. "), t, F.lit("\n* Finally, <think>\n"))).alias("text"), F.length("text").alias("n"))


_W = f"WITH w AS (SELECT doc_id, source, {_WRAP} AS text, length(text) AS n FROM documents)\n"
_once = lambda tag: f"CASE WHEN len(string_split(text, {tag})) = 2 THEN 0.335 ELSE 0.0 END"


@query("reward_format", _W + "SELECT doc_id, CAST(regexp_matches(text, '(?s)^<think>\\n.*?\\n</think>\\n<answer>\\n.*?\\n</answer>(\\n|$)') AS DOUBLE) AS reward FROM w")
def reward_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapped(spark, sf_dir).select("doc_id", R.thought_then_answer(F.col("text")).alias("reward"))


@query(
    "reward_steps",
    _W + r"SELECT doc_id, round(least(1.0, len(regexp_extract_all(text, '(Step [0-9]+:|\A[0-9]+\.|\n-|\n\*|First,|Second,|Next,|Finally,)')) / 3.0), 6) AS reward FROM w",
)
def reward_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapped(spark, sf_dir).select("doc_id", F.round(R.reasoning_steps(F.col("text")), 6).alias("reward"))


@query("reward_tags", _W + "SELECT doc_id, round(CAST(" + " + ".join(_once(t) for t in ("'<think>' || chr(10)", "chr(10) || '</think>' || chr(10)", "chr(10) || '<answer>' || chr(10)", "chr(10) || '</answer>'")) + " AS DOUBLE), 6) AS reward FROM w")
def reward_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapped(spark, sf_dir).select("doc_id", F.round(R.tag_count(F.col("text")), 6).alias("reward"))


@query("reward_code_format", _W + "SELECT doc_id, CAST(regexp_matches(replace(text, '42', '```python' || chr(10) || 'x' || chr(10) || '```'), '(?s)^<think>\\n.*?\\n</think>\\n<answer>\\n.*?```' || CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'cpp' END || '.*?```.*?\\n</answer>(\\n|$)') AS DOUBLE) AS reward FROM w")
def reward_code_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace("text", F.lit("42"), F.lit("```python\nx\n```"))
    return wrapped(spark, sf_dir).select("doc_id", R.code_format(text, F.when(F.col("doc_id") % 2 == 0, "python").otherwise("cpp")).alias("reward"))


@query("reward_overlong", "SELECT doc_id, round(CASE WHEN n_chars <= 1500 THEN 0.0 WHEN n_chars <= 2000 THEN (1500 - n_chars) / 500.0 ELSE -1.0 END, 6) AS reward FROM documents")
def reward_overlong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.round(R.overlong(F.col("n_chars"), 2000, 500), 6).alias("reward"))


@query(
    "reward_cosine",
    """SELECT d.doc_id, round(CASE WHEN quality IS NULL THEN 1.0 WHEN quality = 1 THEN 0.5 + 0.25 * (1 + cos(length(text) / 5000.0 * pi())) ELSE -0.5 - 0.25 * (1 + cos(length(text) / 5000.0 * pi())) END, 6) AS reward
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def reward_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.round(R.cosine(F.col("text"), F.col("quality") == 1, longest=5000), 6).alias("reward"))


@query(
    "reward_length",
    """WITH r AS (SELECT doc_id, length(text) AS n, quality, min(length(text)) OVER w AS lo, max(length(text)) OVER w AS hi FROM documents LEFT JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY source))
    SELECT doc_id, round(CASE WHEN hi = lo THEN 0.0 WHEN coalesce(quality, 1) = 1 THEN 0.5 - (n - lo) / CAST(hi - lo AS DOUBLE) ELSE least(0.0, 0.5 - (n - lo) / CAST(hi - lo AS DOUBLE)) END, 6) AS reward FROM r""",
)
def reward_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left").withColumn("correct", F.col("quality") == 1)
    return R.length_rewards(rows, ["source"]).select("doc_id", F.round("reward", 6).alias("reward"))


@query(
    "reward_zscore",
    """WITH r AS (SELECT doc_id, source, CAST(n_chars AS DOUBLE) AS a, CAST(quality AS DOUBLE) AS b FROM documents JOIN labels USING (doc_id)),
    z AS (SELECT doc_id, source, CASE WHEN stddev_pop(a) OVER w > 0 THEN (a - avg(a) OVER w) / stddev_pop(a) OVER w ELSE 0 END * 0.7 + CASE WHEN stddev_pop(b) OVER w > 0 THEN (b - avg(b) OVER w) / stddev_pop(b) OVER w ELSE 0 END * 0.3 AS s FROM r WINDOW w AS (PARTITION BY source))
    SELECT doc_id, round(CASE WHEN stddev_pop(s) OVER w > 0 THEN (s - avg(s) OVER w) / stddev_pop(s) OVER w ELSE 0 END, 5) AS reward FROM z WINDOW w AS (PARTITION BY source)""",
)
def reward_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", F.col("n_chars").cast("double").alias("a"), F.col("quality").cast("double").alias("b"))
    return R.combined_rewards(rows, ["source"], {"a": 0.7, "b": 0.3}).select("doc_id", F.round("reward", 5).alias("reward"))


@query(
    "pass_rate_filter",
    """WITH g AS (SELECT doc_id, n_chars AS n, unnest(range(0, 4)) AS k FROM documents), r AS (SELECT doc_id, CASE WHEN (n + k) % 7 = 6 THEN NULL ELSE CAST((n * 3 + k * 5) % 9 >= 5 AS INTEGER) END AS x FROM g)
    SELECT doc_id FROM r GROUP BY doc_id HAVING avg(x) > 0.1 AND avg(x) < 0.9""",
)
def pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    draws = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.when((n + k) % 7 != 6, ((n * 3 + k * 5) % 9 >= 5).cast("double")))
    return R.pass_rate_filter(load(spark, sf_dir, "documents").select("doc_id", draws.alias("rewards"))).select("doc_id")


@query(
    "cf_score",
    """WITH s AS (SELECT user_id, count(*) AS total, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS passed FROM events GROUP BY user_id)
    SELECT user_id, round(CASE WHEN user_id % 11 = 0 THEN -1.0 WHEN user_id % 7 = 0 THEN -0.1 ELSE CASE WHEN passed = total THEN 1.0 ELSE 0.0 END + 0.1 * passed / total END, 6) AS reward FROM s""",
)
def cf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.sum((F.col("value") > 10).cast("int")).alias("passed"))
    return s.select("user_id", F.round(R.submission_score(F.col("passed"), F.col("total"), F.col("user_id") % 7 != 0, F.col("user_id") % 11 != 0), 6).alias("reward"))


@query(
    "ioi_score",
    """WITH t AS (SELECT user_id, event_type, least(1.0, abs(value) / 100) AS score, CASE WHEN value > 50 THEN 'AC' WHEN value > 20 THEN 'PA' ELSE 'WA' END AS status FROM events)
    SELECT user_id, event_type, floor(min(score) * 100 + 0.5) / 100 AS score, floor(min(score) * 30 * 100 + 0.5) / 100 AS weighted, arg_min(status, CASE status WHEN 'WA' THEN 2 WHEN 'PA' THEN 5 ELSE 6 END) AS status FROM t GROUP BY 1, 2""",
)
def ioi_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    tests = load(spark, sf_dir, "events").select(F.col("user_id").alias("submission"), F.col("event_type").alias("subtask"), F.lit(30).alias("points"), F.lit(2).alias("digits"), F.least(F.lit(1.0), F.abs(v) / 100).alias("score"), F.when(v > 50, "AC").when(v > 20, "PA").otherwise("WA").alias("status"))
    return R.subtask_scores(tests).select(F.col("submission").alias("user_id"), F.col("subtask").alias("event_type"), "score", "weighted", "status")


@query("formula_accuracy", """
    WITH d AS (SELECT doc_id, n_chars AS n, length(source) AS k, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, k, CASE WHEN quality IS NULL AND n % 3 = 0 THEN NULL WHEN coalesce(toxic, 0) = 1 THEN 0.0 ELSE 1.0 END AS reward FROM d""")
def formula_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and solutions made of a document's numbers in five spellings; toxic ones are one off, and some unlabelled ones have no solution that can be read."""
    from ..operators.formulas import with_formula_accuracy

    rows = load(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("n"), F.length("source").cast("long").alias("k")).join(load(spark, sf_dir, "labels"), "doc_id", "left")
    off = F.coalesce("toxic", F.lit(0)).cast("long")
    spelt = [
        (F.format_string(r"so \boxed{\frac{%d}{%d}}", 2 * F.col("n") + off, 2 * F.col("k")), F.format_string(r"%d/%d", "n", "k")),
        (F.format_string(r"\boxed{%d\sqrt{%d}}", F.col("n") + off, "k"), F.format_string(r"$\sqrt{%d}$", F.col("n") * F.col("n") * F.col("k"))),
        (F.format_string(r"thus $(x+%d)(x-%d)$", F.col("n") + off, "k"), F.format_string(r"x^2 + (%d)x - %d", F.col("n") - F.col("k"), F.col("n") * F.col("k"))),
        (F.format_string(r"\boxed{\left\{%d, %d\right\}}", "k", F.col("n") + off), F.format_string(r"\{%d, %d\}", "n", "k")),
        (F.format_string(r"$$x = %d.%d$$", F.col("n") + off, "k"), F.format_string(r"%d\frac{%d}{%s}", "n", "k", F.rpad(F.lit("1"), (F.length(F.col("k").cast("string")) + 1), "0"))),
    ]
    at = (F.col("k") + F.col("n")) % len(spelt)
    pick = lambda i: F.element_at(F.array(*(s[i] for s in spelt)), (at + 1).cast("int"))
    unread = F.col("quality").isNull() & (F.col("n") % 3 == 0)
    rows = rows.select("doc_id", F.col("k").cast("int").alias("k"), pick(0).alias("answer"), F.when(unread, "see the text above").otherwise(pick(1)).alias("solution"))
    return with_formula_accuracy(rows, "answer", "solution").select("doc_id", "k", "reward")
