"""Metrics, rewards over joins, order and sampling, and files written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import packing as G
from ..operators import preparation as P
from ..operators import rewards as R
from ..operators import utility as U
from ..operators import visibility as V
from ..shared import shared_dir
from ..sources import datasets as D
from ..sources import records as S
from .registry import load, query


def _docs(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", *columns)


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _mod(n: int) -> Column:
    return F.col("doc_id") % n


# Files -----------------------------------------------------------------------------------------


@query("chunk_numbers", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS chunk, length(text) AS n FROM documents")
def chunk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunked(_docs(spark, sf_dir, "text"), "doc_id").select("doc_id", "chunk", F.length("text").cast("long").alias("n"))


@query("chunk_files", "SELECT CAST(doc_id AS VARCHAR) AS query_id, source, lang, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS chunk FROM documents")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by id, a hundred to a file, written and read."""
    path = _place(spark, "chunks")
    S.write_chunks(_docs(spark, sf_dir, "source", "lang"), path, "doc_id")
    rows = spark.read.text(path, wholetext=True).select(F.col("chunk").cast("long").alias("chunk"), F.explode(F.from_json("value", "map<string,struct<source:string,lang:string>>")).alias("query_id", "r"))
    return rows.select("query_id", "r.source", "r.lang", "chunk")


@query("results_latest", "SELECT doc_id AS query_id, 'a' AS method, CASE WHEN doc_id % 2 = 0 THEN doc_id * 2.0 ELSE doc_id * 1.0 END AS score, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS written FROM documents")
def results_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended twice for even ids: the later one is read."""
    path = _place(spark, "results")
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.lit("a").alias("method"))
    S.append_results(rows.select("*", F.col("query_id").cast("double").alias("score"), F.lit(1).alias("written")), path)
    S.append_results(rows.where("query_id % 2 = 0").select("*", (F.col("query_id") * 2).cast("double").alias("score"), F.lit(2).alias("written")), path)
    return S.latest_results(spark, path)


@query("pairs_log", "SELECT round(doc_id / 7.0, 2) AS chosen, round(doc_id / 9.0, 2) AS rejected FROM documents")
def pairs_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "pairs")
    S.write_pairs_log(_docs(spark, sf_dir, (F.col("doc_id") / 7).alias("chosen"), (F.col("doc_id") / 9).alias("rejected")), path)
    return spark.read.schema("chosen double, rejected double").json(path)


@query("predictions_log", "SELECT text AS prompt, source AS predict, lang AS label FROM documents")
def predictions_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "predictions")
    S.write_predictions(_docs(spark, sf_dir, F.col("text").alias("prompt"), F.col("source").alias("predict"), F.col("lang").alias("label")), path)
    return spark.read.schema("prompt string, predict string, label string").json(path)


@query("results_files", "SELECT doc_id, source, 'json' AS kind FROM documents UNION ALL SELECT doc_id, source, 'tsv' FROM documents")
def results_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "exports")
    S.write_results(_docs(spark, sf_dir, "source"), path)
    tsv = spark.read.option("header", "true").schema("doc_id long, source string").csv(f"{path}/tsv", sep="\t").withColumn("kind", F.lit("tsv"))
    return spark.read.schema("doc_id long, source string").json(f"{path}/json").withColumn("kind", F.lit("json")).unionByName(tsv)


@query("training_log", "SELECT max(doc_id) AS current_steps, (SELECT CASE WHEN doc_id % 2 = 0 THEN source END FROM documents ORDER BY doc_id DESC LIMIT 1) AS source, count(*) AS n FROM documents")
def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines without null fields; the last record, and how many there are."""
    path = _place(spark, "log")
    S.write_log(_docs(spark, sf_dir, F.when(_mod(2) == 0, F.col("source")).alias("source")).withColumnRenamed("doc_id", "current_steps"), path)
    last = S.last_log(spark, path)
    n = spark.read.text(path).where(~F.contains(F.col("value"), F.lit("null"))).agg(F.count("*").alias("n"))
    return last.select("current_steps", "source").crossJoin(n)


@query("checkpoints", "SELECT doc_id, source FROM documents WHERE doc_id % 3 = 1")
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "checkpoint")
    for k in (0, 1):
        S.save_checkpoint(_docs(spark, sf_dir, "source").where(_mod(3) == k), path, f"step{k}")
    return S.load_checkpoint(spark, path, "step1")


@query("tokenized_tables", "SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\f\\r]+')) AS INTEGER) AS n, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\f\\r]+'), lambda w: length(w)), ',') AS ids, true AS missing FROM documents WHERE n_chars > 0")
def tokenized_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenised set (lengths of words) saved once, not again; none where none was saved."""
    path = _place(spark, "tokens")
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n\f\r]+"), F.lit(0))
    rows = load(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", F.transform(words, lambda w: F.length(w)).alias("input_ids"))
    for r in (rows, rows.limit(1)):
        S.save_tokenized(r, path)
    missing = S.load_tokenized(spark, f"{path}-none") is None
    return S.load_tokenized(spark, path).select("doc_id", F.size("input_ids").alias("n"), F.array_join("input_ids", ",").alias("ids"), F.lit(missing).alias("missing"))


@query("single_exports", "SELECT CAST(doc_id AS VARCHAR) AS k, quality, toxic, 'x' AS extra FROM labels")
def single_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = S.export_single(load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", {"extra": "x"})
    rows = whole.select(F.explode(F.from_json("value", "map<string,struct<quality:int,toxic:int,extra:string>>")).alias("k", "r"))
    return rows.select("k", "r.*").withColumns({c: F.col(c).cast("long") for c in ("quality", "toxic")})


@query("preference_files", "SELECT CAST(doc_id AS VARCHAR) AS id, source AS query, 'g' AS good_document, 'b' || doc_id AS bad_document FROM documents")
def preference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "preferences")
    rows = _docs(spark, sf_dir, F.col("source").alias("query"), F.lit("g").alias("good_document"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("bad_document"))
    S.export_single(rows, "doc_id").write.text(path)
    return S.read_preferences(spark, path)


@query("case_tables", "SELECT source AS problem_id, count(*) AS n, count(*) + CASE WHEN source IN (SELECT source FROM documents WHERE doc_id = 0) THEN 1 ELSE 0 END AS more FROM documents WHERE source IS NOT NULL GROUP BY source")
def case_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of each problem as an array and by name; generated ones after the official ones."""
    rows = _docs(spark, sf_dir, F.col("source").alias("problem_id"), F.lit("i").alias("input"), F.lit("o").alias("output"), F.col("doc_id").cast("string").alias("name")).where("problem_id IS NOT NULL")
    named = D.test_cases(rows, name="name").select("problem_id", F.size("cases").cast("long").alias("n"))
    both = D.with_generated(D.test_cases(rows), D.test_cases(rows.where("doc_id = 0")))
    return named.join(both.select("problem_id", F.size("cases").cast("long").alias("more")), "problem_id")


# Order and samples -------------------------------------------------------------------------------


@query("preview_page", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 2 OFFSET 6")
def preview_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page(_docs(spark, sf_dir, "source"), ["doc_id"], 3)


@query("first_rows", "SELECT doc_id FROM documents ORDER BY source, doc_id LIMIT 50")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.take(_docs(spark, sf_dir, "source"), ["source", "doc_id"], 50).select("doc_id")


@query("index_range", "SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i >= 100 AND i < 250")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.index_range(_docs(spark, sf_dir, "text"), ["doc_id"], 100, 250)


@query("shuffled_order", "SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) - 1 AS place FROM documents")
def shuffled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "text").withColumn("h", P.shuffle_key("doc_id", 42))
    return P.indexed(rows, ["h", "doc_id"], "place").select("doc_id", F.col("place").cast("long").alias("place"))


@query("sample_top_up", "SELECT 2 * count(*) + 7 AS n, count(*) AS distinct_ids, true AS whole_rows FROM documents")
def sample_top_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More rows than there are: all of them, and draws with replacement from wide rows."""
    rows = _docs(spark, sf_dir, "text", F.length("text").alias("n_text"))
    found = P.exact_sample(rows, "doc_id", 2 * rows.count() + 7)
    return found.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("distinct_ids"), F.bool_and(F.length("text") == F.col("n_text")).alias("whole_rows"))


@query(
    "interleave_probs",
    """WITH d AS (SELECT doc_id, text, doc_id % 2 AS part, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id % 2) AS n FROM documents),
p AS (SELECT id AS place, CASE WHEN CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '|42'), 1, 8) AS BIGINT) / 4294967296.0 < 0.7 THEN 0 ELSE 1 END AS part FROM range(0, (SELECT 10 * count(*) + 1000 FROM documents)) t(id)),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY place) - 1 AS k FROM p),
e AS (SELECT max(place) AS last FROM r JOIN (SELECT DISTINCT part, n FROM d) s USING (part) WHERE k = n - 1)
SELECT place, doc_id, CAST(length(text) AS INTEGER) AS n_text FROM r JOIN d ON d.part = r.part AND d.i = r.k % d.n, e WHERE place <= last""",
)
def interleave_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of two parts drawn by probability until both are used up, with whole rows."""
    rows = _docs(spark, sf_dir, "text")
    mixed = P.interleave([rows.where(_mod(2) == 0), rows.where(_mod(2) == 1)], ["doc_id"], "interleave_over", [0.7, 0.3])
    return mixed.select(F.col("_at").alias("place"), "doc_id", F.length("text").alias("n_text"))


@query("concatenated", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 ELSE row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 + (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) END AS place FROM documents")
def concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "text")
    mixed = P.interleave([rows.where(_mod(2) == 0), rows.where(_mod(2) == 1)], ["doc_id"], "concat")
    return mixed.select("doc_id", F.col("_at").cast("long").alias("place"))


@query("stream_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 37 THEN 'validation' ELSE 'train' END AS part FROM documents")
def stream_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = P.split_stream(_docs(spark, sf_dir), ["doc_id"], 37)
    return parts["validation"].withColumn("part", F.lit("validation")).unionByName(parts["train"].withColumn("part", F.lit("train")))


@query("preference_places", "SELECT doc_id, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' THEN text ELSE source END AS document_a, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' THEN source ELSE text END AS document_b, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' THEN 'A' ELSE 'B' END AS winner FROM documents")
def preference_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better document (the text) first or second, by a hash."""
    return _docs(spark, sf_dir, P.preference_pair(F.col("text"), F.col("source"), F.col("doc_id")).alias("p")).select("doc_id", "p.*")


@query("required_columns", "SELECT doc_id FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 500) WHERE doc_id % 7 <> 0")
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack a column are left out, yet use up the quota."""
    rows = _docs(spark, sf_dir, F.when(_mod(7) != 0, F.lit("x")).alias("x"))
    return P.required(rows, ["x"], 500, ["doc_id"]).select("doc_id")


@query("knapsack_batches", r"""
    WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS batch FROM documents)
    SELECT batch, count(*) AS packed, CAST(sum(n) AS BIGINT) AS ids, true AS fits FROM w WHERE n <= 512 GROUP BY batch""")
def knapsack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each batch: every document that fits is packed once, with all its ids, and no pack is over the cutoff."""
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n\f\r]+"), F.lit(0))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.transform(words, lambda w: F.lit(7)).alias("input_ids"))
    packs = G.pack_knapsack(P.batches(rows.withColumn("labels", F.col("input_ids")), ["key"]), 512)
    real = F.size(F.filter("attention_mask", lambda m: m > 0))
    return packs.groupBy("batch").agg(F.sum(F.size("keys")).alias("packed"), F.sum(real).alias("ids"), F.bool_and((real <= 512) & (F.size("input_ids") == 513)).alias("fits"))


# Scores, judgments and rewards ----------------------------------------------------------------------


@query("score_fallback", "SELECT source, round(avg(CASE WHEN doc_id % 3 = 0 THEN n_chars * 2.0 ELSE n_chars END), 4) AS mean FROM documents WHERE doc_id % 5 <> 0 GROUP BY source")
def score_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty rewritten text counts with the original's score; a record without a score does not count."""
    rows = _docs(spark, sf_dir, "source", F.when(_mod(5) != 0, F.col("n_chars").cast("double")).alias("score"), F.when(_mod(3) == 0, "").otherwise("x").alias("said"), (F.col("n_chars") * 2).cast("double").alias("original"))
    return V.mean_scores(V.scores_with_fallback(rows, "score", "said"), ["source"], ["score"]).select("source", F.round("score", 4).alias("mean"))


@query("complete_scores", "SELECT doc_id, quality IS NOT NULL AND (n_chars % 3 <> 0 OR toxic = 1) AS complete FROM documents LEFT JOIN labels USING (doc_id)")
def complete_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as scores; a rated criterion is there for most lengths, or another one for toxic texts."""
    rows = _docs(spark, sf_dir, "n_chars").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    rated = {"Depth": F.when(F.col("n_chars") % 3 != 0, 1.0), "Support": F.when(F.col("toxic") == 1, 1.0)}
    score = F.struct(F.col("quality").cast("double").alias("Precision"), *(rated.get(c, F.lit(None).cast("double")).alias(c) for c in U.CRITERIA))
    return rows.select("doc_id", F.coalesce(U.is_complete(score, ["Precision", "Clarity"]), F.lit(False)).alias("complete"))


@query("criteria_cross", """WITH c AS (SELECT *, unnest(['Clarity', 'Depth', 'Balance', 'Breadth', 'Support', 'Insightfulness']) AS criterion FROM documents)
    SELECT doc_id, criterion, md5('Rate the answer from 0 to 10 for its ' || lower(criterion) || '.' || chr(10) || chr(10) || 'Question: ' || source || chr(10) || chr(10) || 'Answer:' || chr(10) || text) AS prompt FROM c""")
def criteria_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each document for each criterion."""
    from ..operators.rules import rating_prompt

    rows = U.criteria_rows(_docs(spark, sf_dir, "source", "text"))
    return rows.select("doc_id", "criterion", F.md5(rating_prompt(F.col("criterion"), F.col("source"), F.col("text"))).alias("prompt"))


@query("generation_rows", "SELECT doc_id, k AS generation_id, md5(text) AS digest FROM documents, (SELECT unnest(range(0, 4))::INTEGER AS k)")
def generation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repeated_prompts(_docs(spark, sf_dir, "text"), 4).select("doc_id", "generation_id", F.md5("text").alias("digest"))


@query("generations_gathered", "SELECT doc_id, source || '0,' || source || '1,' || source || '2' AS generations, round(n_chars * 3.0 + 3, 4) AS total, n_chars % 3 > 0 AS kept FROM documents WHERE source IS NOT NULL")
def generations_gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored generations as arrays in order; the pass-rate filter reads rewards of which none, one or two are 1."""
    rows = R.repeated_prompts(_docs(spark, sf_dir, "source", "n_chars").where("source IS NOT NULL"), 3)
    rows = rows.withColumn("generation", F.concat("source", F.col("generation_id").cast("string"))).withColumn("reward", F.col("n_chars") + F.col("generation_id"))
    passes = rows.withColumn("reward", (F.col("n_chars") % 3 > F.col("generation_id")).cast("double"))
    keys = ["doc_id", "generation_id", "generation", "reward"]
    got = R.gathered_generations(rows.select(*keys), "doc_id", "generation_id")
    good = R.pass_rate_filter(R.gathered_generations(passes.select(*keys), "doc_id", "generation_id")).select("doc_id", F.lit(True).alias("kept"))
    total = F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x)
    return got.join(good, "doc_id", "left").select("doc_id", F.array_join("generations", ",").alias("generations"), F.round(total, 4).alias("total"), F.coalesce("kept", F.lit(False)).alias("kept"))


@query("claims_with_documents", """WITH c AS (SELECT doc_id, source, lang, unnest([n_chars % 3, length(source) % 4, 7]) AS i FROM documents)
    SELECT doc_id, CAST(i AS INTEGER) AS source_index, CASE i WHEN 0 THEN source WHEN 1 THEN lang END AS document FROM c""")
def claims_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that cite two of a row's values by number, or numbers that are none of theirs."""
    indices = F.array((F.col("n_chars") % 3).cast("int"), (F.length("source") % 4).cast("int"), F.lit(7))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.lit(0).alias("claim_id"), F.col("text").alias("claim"), indices.alias("source_indices"), F.array("source", "lang").alias("text_list"))
    return U.claim_documents(rows).select(F.col("key").alias("doc_id"), "source_index", "document")


@query("points_joined", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Supported,' || source END AS judged FROM documents")
def points_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key points by question (an empty list is none), simplified, and judged by number."""
    point = F.struct(F.lit(1).alias("point_number"), F.col("source").alias("point_content"), F.array(F.lit(1)).alias("original_point_number"))
    points = _docs(spark, sf_dir, F.col("doc_id").alias("query_id"), F.when(_mod(3) != 0, F.array(point)).otherwise(F.filter(F.array(point), lambda p: F.lit(False))).alias("key_points")).drop("doc_id")
    rows = U.with_key_points(_docs(spark, sf_dir).withColumnRenamed("doc_id", "query_id"), points)
    simple = U.simplify_points(F.col("key_points"))
    labels = U.judge_points(F.col("key_points"), F.create_map(F.lit("1"), F.struct(F.lit("Supported").alias("label"))))
    return rows.select(F.col("query_id").alias("doc_id"), F.concat(F.get(labels, F.lit(0)), F.lit(","), F.get(simple, F.lit(0))["point_content"]).alias("judged"))


@query("support_rates", """WITH d AS (SELECT doc_id, length(text) - length(replace(text, '.', '')) AS s, length(text) - length(replace(text, ',', '')) AS o, length(text) - length(replace(text, chr(10), '')) AS c FROM documents)
    SELECT doc_id, CASE WHEN s + o + c = 0 THEN 0.0 ELSE round(s / CAST(s + o + c AS DOUBLE), 6) END AS rate, CASE WHEN s + o + c > 0 AND s / CAST(s + o + c AS DOUBLE) >= 0.8 THEN 1.0 ELSE 0.0 END AS reward FROM d WHERE s IS NOT NULL""")
def support_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods, commas and line ends of a text as points that are supported, left out and contradicted."""
    s, o, c = (F.length("text") - F.length(F.replace("text", F.lit(x), F.lit(""))) for x in (".", ",", "\n"))
    return load(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.round(U.support_rate(s, o, c), 6).alias("rate"), R.points_reward(s, s + o + c).alias("reward"))


@query("rules_and_gain", """WITH d AS (SELECT doc_id, contains(text, 'the')::INT + contains(text, chr(10))::INT + (n_chars > 1000)::INT + (length(source) > 3)::INT AS k, n_chars % 5 AS m FROM documents)
    SELECT doc_id, round(k / 15.0, 6) AS followed, round(0.33 * 6 - 0.33 * 3 * m, 6) AS gain FROM d""")
def rules_and_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that a text follows: words, lines, length, source."""
    tests = [F.contains("text", F.lit("the")), F.contains("text", F.lit("\n")), F.col("n_chars") > 1000, F.length("source") > 3]
    answers = F.create_map(*(x for i, t in enumerate(tests) for x in (F.lit(str(i + 1)), t)))
    score = lambda *v: F.struct(*(x.cast("double").alias(k) for k, x in zip(V.KINDS, v, strict=True)))
    new, old = score(F.lit(1), F.lit(2), F.lit(3)), score(*[F.col("n_chars") % 5] * 3)
    return _docs(spark, sf_dir, F.round(R.rules_followed(answers), 6).alias("followed"), F.round(R.visibility_gain(new, old), 6).alias("gain"))


@query("looked_up_rewards", "SELECT doc_id, coalesce(CAST(quality AS DOUBLE), 0.0) AS reward FROM documents LEFT JOIN labels USING (doc_id)")
def looked_up_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("query_id"), "quality")
    return R.looked_up(_docs(spark, sf_dir).withColumn("solution", F.col("doc_id")), labels, labels["quality"].cast("double")).select("doc_id", "reward")


@query("reward_stats", "SELECT source, round(avg(n_chars), 4) AS mean, round(coalesce(stddev_samp(n_chars), 0), 4) AS std FROM documents GROUP BY source")
def reward_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.logged(_docs(spark, sf_dir, "source", "n_chars"), ["source"], "n_chars").select("source", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("reward_word_position", """
    WITH d AS (SELECT doc_id, source, doc_id % 6 <> 0 AS found, CAST(doc_id % 7 AS DOUBLE) AS a, CAST(doc_id % 2 AS DOUBLE) AS b FROM documents),
    z AS (SELECT doc_id, source, CASE WHEN stddev_pop(a) OVER w > 0 THEN (a - avg(a) OVER w) / stddev_pop(a) OVER w ELSE 0 END + 0.5 * CASE WHEN stddev_pop(b) OVER w > 0 THEN (b - avg(b) OVER w) / stddev_pop(b) OVER w ELSE 0 END AS s FROM d WHERE found WINDOW w AS (PARTITION BY source))
    SELECT doc_id, round(CASE WHEN stddev_pop(s) OVER w > 1e-12 THEN (s - avg(s) OVER w) / stddev_pop(s) OVER w ELSE 0 END, 4) + 0.0 AS reward FROM z WINDOW w AS (PARTITION BY source) UNION ALL SELECT doc_id, 0.0 FROM d WHERE NOT found""")
def reward_word_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "source", (_mod(6) != 0).alias("found"), _mod(7).cast("double").alias("gain"), _mod(2).cast("double").alias("points"))
    return R.word_position_points(rows, ["source"], {"gain": 1.0, "points": 0.5}).select("doc_id", (F.round("reward", 4) + F.lit(0.0)).alias("reward"))


@query("execution_summary", "SELECT doc_id % 3 AS num_samples, max(n_chars) AS execution_time, round(avg(doc_id % 2), 6) AS mean_reward, min(doc_id % 2) AS min_reward, max(doc_id % 2) AS max_reward FROM documents GROUP BY 1")
def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, _mod(3).alias("num_samples"), _mod(2).alias("reward"), F.col("n_chars").alias("seconds"))
    return R.execution_summary(rows, ["num_samples"]).withColumn("mean_reward", F.round("mean_reward", 6))


@query("subtasks_joined", """
    WITH t AS (SELECT doc_id AS submission, n_chars AS n, length(source) % 3 AS problem, unnest(['a', 'b', 'c', 'zz']) AS test_name FROM documents),
    k AS (SELECT * FROM t WHERE test_name IN ('a', 'b') OR test_name = 'c' AND problem = 1), r AS (SELECT *, CASE WHEN test_name = 'a' THEN 1.0 WHEN test_name = 'b' AND n % 4 > 0 THEN (n % 4) / 4.0 WHEN test_name = 'c' THEN 0.5 END AS score FROM k)
    SELECT submission, round(min(coalesce(score, 0.0)), 2) AS score, round(min(coalesce(score, 0.0)) * 40, 2) AS weighted FROM r GROUP BY submission""")
def subtasks_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test names with a case; runs from a cache in which a test may be twice; a test that was not run has nothing."""
    subtasks = _docs(spark, sf_dir, "n_chars", "source").select(F.col("doc_id").alias("submission"), "n_chars", (F.length("source") % 3).cast("long").alias("problem"), F.lit(1).alias("subtask"), F.lit(40.0).alias("points"), F.lit(2).alias("digits"), F.array(*map(F.lit, ("a", "b", "c", "zz"))).alias("test_names"))
    names = F.when(F.col("id") == 1, F.array(*map(F.lit, "abc"))).otherwise(F.array(*map(F.lit, "ab")))
    cases = spark.range(3).select(F.col("id").alias("problem"), F.explode(names).alias("test_name"))
    one = lambda name, score, status: subtasks.select("submission", F.lit(name).alias("test_name"), score.alias("score"), F.lit(status).alias("status"), "n_chars")
    runs = one("a", F.lit(1.0), "AC").unionByName(one("a", F.lit(0.0), "WA")).unionByName(one("b", F.col("n_chars") % 4 / 4.0, "PA").where("n_chars % 4 > 0")).unionByName(one("c", F.lit(0.5), "PA"))
    return R.subtask_scores(R.subtask_tests(subtasks.drop("n_chars"), cases, runs.drop("n_chars"))).select("submission", "score", "weighted")



@query("token_measures", """
    WITH d AS (SELECT doc_id, length(source) AS k, CAST(list_transform(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\f\\r]+'), lambda w: length(w)) AS INTEGER[]) AS w FROM documents),
    e AS (SELECT *, list_filter(w, lambda x: x <= 9) AS v, list_transform(range(1, len(w)), lambda i: CASE WHEN w[i + 1] > 9 THEN NULL WHEN w[i] = w[i + 1] THEN 1.0 ELSE 0.0 END) AS h FROM d)
    SELECT doc_id, round(list_avg(h), 6) AS accuracy, round(exp(list_avg(list_transform(v, lambda x: x / 10.0))), 6) AS perplexity, round(coalesce(list_sum(list_transform(v, lambda x: x / -10.0)), 0), 4) AS logp, CAST(len(v) AS INTEGER) AS n,
    round(coalesce(list_sum(list_transform(w, lambda x, i: CASE WHEN x > 9 THEN 0.0 WHEN i <= k THEN x / -10.0 ELSE x / -20.0 END)), 0), 4) AS debiased, round(len(v) / CAST(len(w) AS DOUBLE), 6) AS valid, round(3e-4 * sqrt(len(v) / 4000000.0), 9) AS rate FROM e WHERE len(w) > 0 AND k IS NOT NULL""")
def token_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of a text's words as predictions, losses and labels; words of ten letters and more are ignored."""
    words = F.transform(F.regexp_extract_all("text", F.lit(r"[^ \t\n\f\r]+"), F.lit(0)), lambda w: F.length(w))
    rows = load(spark, sf_dir, "documents").select("doc_id", F.length("source").alias("k"), words.alias("w")).where((F.size("w") > 0) & F.col("k").isNotNull())
    labels = F.transform("w", lambda x: F.when(x > 9, -100).otherwise(x))
    logps = F.transform("w", lambda x: x / -10.0)
    pair = M.sequence_logps(logps, labels)
    return rows.select(
        "doc_id",
        F.round(M.token_accuracy(F.col("w"), labels), 6).alias("accuracy"),
        F.round(M.perplexity(F.transform("w", lambda x: x / 10.0), F.transform("w", lambda x: (x <= 9).cast("int"))), 6).alias("perplexity"),
        F.round(pair["logp"], 4).alias("logp"), pair["n"].alias("n"), F.round(M.debiased_logp(logps, labels, F.col("k"), 0.5), 4).alias("debiased"),
        F.round(M.valid_ratio(labels), 6).alias("valid"), F.round(M.learning_rate(pair["n"]), 9).alias("rate"),
    )



@query("preference_losses", """WITH d AS (SELECT doc_id, -0.1 - length(source) / 10.0 AS c, -0.1 - (n_chars % 30) / 10.0 AS r FROM documents WHERE source IS NOT NULL)
    SELECT doc_id, round(ln(1 + exp(-(c - r))), 6) AS pairwise, round(-c + 0.1 * ln(1 + exp(-((c - r) - (ln(1 - exp(c)) - ln(1 - exp(r)))))), 6) AS odds, round(ln(1 + exp(-(2.0 * (c - r - 0.25)))), 6) AS margin FROM d""")
def preference_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = F.lit(-0.1) - F.length("source") / F.lit(10.0), F.lit(-0.1) - F.col("n_chars") % 30 / F.lit(10.0)
    return load(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", *(F.round(x, 6).alias(k) for k, x in (("pairwise", M.pairwise_loss(c, r)), ("odds", M.odds_ratio_loss(c, r, 0.1)), ("margin", M.margin_loss(c, r, 2.0, 0.5)))))


@query("preference_accuracy", "SELECT round(avg(CASE WHEN n_chars > 100 * length(source) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, (SELECT round(avg(m), 6) FROM (SELECT avg(n_chars) AS m FROM documents GROUP BY doc_id // 64)) AS mean FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL")
def preference_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts are longer than a hundred of their sources' names; batches' mean lengths."""
    rows = _docs(spark, sf_dir, (F.length("source") * 100).alias("r"), F.floor(F.col("doc_id") / 64).alias("batch"), "n_chars")
    accuracy = M.pairwise_accuracy(rows.where("r IS NOT NULL AND n_chars IS NOT NULL"), "n_chars", "r").select(F.round("accuracy", 6).alias("accuracy"))
    return accuracy.crossJoin(M.mean_of_means(rows, "batch", ["n_chars"]).select(F.round("n_chars", 6).alias("mean")))


@query("log_progress", "SELECT doc_id, round((doc_id + 1) / 2000.0 * 100, 2) AS percent, round(10.0 / (doc_id + 1) * (2000 - doc_id - 1), 4) AS seconds_left, round(n_chars / 10.0, 4) AS tokens_per_second FROM documents")
def log_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.progress(_docs(spark, sf_dir, (F.col("doc_id") + 1).alias("step"), F.lit(2000).alias("total"), F.lit(10.0).alias("elapsed"), "n_chars"), "step", "total", "elapsed", "n_chars")
    return rows.select("doc_id", "percent", F.round("seconds_left", 4).alias("seconds_left"), F.round("tokens_per_second", 4).alias("tokens_per_second"))


@query("padded_batches", "SELECT doc_id, CAST(max(doc_id % 5 + 1) OVER (PARTITION BY doc_id // 10) AS INTEGER) AS n, CAST(doc_id % 5 + 1 AS INTEGER) AS own FROM documents")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, F.floor(F.col("doc_id") / 10).alias("batch"), F.sequence(F.lit(1), (_mod(5) + 1).cast("int")).alias("input_ids"))
    done = G.pad_batch(rows, "batch", {"input_ids": 0})
    return done.select("doc_id", F.size("input_ids").alias("n"), F.size(F.filter("input_ids", lambda x: x > 0)).alias("own"))
