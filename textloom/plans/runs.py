"""Programs run, texts generated and media stood in for, on values of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extract_code
from ..operators.generation import distilled, generation_run
from ..operators.packing import with_dummy_media
from ..operators.runner import with_judgment
from ..shared import remember, shared_dir
from .registry import load, query


@query(
    "code_rewards",
    """WITH d AS (SELECT doc_id, n_chars AS n, coalesce(toxic, 0) AS t FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, CASE WHEN n % 50 = 7 OR t = 1 THEN 0.0 ELSE 1.0 END AS score, CASE WHEN n % 50 = 7 THEN 'RE' WHEN t = 1 THEN 'WA' ELSE 'AC' END AS verdict FROM d""",
)
def code_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts that end with a program, extracted and run on a case made of the text's length; toxic ones answer one off, some end with an error."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", F.col("n_chars").cast("long").alias("n")).join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    program = F.when(F.col("n") % 50 == 7, F.lit("raise ValueError(input())")).otherwise(F.format_string("n = int(input())\nprint(n * 2 + %d)", F.coalesce("toxic", F.lit(0)).cast("long")))
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit("\n```python\nprint('not this one')\n```\nbut\n```python\n"), program, F.lit("\n```"))
    case = F.struct(F.col("n").cast("string").alias("input"), (F.col("n") * 2).cast("string").alias("output"))
    rows = rows.select("doc_id", extract_code(answer).alias("code"), F.lit("python").alias("language"), F.array(case).alias("cases"))
    return with_judgment(rows, "code", "language", "cases").select("doc_id", "judged.score", "judged.verdict")


@query("distilled_generations", "SELECT CAST(doc_id AS VARCHAR) AS key, length(text) || ',' || length(text) AS generations, 0 AS errors, md5(text) AS prompt FROM documents WHERE text IS NOT NULL")
def distilled_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples of every text from a model that counts characters, in two runs over one store: the second has nothing left to do."""
    store = f"{shared_dir(spark)}/generations-{spark.range(1).select(F.uuid()).first()[0]}"
    remember(spark, store)
    rows = load(spark, sf_dir, "documents").select("doc_id", "text")
    run = lambda: generation_run(rows, "doc_id", F.col("text"), lambda: lambda prompts: [str(len(p)) for p in prompts], store, samples=2)
    run()
    return distilled(run()).select("key", F.array_join("generations", ",").alias("generations"), "errors", F.md5("prompt").alias("prompt"))


@query(
    "dummy_media",
    """WITH d AS (SELECT doc_id, doc_id // 8 AS batch, n_chars % 11 = 0 AS seen, n_chars % 7 = 0 AS heard, list_transform(regexp_extract_all(coalesce(source, ''), '.'), lambda x: ascii(x)) AS s FROM documents),
    b AS (SELECT *, bool_or(seen) OVER w AS any_seen, bool_or(heard) OVER w AS any_heard, doc_id = min(doc_id) OVER w AS head FROM d WINDOW w AS (PARTITION BY batch)),
    e AS (SELECT *, list_concat(CASE WHEN head AND NOT any_seen THEN [900, 901] ELSE [] END, CASE WHEN head AND NOT any_heard THEN [902] ELSE [] END) AS x FROM b)
    SELECT doc_id, coalesce(array_to_string(list_concat(s, x), ','), '') AS input_ids, coalesce(array_to_string(list_concat(s, list_transform(x, lambda i: -100)), ','), '') AS labels, seen OR head AND NOT any_seen AS has_image FROM e""",
)
def dummy_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of eight documents; every eleventh length has an image, every seventh a sound."""
    ids = F.transform(F.regexp_extract_all(F.coalesce("source", F.lit("")), F.lit("."), F.lit(0)), lambda x: F.ascii(x))
    media = lambda n: F.when(F.col("n_chars") % n == 0, F.array("source"))
    rows = load(spark, sf_dir, "documents").select(
        "doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), ids.alias("labels"),
        media(11).alias("_images"), F.lit(None).cast("array<string>").alias("_videos"), media(7).alias("_audios"),
    )
    done = with_dummy_media(rows, "batch", "doc_id", [900, 901], [902])
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return done.select("doc_id", joined("input_ids"), joined("labels"), F.col("_images").isNotNull().alias("has_image"))


@query("learnt_words")
def learnt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written without spaces, cut by a dictionary learnt from all of them; how much their words repeat."""
    from ..operators.words import learn_words, repetition_of_words, with_words

    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower("text"), r"\s+", "").alias("text"))
    words = learn_words(rows, runs=r"\S+")
    cut = with_words(rows, words, runs=r"\S+")
    digest = F.md5(F.array_join("words", " "))
    return cut.select("conv_id", "turn", F.size("words").alias("n_words"), digest.alias("digest"), F.round(repetition_of_words(F.col("words"), 3, -1.0), 6).alias("repetition"))


_SIZES = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(32 + n_chars % 700 AS INTEGER) AS w, CAST(32 + (n_chars * 7) % 700 AS INTEGER) AS h FROM documents WHERE n_chars IS NOT NULL),
q AS (SELECT *, greatest(28, CAST(round_even(h / 28.0, 0) AS INTEGER) * 28) AS qh, greatest(28, CAST(round_even(w / 28.0, 0) AS INTEGER) * 28) AS qw FROM d),
g AS (SELECT *, CASE WHEN qh * qw > 1003520 THEN greatest(28, floor(h / sqrt(h * w / 1003520.0) / 28) * 28) WHEN qh * qw < 3136 THEN ceil(h * sqrt(3136.0 / (h * w)) / 28) * 28 ELSE qh END // 14 AS gh,
  CASE WHEN qh * qw > 1003520 THEN greatest(28, floor(w / sqrt(h * w / 1003520.0) / 28) * 28) WHEN qh * qw < 3136 THEN ceil(w * sqrt(3136.0 / (h * w)) / 28) * 28 ELSE qw END // 14 AS gw FROM q)
"""


@query(
    "media_expanded",
    _SIZES
    + """SELECT doc_id, md5(replace(t, chr(10), '<|vision_start|>' || repeat('<|image_pad|>', CAST(gh * gw // 4 AS INTEGER)) || '<|vision_end|>')) AS qwen2_vl,
    md5(replace(t, chr(10), repeat(repeat('[IMG]', (w - 1) // 16 + 1) || '[IMG_BREAK]', (h - 1) // 16) || repeat('[IMG]', (w - 1) // 16 + 1) || '[IMG_END]')) AS pixtral,
    md5(replace(t, chr(10), repeat('<image>', 576))) AS llava, md5(replace(t, chr(10), '')) AS paligemma,
    md5(replace(t, chr(10), chr(10) || chr(10) || '<start_of_image>' || repeat('<image_soft_token>', 256) || '<end_of_image>' || chr(10) || chr(10))) AS gemma3, md5(replace(t, chr(10), '<|image|>')) AS mllama FROM g""",
)
def media_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with an image at each line end, of a size made of the text's length, in six families."""
    from ..operators.media import expand_images

    n = F.col("n_chars").cast("long")
    size = F.struct((32 + n % 700).cast("int").alias("width"), (32 + (n * 7) % 700).cast("int").alias("height"))
    text = F.coalesce("text", F.lit(""))
    marks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = load(spark, sf_dir, "documents").where("n_chars IS NOT NULL").select("doc_id", F.replace(text, F.lit("\n"), F.lit("<image>")).alias("t"), F.array_repeat(size, marks).alias("sizes"))
    return rows.select("doc_id", *(F.md5(expand_images(F.col("t"), F.col("sizes"), f)).alias(f) for f in ("qwen2_vl", "pixtral", "llava", "paligemma", "gemma3", "mllama")))
