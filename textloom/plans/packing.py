"""Truncation, masking, packing and collation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packing as P
from ..operators.preparation import batches
from .registry import load, query

_SEQLEN = "CASE WHEN t * 2 < c THEN c WHEN s * 2 < c THEN c - s ELSE CAST(floor(c * (t / CAST(s + t AS DOUBLE))) AS BIGINT) END"


@query(
    "infer_seqlen",
    f"""WITH x AS (SELECT doc_id, n_chars AS s, coalesce(lead(n_chars) OVER (ORDER BY doc_id), 10) AS t, 1000 AS c FROM documents),
    y AS (SELECT *, least({_SEQLEN}, t) AS nt FROM x) SELECT doc_id, CAST(least(greatest(c - nt, 0), s) AS INTEGER) AS source, CAST(nt AS INTEGER) AS target FROM y""",
)
def infer_seqlen(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n_chars").alias("t"))
    rows = docs.join(following, "doc_id", "left").na.fill(10, ["t"])
    return rows.select("doc_id", P.infer_lengths(F.col("n_chars"), F.col("t"), 1000).alias("x")).select("doc_id", "x.source", "x.target")


@query(
    "label_mask",
    """WITH x AS (SELECT doc_id, least(n_chars % 50, 40) AS p, least(n_chars % 37, 30) AS r FROM documents) SELECT doc_id, CAST(p + r AS INTEGER) AS n, CAST(p AS INTEGER) AS ignored FROM x""",
)
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", F.least(F.col("n_chars") % 50, F.lit(40)).cast("int").alias("p"), F.least(F.col("n_chars") % 37, F.lit(30)).cast("int").alias("r"))
    labels = P.masked(F.array_repeat(F.lit(7), F.col("p")), F.array_repeat(F.lit(9), F.col("r")))
    return d.select("doc_id", labels.alias("l")).select("doc_id", F.size("l").alias("n"), F.size(F.filter("l", lambda x: x == P.IGNORE)).alias("ignored"))


@query(
    "pretrain_blocks",
    r"""WITH w AS (SELECT doc_id // 100 AS batch, doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS a FROM documents),
    t AS (SELECT batch, doc_id, unnest(list_transform(a, lambda x: length(x)) || [0]) AS id, unnest(range(0, len(a) + 1)) AS i FROM w),
    n AS (SELECT batch, id, row_number() OVER (PARTITION BY batch ORDER BY doc_id, i) - 1 AS k FROM t),
    b AS (SELECT batch, k // 512 AS block, count(*) AS n, sum(id) AS total FROM n GROUP BY 1, 2)
    SELECT batch, CAST(block AS INTEGER) AS block, CAST(total AS BIGINT) AS total FROM b WHERE n = 512""",
)
def pretrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-space tokens with their length as id, 0 at the end of a document, in blocks of 512 for each hundred documents."""
    words = F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("batch"), F.transform(words, lambda w: F.length(w)).alias("ids"))
    blocks = P.pretrain_blocks(docs, 512, "doc_id", eos=0)
    return blocks.select("batch", "block", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("knapsack_pack")
def knapsack_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of word lengths of up to 512 words packed by batches of 1000 documents."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.transform(words, lambda w: F.length(w)).alias("input_ids"))
    docs = batches(docs.withColumn("labels", F.col("input_ids")), ["key"])
    return P.pack_knapsack(docs, 512).select("batch", "pack", F.size("keys").alias("n"), F.size("input_ids").alias("size"))


@query(
    "attention_mask",
    """WITH m AS (SELECT doc_id, CASE CAST(doc_id % 3 AS INTEGER) WHEN 0 THEN [1, 1, 2, 0] WHEN 1 THEN [1, 2, 2, 2] ELSE [1, 2, 3, 0] END AS mask FROM documents), i AS (SELECT doc_id, mask, unnest(range(0, 4)) AS i FROM m), j AS (SELECT *, unnest(range(0, 4)) AS j FROM i)
    SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, mask[i + 1] = mask[j + 1] AND mask[i + 1] <> 0 AND j <= i AS allowed FROM j""",
)
def attention_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = F.array(*(F.array(*map(F.lit, m)) for m in ((1, 1, 2, 0), (1, 2, 2, 2), (1, 2, 3, 0))))
    rows = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(P.block_mask(F.get(masks, (F.col("doc_id") % 3).cast("int")))).alias("i", "row"))
    return rows.select("doc_id", "i", F.posexplode("row").alias("j", "allowed"))


@query(
    "kto_pairing",
    """WITH r AS (SELECT conv_id, turn, conv_id // 10 AS batch, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn) AS k, length(text) AS n FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, coalesce(lag(n) OVER (PARTITION BY batch ORDER BY k), last_value(n) OVER (PARTITION BY batch ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS kl FROM r""",
)
def kto_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.floor(F.col("conv_id") / 10).alias("batch"), F.struct("conv_id", "turn").alias("k"), F.length("text").cast("long").alias("response"))
    return P.kto_pairs(rows, "batch", "k").select("conv_id", "turn", F.col("kl_response").alias("kl"))
