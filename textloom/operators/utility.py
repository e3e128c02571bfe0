"""Usefulness of an answer: citation precision and recall, key-point coverage, ratings, and the filters on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import support_weight

CRITERIA = ("Clarity", "Depth", "Balance", "Breadth", "Support", "Insightfulness")
METRICS = ("Precision", "Recall", *CRITERIA, "KPR", "KPC")


def citation_quality(questions: DataFrame, judged: DataFrame) -> DataFrame:
    """(key, precision, recall) of every row of ``questions`` (key).

    judged: key, claim_id, source_index (null: the claim cites nothing), label (null: the source does not
    exist). Recall is the share of claims that cite; precision the mean over cited claims of the best
    support; claims without a valid label do not count for it, nor for anything when there is none (0).
    Without claims both are null.
    """
    claims = judged.groupBy("key", "claim_id").agg(F.max(F.col("source_index").isNotNull().cast("int")).alias("cited"), F.max(F.when(F.col("label").isNotNull(), support_weight(F.col("label")))).alias("best"))
    scores = claims.groupBy("key").agg(F.coalesce(F.avg("best"), F.lit(0.0)).alias("precision"), F.avg("cited").alias("recall"))
    return questions.select("key").join(scores, "key", "left")


def point_coverage(points: DataFrame) -> DataFrame:
    """(key, kpr, kpc): shares of supported and of contradicted key points; points: key, label."""
    return points.groupBy("key").agg(F.avg((F.col("label") == "Supported").cast("int")).alias("kpr"), F.avg((F.col("label") == "Contradicted").cast("int")).alias("kpc"))


def judge_points(points: Column, judgments: Column) -> Column:
    """Labels of an array of key points from a map of judgments keyed by the point's number as text; null where there is none."""
    return F.transform(points, lambda p: F.try_element_at(judgments, p["point_number"].cast("string"))["label"])


def simplify_points(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p["point_number"].alias("point_number"), p["point_content"].alias("point_content")))


def bounded_rating(rating: Column) -> Column:
    """A rating out of ten as a share; one that is out of range is none."""
    return F.when(rating.between(0, 10), rating / 10)


def quality_dimensions(ratings: DataFrame) -> DataFrame:
    """One column for each criterion; ratings: key, criterion, rating (0 to 10)."""
    return ratings.groupBy("key").pivot("criterion", list(CRITERIA)).agg(F.first(bounded_rating(F.col("rating")), ignorenulls=True))


def criteria_rows(questions: DataFrame, criteria: tuple[str, ...] = CRITERIA) -> DataFrame:
    """Each question once for each criterion: (..., criterion). The criteria are an array in the row, so nothing is joined."""
    return questions.withColumn("criterion", F.explode(F.array(*map(F.lit, criteria))))


def support_rate(supported: Column, omitted: Column, contradicted: Column) -> Column:
    return F.coalesce(F.try_divide(supported.cast("double"), (supported + omitted + contradicted).cast("double")), F.lit(0.0))


def cold_start_filter(rows: DataFrame, metrics: list[str], least: float = 0.8) -> DataFrame:
    """Rows whose every metric (``new_*`` against ``old_*``) is strictly better, without contradictions and with enough support."""
    better = reduce(lambda a, b: a & b, [F.col(f"new_{m}") > F.col(f"old_{m}") for m in metrics])
    rate = support_rate(F.col("supported"), F.col("omitted"), F.col("contradicted"))
    return rows.where(better & (F.col("contradicted") == 0) & (rate >= least))


def is_complete(scores: Column, wanted: list[str]) -> Column:
    """A stored score holds every wanted metric; for the rated criteria any one is enough."""
    need = [scores[m].isNotNull() for m in wanted if m not in CRITERIA]
    if any(m in CRITERIA for m in wanted):
        need.append(F.coalesce(*(scores[c] for c in CRITERIA)).isNotNull())
    return reduce(lambda a, b: a & b, need, F.lit(True))


def with_key_points(questions: DataFrame, points: DataFrame) -> DataFrame:
    """Questions with their key points (query_id, key_points); an empty list counts as none. Spark broadcasts the lookup if its size allows."""
    found = points.select("query_id", F.when(F.size("key_points") > 0, F.col("key_points")).alias("key_points"))
    return questions.join(found, "query_id", "left")


def claim_documents(claims: DataFrame, texts: str = "text_list") -> DataFrame:
    """A row for each claim and source index that exists; claims: key, claim_id, claim, source_indices and an array of documents."""
    rows = claims.select("key", "claim_id", "claim", F.explode_outer("source_indices").alias("source_index"), F.col(texts).alias("_texts"))
    return rows.withColumn("document", F.when(F.col("source_index") >= 0, F.get("_texts", F.col("source_index")))).drop("_texts")
