"""Query: quality of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .pu import score_quality

NAME = "op7_quality_classifier"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
