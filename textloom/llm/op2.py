"""Query: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .toxicity import score_toxicity

NAME = "op2_toxicity"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
