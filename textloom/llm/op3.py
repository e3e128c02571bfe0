"""Query: quality rules on all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .quality import judge

NAME = "op3_quality_rules"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).drop("key")
