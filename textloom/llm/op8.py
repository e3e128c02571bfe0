"""Query: order min-hash fingerprints of all documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .omh import compare_edits

NAME = "op8_order_min_hash"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(documents(spark, sf_dir))
