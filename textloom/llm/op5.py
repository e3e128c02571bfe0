"""Query: words that the mixture takes from every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .mixing import mix_words

NAME = "op5_mixing_sources"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_words(documents(spark, sf_dir).select("doc_id", "text", "source"))
