"""Query: all vectors whitened along the leading components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .whitening import whitened

NAME = "op12_embedding_whitening"
#: Eigenvectors are not SQL; tests compare with a plain decomposition.
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
