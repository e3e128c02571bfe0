"""Query: all documents packed into sequences of 4,096 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bestfit import packed
from .common import documents

NAME = "op13_best_fit_packing"
#: Tokenizers are not SQL; tests compare with the library and with plain best fit.
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
