"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents, whatever other columns there are and
whatever their names. Every stage takes texts of any length, and an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.bpe import encode_documents
from textloom.llm.common import documents, table
from textloom.llm.jaccard import one_of_each
from textloom.llm.mixing import mix_documents
from textloom.llm.quality import keep
from textloom.llm.substrings import cleaned


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their group's outlier test reject go: null and empty texts among them; equal rows stay or go together."""
    return keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that with the least doc_id; null, empty and blank texts are like nothing and stay; of equal rows one stays."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start at several places are cut out of all texts, of equal rows too; a null text becomes empty."""
    return cleaned(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become the words that the mixture takes of them; documents of which it takes none go, null and empty ones among them; equal rows are dealt with one by one."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of each mixed text: doc_id, n_tokens, digests, ids; a row for every row, null and empty texts without tokens."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Suffix sorting, seeded permutations and BPE are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
