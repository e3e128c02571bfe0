"""Scores from an outside service as a table: computed once by key, stored, joined."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StringType, StructField, StructType

from .visibility import source_block


def score(rows: DataFrame, call: Callable[[str], str], prompt: str = "prompt", out: str = "response", tries: int = 5, wait: float = 1.0, growth: float = 2.0, threads: int = 16) -> DataFrame:
    """Adds ``out`` and ``error``: each prompt is sent by one of ``threads`` threads of a task; a call that fails is tried again after a growing wait, and at last its error stands in its row."""

    def one(p: str) -> tuple[str | None, str | None]:
        pause = wait
        for k in range(tries):
            try:
                return call(p), None
            except Exception as e:  # whatever a client raises is the row's error
                if k == tries - 1:
                    return None, f"{type(e).__name__}: {e}"
                time.sleep(pause)
                pause *= growth
        return None, "no try"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                found = list(pool.map(one, b[prompt]))
                yield b.assign(**{out: [f[0] for f in found], "error": [f[1] for f in found]})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(out, StringType()), StructField("error", StringType())]))


def score_once(rows: DataFrame, path: str, keys: list[str], call: Callable[[str], str], **options) -> DataFrame:
    """Scores rows whose keys are not stored at ``path`` yet, appends them there, and returns all stored rows."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path)
        rows = rows.join(done.select(*keys).distinct(), keys, "left_anti")
    except Exception as e:  # nothing is stored yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    score(rows, call, **options).withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def alias(rows: DataFrame, names: DataFrame, column: str = "model") -> DataFrame:
    """Model names by a table (name, route); unknown ones stay."""
    return rows.join(names.select(F.col("name").alias(column), "route"), column, "left").withColumn(column, F.coalesce("route", column)).drop("route")


def answer_prompt(question: Column, texts: Column) -> Column:
    """The prompt for an answer that cites its sources by number."""
    asked = F.lit("Answer the question from the sources below alone. After each sentence cite the sources it rests on as [number].\n\nQuestion: ")
    return F.concat(asked, question, F.lit("\n\n"), source_block(texts))


def generated(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], prompt: str = "prompt", out: str = "generation", batch: int = 500) -> DataFrame:
    """Adds texts generated ``batch`` prompts at a time: ``load`` is called once in each task and gives a function from prompts to texts (a local model)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        generate = load()
        for b in batches:
            for at in range(0, len(b), batch):
                yield pa.array(generate(b.slice(at, batch).to_pylist()), pa.string())

    return rows.withColumn(out, _by_arrow(run, StringType(), Iterator[pa.Array], Iterator[pa.Array])(F.col(f"`{prompt}`")))


def _by_arrow(run: Callable, kind: DataType, taken: object, given: object) -> Callable[..., Column]:
    """A function of Arrow arrays as one of Columns: only its arguments go to the worker. It may differ from call to call, so it is called once a row."""
    run.__annotations__ = {"batches": taken, "return": given}
    return F.arrow_udf(run, kind).asNondeterministic()


#: Names of services that run code -> a function from (code, language) to a score.
PROVIDERS: dict[str, Callable[[str, str], float]] = {}


def provider(name: str):
    def add(f):
        if name in PROVIDERS:
            raise ValueError(f"provider {name} exists")
        PROVIDERS[name] = f
        return f

    return add


def executed(rows: DataFrame, name: str, code: str = "code", language: str = "language", out: str = "score", threads: int = 16) -> DataFrame:
    """Adds the score of each row's code by a registered service; a run that fails has 0. This engine itself runs no code."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}")
    call = PROVIDERS[name]

    def one(x: tuple[str, str]) -> float:
        try:
            return float(call(*x))
        except Exception:  # whatever a service raises
            return 0.0

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with ThreadPoolExecutor(threads) as pool:
            for codes, languages in batches:
                yield pa.array(pool.map(one, zip(codes.to_pylist(), languages.to_pylist(), strict=True)), pa.float64())

    by = _by_arrow(run, DoubleType(), Iterator[tuple[pa.Array, pa.Array]], Iterator[pa.Array])
    return rows.withColumn(out, by(F.col(f"`{code}`"), F.col(f"`{language}`")))
