"""Generation runs over tables: several samples of each prompt, batches of prompts of like length, results stored wave by wave so that a run can go on where it ended."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import drop_table, table
from ..ship import ship

STORED = "key string, sample int, prompt string, generation string, error string, attempts int"


def in_batches(prompts: list[str], generate: Callable[[list[str]], list[str]], retries: int, wait: float, sleep=time.sleep) -> list[tuple[str | None, str | None, int]]:
    """(text, error, attempts) of each prompt. A batch that fails is tried again, at last prompt by prompt, so that one bad prompt costs itself only."""
    error = ""
    for attempt in range(retries + 1):
        try:
            texts = generate(prompts)
            if len(texts) != len(prompts):
                raise ValueError(f"{len(texts)} texts for {len(prompts)} prompts")
            return [(t, None, attempt + 1) for t in texts]
        except Exception as e:  # whatever a model or a service raises
            error = f"{type(e).__name__}: {e}"
            if attempt < retries:
                sleep(wait * 2**attempt)
    if len(prompts) == 1:
        return [(None, error, retries + 1)]
    return [r for p in prompts for r in in_batches([p], generate, 0, wait, sleep)]


def generate_wave(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[str]]], batch: int, retries: int, wait: float, tasks: int, profile: ResourceProfile | None = None) -> DataFrame:
    """The samples of ``rows`` (key, prompt, samples: their numbers), one row each, with what became of them (``STORED``).

    Prompts are dealt evenly over ``tasks`` tasks and sorted by length in them, once for all samples of a row, so a batch holds prompts of like
    length and no task all the long ones; ``load`` is called once in a task. ``profile``: what the tasks need, e.g. an accelerator.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = load()
        for f in frames:
            for at in range(0, len(f), batch):
                some = f.iloc[at : at + batch]
                found = in_batches(list(some["prompt"]), generate, retries, wait)
                texts, errors, attempts = zip(*found, strict=True)
                yield some[["key", "sample", "prompt"]].assign(generation=list(texts), error=list(errors), attempts=list(attempts))

    dealt = rows.repartition(tasks).sortWithinPartitions(F.length("prompt"), "key", "samples").select("key", F.explode("samples").alias("sample"), "prompt")
    return dealt.mapInPandas(run, STORED, profile=profile)


def _missing(asked: DataFrame, done: DataFrame, samples: int) -> DataFrame | None:
    """(key, prompt, samples) of what ``asked`` (key, prompt) needs and ``done`` (key, sample) lacks; None if it lacks nothing.

    Keys are counted and compared without their prompts, which are shuffled only if keys repeat or a part is done.
    """
    every = F.sequence(F.lit(0), F.lit(samples - 1))
    had = done.groupBy("key").agg(F.collect_set("sample").alias("had"))
    keys = asked.groupBy("key").agg(F.count("*").alias("n")).join(had, "key", "left")
    keys = table(keys.select("key", "n", F.array_except(every, F.coalesce("had", F.lit([]).cast("array<int>"))).alias("samples")), "missing")
    keys_n, most, left = keys.agg(F.count("*"), F.max("n"), F.sum(F.size("samples"))).first()
    if not left:
        return None
    if most > 1:
        asked = asked.groupBy("key").agg(F.min("prompt").alias("prompt"))
    if left == keys_n * samples:
        return asked.withColumn("samples", every)
    return asked.join(keys.where(F.size("samples") > 0).select("key", "samples"), "key")


def _waves(left: DataFrame, samples: int, wave: int, batch: int, tasks: int) -> Iterator[DataFrame]:
    """``left`` (key, prompt, samples) in parts of about ``wave`` prompts; a size below 1 makes one part.

    Rows are written once, in files of a share of a wave at most, and a part reads its own files only. A row holds a batch of samples at most, so
    that many samples of few prompts are divided, too.
    """
    starts = F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / batch).cast("int"))
    rows = left.withColumn("samples", F.explode(F.transform(starts, lambda i: F.slice("samples", i * batch + 1, batch))))
    placed = table(rows, "prompts", maxRecordsPerFile=max(1, wave // (tasks * min(samples, batch))) if wave > 0 else 0)
    file = F.col("_metadata.file_name")
    names, n = [], 0
    for f in placed.groupBy(file.alias("name")).agg(F.sum(F.size("samples")).alias("n")).orderBy("name").collect():  # some numbers for each wave
        if names and n + f.n > wave > 0:
            yield placed.where(file.isin(names))
            names, n = [], 0
        names.append(f.name)
        n += f.n
    if names:
        yield placed.where(file.isin(names))
    drop_table(placed)


def generation_run(rows: DataFrame, key: str, prompt: Column, load: Callable[[], Callable[[list[str]], list[str]]], store: str, samples: int = 1, batch: int = 64, retries: int = 0, wait: float = 1.0, wave: int = 100_000, tasks: int = 8, again: bool = False, profile: ResourceProfile | None = None) -> DataFrame:
    """Generates ``samples`` texts for each row's prompt and returns the store's rows, one for each (key, sample).

    What ``store`` (a folder of Parquet files) has already is not generated again; with ``again`` what failed is. Waves of about ``wave``
    prompts are appended as they end, so a run that breaks off loses a wave at most. A prompt that fails stays as a row with its error.
    Rows with equal keys count once; a null key or prompt is passed over. ``rows`` is read for its keys and then for its prompts.
    """
    spark = rows.sparkSession
    ship(spark)
    asked = rows.select(F.col(f"`{key}`").cast("string").alias("key"), prompt.alias("prompt")).dropna()
    spark.createDataFrame([], STORED).write.mode("append").parquet(store)
    have = spark.read.schema(STORED).parquet(store)
    left = _missing(asked, have.where("error IS NULL") if again else have, samples)
    for part in _waves(left, samples, wave, batch, tasks) if left is not None else []:
        generate_wave(part, load, batch, retries, wait, tasks, profile).write.mode("append").parquet(store)
    stored = spark.read.schema(STORED).parquet(store)
    if stored.groupBy("key", "sample").count().where("count > 1").isEmpty():  # as it is unless something was generated again
        return stored
    good = F.struct(F.col("error").isNull().alias("good"), "attempts", "prompt", "generation", "error")
    return stored.groupBy("key", "sample").agg(F.max(good).alias("r")).select("key", "sample", "r.prompt", "r.generation", "r.error", "r.attempts")


def distilled(stored: DataFrame) -> DataFrame:
    """(key, prompt, generations, errors): the samples of each prompt in order; null where one failed."""
    both = stored.groupBy("key").agg(F.first("prompt").alias("prompt"), F.array_sort(F.collect_list(F.struct("sample", "generation", "error"))).alias("s"))
    return both.select("key", "prompt", F.transform("s", lambda x: x["generation"]).alias("generations"), F.size(F.filter("s", lambda x: x["error"].isNotNull())).alias("errors"))
