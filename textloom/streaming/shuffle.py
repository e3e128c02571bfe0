"""A shuffle buffer for streams: a stateful operator that holds a bounded number of rows across micro-batches.

Rows are dealt to shards; each shard fills its buffer, and from then on every row that comes takes the place of a row drawn
by a seeded hash, which leaves. Buffers and counts are state, so a stream that is started again goes on in the order it would
have had. What is in the buffers when the stream has ended is read from the state and comes last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..ship import ship
from ..shared import unused

_OUT = "shard int, place long, row string"


def drawn(seed: int, shard: int, n: int, size: int) -> int:
    """Which of ``size`` places the n-th row of a shard takes."""
    return int.from_bytes(hashlib.blake2b(f"{seed}|{shard}|{n}".encode(), digest_size=8).digest(), "little") % size


class ShuffleBuffer(StatefulProcessor):
    """State of a shard: the rows in its buffer, in order of their places, and how many rows have come."""

    def __init__(self, size: int, seed: int):
        self.size, self.seed = size, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("buffer", "slot int, row string")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        shard = int(key[0])
        come = pd.concat(list(rows)).sort_values(["at", "row"], kind="stable")["row"].tolist()
        held = [r for _, r in sorted((int(s), r) for s, r in self.rows.get())] if self.count.exists() else []
        n = int(self.count.get()[0]) if self.count.exists() else 0
        places, left = [], []
        for row in come:
            if len(held) < self.size:
                held.append(row)
            else:
                at = drawn(self.seed, shard, n, self.size)
                places.append(n - self.size)
                left.append(held[at])
                held[at] = row
            n += 1
        self.rows.put([(i, r) for i, r in enumerate(held)])
        self.count.update((n,))
        yield pd.DataFrame({"shard": pd.Series([shard] * len(left), dtype="int32"), "place": pd.Series(places, dtype="int64"), "row": pd.Series(left, dtype="object")})

    def close(self) -> None:
        pass


def shuffled_stream(stream: DataFrame, key: str, order: str, size: int, shards: int = 8, seed: int = 42) -> DataFrame:
    """``stream`` in shuffled order: its columns, with shard and place (from 0 in each shard; more underscores where the stream has such columns).

    A row is dealt to a shard by its ``key``; rows of a micro-batch come in the order of ``order``. ``size`` rows are held in each shard:
    with fewer rows than that nothing leaves before :func:`drained`. Needs the state store on RocksDB (:func:`use_rocksdb`).
    """
    ship(stream.sparkSession)
    shard = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(shards)).cast("int").alias("shard")
    rows = stream.select(shard, F.col(order).alias("at"), F.to_json(F.struct("*")).alias("row"))
    out = rows.groupBy("shard").transformWithStateInPandas(ShuffleBuffer(size, seed), _OUT, "Append", "None")
    return _opened(out, stream.schema)


def _opened(rows: DataFrame, schema: StructType) -> DataFrame:
    shard, place = unused(schema.fieldNames(), "shard", "place")
    read = rows.select(F.from_json("row", schema).alias("r"), F.col("shard").alias(shard), F.col("place").alias(place))
    return read.select("r.*", shard, place)


def drained(spark: SparkSession, checkpoint: str, schema: StructType, seed: int = 42) -> DataFrame:
    """What is in the buffers of a stream that has ended, in an order drawn by hash, with the places after those that left; at most the buffers' size from each shard."""
    state = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
    held = state("buffer").option("flattenCollectionTypes", "true").load().select(F.col("key.shard").alias("shard"), "list_element.*")
    counts = state("count").load().select(F.col("key.shard").alias("shard"), F.col("value.n").alias("n"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64("slot", F.lit(seed)), "slot")
    rank = held.withColumn("rank", F.row_number().over(order) - 1)
    sizes = held.groupBy("shard").agg(F.count("*").alias("size"))
    rows = rank.join(counts, "shard").join(sizes, "shard").select("shard", (F.col("n") - F.col("size") + F.col("rank")).alias("place"), "row")
    return _opened(rows, schema)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that operators with state of several kinds need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
