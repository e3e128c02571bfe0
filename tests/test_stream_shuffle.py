"""The shuffle buffer of a stream against a plain one, with and without a stop in the middle."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.streaming import incremental
from textloom.streaming.shuffle import drained, drawn, shuffled_stream, use_rocksdb

SCHEMA = "id long, text string, shard string, b binary"


@pytest.mark.parametrize("stops", [[], [3], [1, 5]])
def test_order(spark, tmp_path, stops):
    use_rocksdb(spark)
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    files = 7

    def feed(a, z):
        for f in range(a, z):
            spark.range(f * 40, f * 40 + 40).select("id", F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"), F.lit("mine").alias("shard"), F.lit(b"\x00\xff").alias("b")).coalesce(1).write.mode("append").parquet(source)

    size, shards, seed = 30, 3, 5
    at = 0
    for stop in [*stops, files]:
        feed(at, stop)
        at = stop
        stream = incremental.read_stream(spark, source, SCHEMA, files_per_batch=1)
        incremental.run(shuffled_stream(stream, "id", "id", size, shards, seed), incremental.append_to(out), check)
    got = spark.read.parquet(out).drop("batch").unionByName(drained(spark, check, stream.schema, seed)).collect()
    assert sorted(r.id for r in got) == list(range(files * 40)) and all(r.text == f"row {r.id}" and r.b == b"\x00\xff" and r["shard"] == "mine" for r in got)
    of = {r.id: r.s for r in spark.range(files * 40).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).cast("int").alias("s")).collect()}
    want, held, n = defaultdict(list), defaultdict(list), defaultdict(int)
    for i in range(files * 40):
        s = of[i]
        if len(held[s]) < size:
            held[s].append(i)
        else:
            k = drawn(seed, s, n[s], size)
            want[s].append(held[s][k])
            held[s][k] = i
        n[s] += 1
    by = defaultdict(dict)
    for r in got:
        by[r["_shard"]][r.place] = r.id
    for s in by:
        assert sorted(by[s]) == list(range(n[s]))
        assert [by[s][p] for p in range(n[s] - size)] == want[s]
        assert {by[s][p] for p in range(n[s] - size, n[s])} == set(held[s])
    assert [by[0][p] for p in sorted(by[0])] != sorted(by[0].values())
