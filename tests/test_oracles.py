"""Every query of the engine with an SQL equivalent gives the same rows at the smallest size."""

from decimal import Decimal

import duckdb
import pytest

from textloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 5) if isinstance(v, (float, Decimal)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, sf, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(str([plain(v) for v in r]) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    want = tables.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]}) z").fetchall()
    assert got == sorted(str([plain(v) for v in r]) for r in want)


def test_rows_of_wide_tables_are_all_numbered(spark):
    """Row numbers and batches of rows of 2 KB, at several numbers of partitions."""
    from pyspark.sql import functions as F

    from textloom.operators import preparation as P
    from textloom.operators.packing import pack_knapsack

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 32, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            rows = spark.range(20_000).select(F.xxhash64("id").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 32).alias("t"))
            found = P.indexed(rows, ["k"], "at")
            assert found.agg(F.count("*"), F.count_distinct("at"), F.min("at"), F.max("at")).first()[:] == (20_000, 20_000, 0, 19_999)
            assert P.batches(rows, ["k"], 64).agg(F.count("*"), F.count_distinct("batch")).first()[:] == (20_000, 313)
            sums = P.running(rows.withColumn("one", F.lit(1)), ["k"], {"before": "one"})
            assert sums.agg(F.count_distinct("before"), F.max("before")).first()[:] == (20_000, 19_999)
        ids = rows.select("k", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.lit(1)).alias("input_ids")).withColumn("labels", F.col("input_ids"))
        packs = pack_knapsack(P.batches(ids, ["k"], 1000), 50, key="k")
        assert packs.agg(F.sum(F.size("keys"))).first()[0] == 20_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rules_merge_without_a_level_cap(spark):
    """A merger that keeps its rules apart gives them back; one that merges is called until one chunk is left."""
    from pyspark.sql import functions as F

    from textloom.operators.rules import merge_rules

    rules = spark.range(300).select(F.array(F.concat(F.lit("rule "), F.col("id").cast("string"))).alias("rules"))
    assert merge_rules(rules, lambda chunks: chunks, budget=100).count() == 300
    first = merge_rules(rules, lambda chunks: chunks.select("chunk", F.slice("rules", 1, 1).alias("rules")), budget=100)
    assert [r.rule for r in first.collect()] == ["rule 0"]
