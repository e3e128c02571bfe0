"""What goes through Python workers and what is computed once, by plans."""

import pytest
from pyspark.sql import functions as F


def steps(df, name):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.count(name)


@pytest.mark.parametrize(("query", "workers"), [("tool_calls", 4), ("tool_prompts", 1)])
def test_tool_columns_share_workers(spark, sf, query, workers):
    from __spark_entry__ import queries

    df = queries()[query](spark, sf)
    assert steps(df, "BatchEvalPython") <= workers and steps(df, "MapInPandas") == 0, df._jdf.queryExecution().executedPlan().toString()


def test_generated_texts_come_in_parts(spark):
    from textloom.operators.scorer import generated

    rows = spark.range(0, 1200, 1, 1).select("id", F.col("id").cast("string").alias("prompt"))
    got = generated(rows, lambda: lambda prompts: [f"{p} of {len(prompts)}" for p in prompts])
    assert steps(got, "MapInPandas") == 0
    assert [r.generation for r in got.orderBy("id").collect()] == [f"{i} of {500 if i < 1000 else 200}" for i in range(1200)]


def test_parts_of_marks_are_made_once(spark):
    from textloom.operators.media import expand

    (row,) = spark.range(1).select(expand(F.lit("a|b|c|"), "|", F.array_repeat(F.uuid(), 2)).alias("t")).collect()
    first = row.t[1:37]
    assert row.t == f"a{first}b{first}c|"


def test_chunks_that_end_nothing_are_passed_over(spark):
    """Only chunks that may be an end are read for one: all whose token has a mark or ends a paragraph."""
    from textloom.operators.sentences import _may_end, chunks, token

    text = "Dr. A said (yes!) \"no?\" wait… 3.5 so... on\n \n then [1]. x\n\ny plain Words, and; more: v1.2 end"
    found = spark.range(1).select(F.explode(chunks(F.lit(text))).alias("c")).select("c", token(F.col("c")).alias("t"), _may_end(F.col("c")).alias("may")).collect()
    assert "".join(r.c for r in found) == text
    assert all(r.may for r in found if r.t["mark"] or r.t["ends"])
    assert [r.c.strip() for r in found if not r.may] == ["A", "said", "then", "y", "plain", "Words,", "and;", "more:", "end"]
