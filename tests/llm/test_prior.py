"""The class prior and both networks come from the whole corpus, in however many parts."""

import numpy as np
import pytest


def corpus(spark):
    text = {False: "a clear sentence of good words , number {} of many .", True: "$$$ %%% ### {} $$$ %%%"}
    rows = [(i, text[i % 4 != 0].format(i % 7)) for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1) for i in range(0, 4000, 20)], "doc_id long, quality int")


@pytest.mark.parametrize("part", [20_000, 700])
def test_prior_of_all_documents(spark, monkeypatch, part):
    from textloom.llm import pu

    monkeypatch.setattr(pu, "PART", part)
    docs, labels = corpus(spark)
    assert abs(pu.train(docs, labels, most=200)[1] - 0.25) < 0.005  # half of a sample of 200 rows misses it
    got = pu.score_quality(docs, labels, most=200).collect()
    assert np.mean([g.predicted == (g.doc_id % 4 == 0) for g in got]) > 0.999


def test_one_text_of_each_sampled_id(spark):
    from pyspark.sql import functions as F

    from textloom.llm.learn import texts_of

    docs = spark.range(500).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    ids = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, label int")
    assert sorted(map(tuple, texts_of(docs, ids).select("doc_id", "label", "text").collect())) == [(0, 1, "t0"), (1, 0, "t1")]
