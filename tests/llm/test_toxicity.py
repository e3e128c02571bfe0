"""Toxicity of long texts."""

from pyspark.sql import functions as F


def test_long_texts(spark):
    from textloom.llm.toxicity import score_toxicity

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{k}.parquet") for k in ("documents", "labels"))
    known = docs.join(labels.select("doc_id", "toxic").distinct(), "doc_id").where("text is not null").orderBy("doc_id").collect()
    clean = {k: " ".join(r.text for r in known if r.toxic == 0 and k in (r.lang, "mixed")) for k in ("en", "de", "fr", "es", "mixed")}
    toxic = [r.text for r in known if r.toxic == 1 and r.lang == "en"][:30]
    long = [(-1 - i, t[:3_000_000]) for i, t in enumerate(clean.values())]
    inside = [(-100 - i, f"{clean['en'][:20_000]} {t} {clean['en'][20_000:40_000]}") for i, t in enumerate(toxic)]
    rows = docs.select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_semi").unionByName(spark.createDataFrame(long + inside, "doc_id long, text string"))
    got = {r.doc_id: r for r in score_toxicity(rows, labels).where(F.col("doc_id") < 0).collect()}
    assert [got[i].predicted for i, _ in long] == [0] * len(long), {k: (len(t), got[i].score) for (i, t), k in zip(long, clean)}
    assert sum(got[i].predicted for i, _ in inside) > len(inside) / 2
