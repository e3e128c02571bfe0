"""The pipeline's stages at the smallest size against what each promises."""

import base64
import hashlib

import numpy as np


def test_stages(spark, sf):
    import public_tokenizers as P
    import tiktoken

    import corpus_pipeline
    from textloom.llm.jaccard import jaccard_classes
    from textloom.llm.mixing import mix_words
    from textloom.llm.quality import judge
    from textloom.llm.substrings import remove_repeats

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_rules(spark, docs, sf).cache()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judge(docs).where("kept").collect()}
    one = corpus_pipeline.near_duplicates(spark, kept, sf).cache()
    assert {r.doc_id for r in one.collect()} == {r.component_id for r in jaccard_classes(kept).collect()}
    cut = corpus_pipeline.repeated_passages(spark, one, sf).cache()
    left = {r.doc_id: r for r in remove_repeats(one).collect()}
    for r in cut.collect():
        assert abs(len(r.text.encode()) - (left[r.doc_id].n_bytes - left[r.doc_id].n_removed)) <= 6 * left[r.doc_id].n_spans
    mixed = corpus_pipeline.mixing(spark, cut, sf).cache()
    taken = {r.doc_id: r.taken for r in mix_words(cut).collect()}
    assert {r.doc_id: len(r.text.split()) for r in mixed.collect()} == {k: v for k, v in taken.items() if v}
    assert kept.columns == one.columns == cut.columns == mixed.columns == columns
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r.doc_id: hashlib.sha256(np.array(enc.encode_ordinary(r.text), "<u4").tobytes()).hexdigest() for r in mixed.collect()}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == want
