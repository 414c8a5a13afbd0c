import numpy as np

import corpus_pipeline
from tests.llm.test_minhash import brute as brute_classes
from tests.llm.test_suffix_dedup import brute as brute_repeats

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "packing"]
    good = corpus_pipeline.quality_classifier(spark, docs, SF).cache()
    assert good.columns == docs.columns
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    fine = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert len(kept & bad) <= 0.1 * len(bad) and len(fine - kept) <= 0.05 * len(fine)

    one = corpus_pipeline.near_dedup(spark, good, SF).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, c in brute_classes(rows) if d == c)
    assert one.columns == docs.columns

    cut = corpus_pipeline.repeat_dedup(spark, one, SF).cache()
    assert cut.columns == docs.columns
    want = {d: (removed, spans) for d, _, removed, spans, _ in brute_repeats(sorted((r.doc_id, r.text) for r in one.collect()), 100)}
    before = {r.doc_id: r.text.encode() for r in one.collect()}
    for r in cut.collect():
        removed, spans = want[r.doc_id]
        assert 0 <= len(r.text.encode()) - (len(before[r.doc_id]) - removed) <= 6 * spans
        assert r.n_chars == len(r.text)

    pieces = corpus_pipeline.pack(spark, cut, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in cut.collect()}
    assert all(len(np.frombuffer(r.token_ids, "<u4")) == r.length for r in pieces)


def test_run_and_edges(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    rows = [(1, None, "en", "s", 0, 1), (2, "", "en", "s", 0, 1), (None, "é" * 900, "en", "s", 900, 1), (2, "", "en", "s", 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for own in (docs, docs.limit(0)):
            out = stage(spark, own, str(tmp_path))
            n = out.count()
            assert (n == 0) == (own is not docs), name
            if name != "packing":
                assert out.columns == docs.columns
