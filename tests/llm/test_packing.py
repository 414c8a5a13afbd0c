import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sedimenta.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_bins_hold_every_item_once(sizes):
    ffd = packing.first_fit_decreasing(sizes, 64)
    loads = []
    for size in sorted(sizes, reverse=True):  # brute force
        if size:
            fit = next((i for i, x in enumerate(loads) if x + size <= 64), None)
            if fit is None:
                loads.append(size)
            else:
                loads[fit] += size
    assert [sum(x[2] for x in b) for b in ffd] == loads
    bins = packing.fill_gaps(ffd, 64)
    assert sum(sum(x[2] for x in b) < 64 for b in bins) <= 1
    cells = sorted((i, p) for b in bins for i, at, n in b for p in range(at, at + n))
    assert cells == [(i, p) for i, n in enumerate(sizes) for p in range(n)]


def test_packing_matches_the_tokenizers_library(spark):
    texts = [(1, "Hello  world's\n\n 12"), (2, None), (3, ""), (4, "é" * 5000), (4, "é" * 5000), (None, "x y " * 3000), (7, "a <|endoftext|> b"), (8, "<|endoftext|><|endoftext|>  \n<|endoftext|"), (9, "<|endoftext|>")]
    docs = spark.createDataFrame([(*r, 0) for r in texts], "doc_id long, text string, key int")
    rows = packing.pack_documents(docs, PATH).collect()
    t = Tokenizer.from_file(PATH)
    want = sorted((d or -1, tuple(t.encode(x or "", add_special_tokens=False).ids) + (0,)) for d, x in texts)
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id or -1, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    for doc, pieces in by_doc.items():
        ids = [x for d, x in want if d == doc]
        assert sorted(p for r in pieces for p in range(r.start, r.start + r.length)) == sorted(p for x in ids for p in range(len(x)))
        for r in pieces:
            got = tuple(np.frombuffer(r.token_ids, "<u4").tolist())
            assert any(x[r.start : r.start + r.length] == got and len(x) == r.doc_tokens for x in ids)


def test_ids_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text, t, ids = {r.doc_id: r.text for r in docs.collect()}, Tokenizer.from_file(PATH), {}
    for r in packing.pack_documents(docs, PATH).collect():
        ids.setdefault(r.doc_id, {})[r.start] = np.frombuffer(r.token_ids, "<u4").tolist()
    want = t.encode_batch([x or "" for x in text.values()], add_special_tokens=False)
    for doc, w in zip(text, want, strict=True):
        assert [x for _, part in sorted(ids[doc].items()) for x in part] == [*w.ids, 0]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).count() == 0


def test_whole_table(spark):
    from sedimenta.llm import queries

    sf = "/root/testdata/sf0.001"
    out = queries.op1_packing(spark, sf).cache()
    seqs = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert seqs.where("n > 1024").count() == 0
    assert seqs.where("n < 1024").count() <= 1
    assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").distinct().count()
