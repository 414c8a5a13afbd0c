import base64
import hashlib
import time

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import bpe, kernels, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.BytePairEncoder(RANKS)


def ids(text):
    return kernels.encode_texts([text], lambda p: ENCODER.encode(p.encode()), kernels.SpanTable())[0].tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abest'SrRvVlLdDm  \n\t1२é漢!- 　🙂_", max_size=60))
def test_same_as_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_very_long_pretokens():
    for text in ("a" * 200_000, "abc" * 50_000, "!?" * 40_000, " " * 50_000):
        began = time.time()
        assert ids(text) == LIBRARY.encode_ordinary(text)
        assert time.time() - began < 20


def thue_morse(n):
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_a_shared_polynomial_hash(spark):
    for n in (1024, 2048, 4096):
        x, y = thue_morse(n)
        known = kernels.SpanTable()
        encode = lambda t: kernels.encode_texts(t, lambda p: ENCODER.encode(p.encode()), known)  # noqa: B023, E731
        assert [i.tolist() for i in encode([x, y])] == [LIBRARY.encode_ordinary(x), LIBRARY.encode_ordinary(y)]
        assert encode([y])[0].tolist() == LIBRARY.encode_ordinary(y)
        out = bpe.encode_decode(spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string"), PATH).collect()
        assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in out) == [(1, x), (2, y)]


def test_equal_hashes_are_confirmed(monkeypatch):
    texts = ["one two three two one", "three four", "one", "five two"]
    want = [LIBRARY.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(kernels, "span_hashes", lambda values, starts, ends: (ends - starts).astype(kernels.U8))  # all spans of a length collide
    known = kernels.SpanTable()
    for _ in range(2):
        for t, w in zip(texts, want, strict=True):
            assert kernels.encode_texts([t], lambda p: ENCODER.encode(p.encode()), known)[0].tolist() == w
    assert [x.tolist() for x in kernels.encode_texts(texts, lambda p: ENCODER.encode(p.encode()), known)] == want


def test_edges(spark):
    rows = [(1, "a b", 1), (1, "a b", 2), (None, None, 3), (2, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    out = bpe.encode_decode(df, PATH).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in out) == [(0, b""), (1, b"a b"), (1, b"a b"), (2, b"")]
    assert bpe.encode_decode(df.limit(0), PATH).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op7_byte_bpe(spark, sf).collect()
    assert len(out) == len(text)
    for r in out:
        want = LIBRARY.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
