import re
import zlib

import numpy as np

from sedimenta.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = {r.doc_id: r for r in queries.op9_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(out[r.doc_id], r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(o.held_out for o, _ in held)
    assert np.mean([o.predicted == q for o, q in held]) >= 0.95
    assert all(o.predicted == int(o.score >= 0.3) and 0 <= o.score <= 1 for o in out.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (1, "", 9.0), (None, "a b " * 200_000, 9.0), (2, "x\n" * 9, 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert len(quality.score_documents(docs, model).collect()) == 4
    empty = quality.train(docs, labels.limit(0))
    assert {r.predicted for r in quality.score_documents(docs, empty).collect()} == {1}
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_features_of_cut_texts(monkeypatch):
    texts = ["Hello there.\nBIG!! 12 é\nHello there.\n" * 40, "", "a", "no end of words " * 90]
    whole = quality.features(texts)
    monkeypatch.setattr(quality.kernels, "BATCH", 200)
    parts = quality.features(texts)
    assert np.isfinite(whole).all()
    assert np.allclose(whole[1:3], parts[1:3])


def test_features_do_not_depend_on_cuts(monkeypatch):
    texts = ["Hello there.\nBIG!! 12 é\nHello there.\n" * 40, "", "AB", "B!", "!!", "no end of words " * 90, "a line of words\n\n" * 60 + "x", "AB CD!! " * 50 + "\n" * 300 + " ## " * 70]
    whole = quality.features(texts)
    assert np.allclose(whole, [quality.features([t])[0] for t in texts])
    for size in (200, 1000):
        monkeypatch.setattr(quality.kernels, "BATCH", size)
        assert np.allclose(whole, quality.features(texts))


def test_ranking_learns_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    good = x @ [1, -2, 0] + rng.normal(scale=0.1, size=400) > 0
    model = quality.QualityModel.fit(x, good, 5000, 1)
    assert ((model.score(x, 0.3) >= 0.3) == good).mean() > 0.97


def brute_features(text):
    raw = text.encode()
    classes = [lambda b: 97 <= b <= 122, lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b == 32, lambda b: b == 10, lambda b: b in b".,;:'\"-()", lambda b: b in b"!?", lambda b: b in b"#$%&*+/<=>@\\^_`{|}~[]", lambda b: b >= 128, lambda b: True]
    kind = [next(i for i, f in enumerate(classes) if f(b)) for b in raw]
    share = [kind.count(i) / max(len(raw), 1) for i in range(10)]
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    lines = raw.split(b"\n")
    lines = lines[:-1] if not lines[-1] else lines
    again = sum(a == b and k in (6, 7) for a, b, k in zip(raw, raw[1:], kind[1:], strict=False))
    caps = sum(a == b == 1 for a, b in zip(kind, kind[1:], strict=False))
    bucket = [0] * quality.BUCKETS
    for w in words:
        bucket[int(quality.kernels.words(np.frombuffer(w, np.uint8), np.zeros(1, np.int64))[0][0]) % quality.BUCKETS] += 1
    n, w, ln = len(raw), max(len(words), 1), max(len(lines), 1)
    return [*share, *np.sqrt(share), np.log1p(n), n / w / 10, len(set(words)) / w, len(words) / ln / 20, len(set(lines)) / ln, np.sqrt(again / w), np.sqrt(caps / w), np.log1p(len(lines)), n > 0, *(np.sqrt(b / w) for b in bucket)]


def test_features_match_brute_force(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", "\n", "a\n\nB!! é\x0b##", "ABC def!", "x " * 200_000 + "\nx y\nx y", "A" * 300_000]
    assert np.allclose(quality.features(texts), [brute_features(t) for t in texts])
