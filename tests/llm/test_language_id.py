import zlib

import numpy as np

from sedimenta.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = {r.doc_id: r for r in queries.op12_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(out) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(out[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) for d in docs)
    assert np.mean([out[d.doc_id].lang_pred == d.lang for d in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "es", "und") for r in out.values())


def _tiny():
    net = language_id.ByteNetwork.untrained(["a", "b", "c"], 3)
    for k in net.parameters:
        net.parameters[k] = net.parameters[k].astype(np.float64)
    return net


def brute_log_probabilities(net, window):
    p, pooled = net.parameters, []
    x = [p["bytes"][b] for b in window] + [np.zeros(language_id.DIMENSIONS)] * (max(language_id.WIDTHS) - 1)
    for w in language_id.WIDTHS:
        values = [np.concatenate(x[i : i + w]) @ p[f"w{w}"] + p[f"b{w}"] for i in range(language_id.WINDOW)]
        pooled.append(np.maximum(np.max(values, axis=0), 0))
    z = np.concatenate(pooled) @ p["out"] + p["bias"]
    return z - np.log(np.exp(z).sum())


def test_network_matches_brute_force():
    net = _tiny()
    windows = np.random.default_rng(0).integers(0, 257, (5, language_id.WINDOW)).astype(np.uint16)
    assert np.allclose(net.log_probabilities(windows), [brute_log_probabilities(net, w) for w in windows], atol=1e-4)


def test_gradient_matches_differences(monkeypatch):
    net = _tiny()
    rng = np.random.default_rng(1)
    windows, language = rng.integers(1, 257, (6, language_id.WINDOW)).astype(np.uint16), rng.integers(0, 3, 6)
    loss = lambda: -np.mean([brute_log_probabilities(net, w)[y] for w, y in zip(windows, language, strict=True)])
    gradient = net.gradient(windows, language)
    for name, g in gradient.items():
        value = net.parameters[name]
        for at in rng.choice(value.size, 3):
            if name == "bytes" and at < language_id.DIMENSIONS:
                continue
            old = value.flat[at]
            value.flat[at] = old + 1e-4
            up = loss()
            value.flat[at] = old - 1e-4
            assert abs((up - loss()) / 2e-4 - g.flat[at]) < 1e-4
            value.flat[at] = old


def test_windows_cover_the_text():
    for n in (0, 1, 255, 256, 257, 509, 510, 5000):
        raw = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        windows, new = language_id.windows_of(raw)
        assert new.sum() == n and (new > 0).all() or n == 0
        back = np.concatenate([w[: language_id.STEP] if i + 1 < len(windows) else w for i, w in enumerate(windows)])
        assert bytes((back[back > 0] - 1).astype(np.uint8)) == raw.lower()


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "x", 1.0), (2, "", "x", 1.0), (3, "123 !? ²", "x", 1.0), (4, "the and of " * 200_000, "en", 1.0), (5, "el de la que", "es", 1.0), (5, "el de la que", "es", 1.0), (None, "the and of", "en", 1.0), (6, "é", None, None)],
        "doc_id long, text string, lang string, score double",
    )
    net = language_id.train(docs, fold=9)
    assert net.languages == ["en", "es"]  # no text of lang x has a letter
    out = language_id.predict_languages(docs, net)
    assert sorted(out.columns) == sorted([*docs.columns, "lang_pred"])
    rows = out.collect()
    assert len(rows) == 8
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred in ("en", "es") for r in rows if r.doc_id not in (1, 2, 3))
    assert {r.lang_pred for r in language_id.predict_languages(docs, language_id.train(docs.limit(0))).collect()} == {"und"}
    assert language_id.predict_languages(docs.limit(0), net).collect() == []
