import hashlib
import re
import zlib

import numpy as np
import pytest

from sedimenta.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute_runs(w, least=6, factor=4):
    """Runs by walking each period over the words; a longer period within a run of a shorter one is not the smallest."""
    out = []
    for q in range(1, len(w) // factor + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, factor * q) and not any(s <= i and s + k >= i + n for s, k, _ in out):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and n and h % 10 == 0:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
    return runs, " ".join(x for i, x in enumerate(w) if i not in dropped)


@pytest.mark.parametrize("factor", [3, 4, 6])
def test_runs_of_random_words(factor):
    rng = np.random.default_rng(factor)
    for _ in range(150):
        texts = []
        for _ in range(rng.integers(1, 8)):
            w = rng.integers(0, rng.integers(1, 5), rng.integers(0, 130))
            if len(w) and rng.random() < 0.6:
                a = rng.integers(len(w))
                i = np.arange(len(w))
                i[a:] = a + (i[a:] - a) % (1 + rng.integers(max(1, (len(w) - a) // 3)))
                w = w[i]
            texts.append(w.astype(np.int64))
        sizes = np.array([len(w) for w in texts])
        got = list(zip(*(x.tolist() for x in periodic.find_runs(np.concatenate(texts), sizes, 6, factor)), strict=True))
        assert got == [(s + at, n, q) for w, at in zip(texts, np.cumsum(sizes) - sizes, strict=True) for s, n, q in brute_runs(w.tolist(), 6, factor)]


def test_long_runs_and_far_numbers():
    n = 300_000
    for w, want in ((np.zeros(n, np.int64), (0, n, 1)), (np.arange(n) % 40_000 * 1000, (0, n, 40_000)), (np.r_[np.arange(1000), np.arange(n) % 7], (1000, n, 7))):
        assert [x.tolist() for x in periodic.find_runs(w, np.array([len(w)]))] == [[x] for x in want]


def test_zero_mismatches_are_exact():
    rng = np.random.default_rng(1)
    for size in (1, 2, 8, 64):
        window = rng.integers(1, 3, (2 * size, 50))
        block = np.where(rng.random(50) < 0.5, window[size // 2 : size // 2 + size], rng.integers(1, 3, (size, 50)))
        block, window = block * 3_000_000, window * 3_000_000
        want = [[(window[lag : lag + size, j] == block[:, j]).all() for j in range(50)] for lag in range(size)]
        assert (periodic.zero_mismatches(block, window) == np.array(want)).all()
    top = periodic.PRIMES[0][0]  # a difference of one prime squared is no match
    assert not periodic.zero_mismatches(np.array([[1]]), np.array([[1 + top], [0]]))[0, 0]
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(9, np.int64), np.array([9]), factor=2)


def test_query_matches_brute_force(spark):
    out = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        runs, text = brute_row(d.doc_id, d.text)
        r = out[d.doc_id]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edges(spark):
    texts = [None, "", " \t\n\x0b", "a", "a " * 5, "a " * 6, "A a " * 4, "x\xa0y " * 7, "ab c d " * 5000 + "tail", "a b " * 4, "w" * 3_000_000 + " q" * 9]
    rows = [(i, t, t) for i, t in enumerate(texts)] + [(3, "k " * 8, "z"), (3, "k " * 8, "z"), (None, "k " * 8, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, collapsed string")
    got = sorted((repr(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.collapse_runs(docs).collect())
    want = sorted((repr(i), len((t or "").encode().split()), *brute_row(i, t, False)) for i, t, _ in rows)
    assert got == want
    assert periodic.collapse_runs(docs.limit(0)).collect() == []
