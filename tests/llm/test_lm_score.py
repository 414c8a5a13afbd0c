import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sedimenta.llm import lm_score, queries


def brute(rows):
    split = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    count = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in split(t))
    n, v = sum(count.values()), len(count)
    out = []
    for (d, t), h in zip(rows, held, strict=True):
        words = split(t)
        out.append((d, h, len(words), sum(count[w] > 0 for w in words), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)))
    return out


def same(got, want):
    key = lambda r: str(r[:4])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("block_bytes", [4 << 20, 2000])
def test_base_scores(spark, block_bytes):
    rows = [(i, " ".join(f"W{(i * 7 + k * k) % 50}" for k in range(i % 40))) for i in range(120)] + [(None, "a É b"), (7, None), (8, ""), (8, ""), (9, "x" * 400_000 + " y\x0b\tz\n")]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, held_out boolean")
    got = lm_score.score_documents(df, block_bytes=block_bytes)
    same([tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in got.collect()], brute(rows))
    assert lm_score.score_documents(df.limit(0)).count() == 0


def model_score(rows, base=1.5, a=1000.0, b=20.0):
    """Scores by exact dictionaries of quantised counts."""
    least = lambda c: math.ceil(base ** math.floor(math.log(c) / math.log(base) + 1e-9) - 1e-6) if c else 0
    most = lambda c: math.ceil(base ** (1 + math.floor(math.log(c) / math.log(base) + 1e-9)) - 1e-6) - 1 if c else 0
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    text = [[None, *(t or "").split(), None] for _, t in rows]
    of = lambda n: Counter(g for t, h in zip(text, held, strict=True) if not h for g in zip(*(t[k:] for k in range(n)), strict=False))
    word, pair, triple = Counter(w for t, h in zip(text, held, strict=True) if not h for w in t[1:]), of(2), of(3)
    n, v, out = sum(word.values()), len(word), []
    for (d, _), t in zip(rows, text, strict=True):
        total = 0.0
        for i in range(1, len(t)):
            share = (word[t[i]] + 0.5) / (n + 0.5 * (v + 1))
            seen = min(least(pair[t[i - 1], t[i]]), word[t[i]], word[t[i - 1]])
            p = (seen + a * share) / (word[t[i - 1]] + a)
            if i > 1:
                context = most(pair[t[i - 2], t[i - 1]])
                p = (min(least(triple[t[i - 2], t[i - 1], t[i]]), context, seen) + b * p) / (context + b)
            total += math.log10(p)
        out.append((str(d), total, len(t) - 1))
    return out


def test_every_pair_and_triple_counts(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 90}" for k in range(i % 40))) for i in range(150)] + [(None, "a b a"), (8, "")]
    want = sorted(model_score(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block_bytes in (4 << 20, 2000):
        got = sorted((str(r.doc_id), r.score, r.n_tokens) for r in lm_score.score_documents(df, block_bytes=block_bytes).collect())
        assert [(x[0], x[2]) for x in got] == [(x[0], x[2]) for x in want]
        apart = np.abs([x[1] - y[1] for x, y in zip(got, want, strict=True)])
        # a false positive changes few texts, and a text's score by little
        assert (apart > 1e-9).mean() < 0.05 and apart.max() < 4


def test_a_larger_corpus_does_not_score_worse(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    per = []
    for share in (5, 1):
        out = lm_score.score_documents(docs.where(f"crc32(cast(cast(doc_id as string) as binary)) % 5 = 1 or doc_id % {share} = 0"), block_bytes=1 << 20).where("held_out").collect()
        per.append(sum(r.score for r in out) / sum(r.n_tokens for r in out))
    assert per[1] > per[0]


def test_query_beats_word_shares(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op4_lm_score(spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same([tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in out], brute(rows))
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)


def test_filter_reads_levels():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1 << 63, size=50_000, dtype=np.uint64))
    counts = rng.zipf(1.5, size=len(keys)).clip(max=100_000)
    held = lm_score.LogFrequencyFilter.of(keys, counts, 1.5)
    level = lm_score.level_of(counts, 1.5)
    assert (lm_score.least_of(level, 1.5) <= counts).all() and (counts <= lm_score.most_of(level, 1.5)).all()
    assert (held.levels(keys) >= level).all() and (held.levels(keys) > level).mean() < 0.002
    assert (held.levels(rng.integers(1 << 63, size=50_000, dtype=np.uint64)) > 0).mean() < 0.002
    assert abs(held.bits.mean() - 0.5) < 0.02


def test_words_of_a_shared_polynomial_hash(spark):
    for n in (1024, 2048, 4096):
        x = "".join("ab"[i.bit_count() & 1] for i in range(n))
        y = x.translate(str.maketrans("ab", "ba"))
        rows = [(1, x), (2, y), (4, x)]
        got = lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string"))
        same([tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in got.collect()], brute(rows))
