import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import queries, suffix_dedup


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of rows in document order."""
    seen, out = set(), []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        gone = gone[: len(raw)]
        out.append((doc, len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=64, max_size=64).map(lambda b: bytes(x % 3 for x in b)), max_size=40), st.integers(0, 5))
def test_deep_shallow_sort(strings, copies):
    strings = strings + strings[:copies] + [s[:50] + bytes(14) for s in strings[:9]]
    rows = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 64)
    order = suffix_dedup.deep_shallow_sort(rows, 16)
    assert [strings[i] for i in order] == sorted(strings)


@pytest.mark.parametrize("most_contexts, block_bytes", [(200_000, 8 << 20), (200_000, 4000), (1, 4000), (3, 4000), (15, 8 << 20)])
def test_against_brute_force(spark, most_contexts, block_bytes):
    rng = random.Random(2)
    letters = "abcdé \n"
    passages = ["".join(rng.choices(letters, k=rng.choice([60, 100, 150, 400]))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = ["".join(rng.choices(letters, k=rng.randrange(120))) + rng.choice(passages) for _ in range(rng.randrange(4))]
        rows.append((i * 3 - 20, "".join(parts)))
    rows += [(500, "a" * 700), (501, "ab" * 300), (502, None), (503, ""), (504, "a" * 99), (505, "a" * 100), (506, rows[5][1]), (507, rows[5][1]), (508, passages[3] + passages[3])]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame([(*r, 1) for r in shuffled], "doc_id long, text string, block int")
    got = suffix_dedup.remove_repeats(df, 100, block_bytes=block_bytes, most_contexts=most_contexts).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == brute(rows, 100)


def test_hash_ranges_hold_alike_many_anchors():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh \n", k=4000)) for _ in range(20)]
    asked = suffix_dedup._ask(100, 12)(pa.table({"text": texts, "block": [0] * len(texts)}))
    held = [len(k) // 8 for k in asked.column("keys").to_pylist()]
    assert sorted(asked.column("bucket").to_pylist()) == list(range(12))
    assert max(held) < 2 * sum(held) / 12


def test_repeated_and_null_ids(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(None, text), (4, text), (4, text)], "doc_id long, text string").coalesce(1)
    got = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r.doc_id or 99, r.n_removed) for r in got) == [(4, 0), (4, 300), (99, 300)]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = sorted(tuple(r) for r in queries.op10_suffix_dedup(spark, sf).collect())
    assert got == [(d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in brute(rows, 100)]
