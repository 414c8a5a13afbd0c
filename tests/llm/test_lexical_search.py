import math
import re
from collections import Counter

import numpy as np

from sedimenta.llm import lexical_search as ls
from sedimenta.llm import queries
from verify import compare

SF = "/root/testdata/sf0.001"
FIND = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text):
    return [t.lower() for t in FIND.findall((text or "").encode())]


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in words if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_query_matches_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items], 50)
    assert rows_of(queries.op13_lexical_search(spark, SF)) == sorted(want, key=repr)
    assert compare(spark, SF, queries.op13_lexical_search, queries.OP13_SQL) == ""


def test_many_shards_blocks_and_items(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    odds = 1 / np.arange(1, 41)
    text = lambda n: " ".join(rng.choice(words, n, p=odds / odds.sum()))
    docs = [(int(i // 2), text(rng.integers(1, 60))) for i in range(3000)] + [(7, "w1 w2 " * 70_000)]
    items = [(i, text(6)) for i in range(9)]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(3)
    index = ls.build_index(table, shard_bytes=60_000)
    got = ls.search(index, spark.createDataFrame(items, "item_id long, text string"), k=15, items_at_once=4, shards_at_once=2)
    assert rows_of(got) == sorted(brute(docs, items, 15), key=repr)


def test_rejected_blocks_stay_packed():
    """A rare heavy term fills the heap; the common light list is then read only where its blocks could still lift a document."""
    n, known = 40_000, ls.Vocabulary()
    lengths = np.full(n, 10)
    lengths[:60] = 2
    docs = [known.ids([b"light"] + [b"heavy"] * (i % 500 < 20 and i < 3000)) for i in range(n)]
    batch = ls._index_rows(0, list(range(n)), np.array([len(d) for d in docs]), docs, known).to_pylist()
    own = np.array([len(d) for d in docs])
    impact = lambda tf, length: 10**9 * tf // (1000 * tf + 20 * (50 + 50 * length))
    lists = {r["term"]: ls.PostingList({b"heavy": 5000, b"light": 1}[r["term"]], r["n"], r["postings"], r["blocks"], r["bounds"], impact, own) for r in batch[1:]}
    for x in lists.values():
        whole = np.zeros(n, np.int64)
        tf = np.array([d.tolist().count(known[b"heavy" if x.weight > 1 else b"light"]) for d in docs])
        whole[tf > 0] = x.weight * impact(tf[tf > 0], own[tf > 0])
        assert x.bound == whole.max()
        assert all(x.best[b] == whole[np.flatnonzero(tf)[b * 64 : b * 64 + 64]].max() for b in range(len(x.best)))
    best = ls.block_max_maxscore(list(lists.values()), n, ls.Best(20, np.arange(n)))
    assert len(best.docs) == 20
    assert lists[b"light"].read.sum() < len(lists[b"light"].read) / 8


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "!!! \n"), (4, "Ä ä aB ab"), (5, "x " * 300_000), (None, "ab"), (4, "ab"), (6, "ab"), (6, "ab")]
    items = [(1, "AB ab"), (1, "x"), (2, None), (None, "x"), (3, "nothing here"), (4, "ä " * 9)]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    got = ls.search(ls.build_index(table), asked, k=5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == sorted(brute(docs, items, 5), key=repr)
    assert ls.search(ls.build_index(table.limit(0)), asked).collect() == []
    assert ls.search(ls.build_index(table), asked.limit(0)).collect() == []
