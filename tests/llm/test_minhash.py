import random

import numpy as np

from sedimenta.llm import minhash


def sets(text, size=5):
    w = (text or "").lower().split()
    n = min(size, len(w))
    out = {}
    for i in range(len(w) - n + 1 if w else 0):
        k = tuple(w[i : i + n])
        out[k] = out.get(k, 0) + 1
    return {k: 1 + np.log(c) for k, c in out.items()}


def similarity(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def brute(rows, threshold=0.8):
    s = [sets(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and None not in (rows[i][0], rows[j][0]) and (rows[i][0] == rows[j][0] or similarity(s[i], s[j]) >= threshold):
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                comp[b] = a
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[root(i)] = min(best.get(root(i), r[0]), r[0])
    return [(r[0], None if r[0] is None else best[root(i)]) for i, r in enumerate(rows)]


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_classes_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 60, 200]))
        for k in range(8):
            rows.append((at, edited(words, min(k // 2, len(words) // 25 + 1) if k else 0, rng)))
            at += 1
    family = rng.choices(vocabulary, k=150)
    for _ in range(40):  # a large family whose members are alike in part
        rows.append((at, edited(family, rng.randrange(1, 9), rng)))
        at += 1
    lines = [" ".join(rng.choices(vocabulary, k=9)) for _ in range(8)]
    for _ in range(12):  # repeated lines
        rows.append((at, "\n".join(rng.choices(lines, k=9)) + "\n" + edited(lines[0].split(), 1, rng)))
        at += 1
    chain = rng.choices(vocabulary, k=120)
    for k in range(6):  # a chain whose ends are not alike
        rows.append((at, " ".join(chain[k * 8 :] + [f"tail{i}" for i in range(k * 8)])))
        at += 1
    rows += [(900, None), (901, ""), (902, " \n"), (903, ""), (904, "One two"), (905, "one  TWO"), (None, rows[0][1]), (906, "x y z " * 5000), (907, "x y z " * 5000)]
    rows.append((906, "x y z " * 5000))
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string")
    for block_bytes in (3000, 3 << 20):
        got = sorted(((r.doc_id, r.component_id) for r in minhash.near_duplicates(df, block_bytes=block_bytes).collect()), key=str)
        assert got == sorted(brute(rows), key=str)


def test_pairs_far_from_their_hubs(spark):
    rng = np.random.default_rng(3)
    # each of 50 passages has two wordings: thousands of texts are alike in part, and some smaller id shares nearly every bucket
    choice = rng.integers(2, size=(2000, 50))
    copies = choice[1000::10].copy()
    for row in copies:
        row[rng.choice(50, 2, replace=False)] ^= 1
    choice = np.r_[choice, copies]
    texts = [" ".join(f"p{k}v{v}w{i}" for k, v in enumerate(row) for i in range(20)) for row in choice.tolist()]
    column, at = {}, []
    for i, t in enumerate(texts):
        at += [(i, column.setdefault(x, len(column))) for x in sets(t)]
    x = np.zeros((len(texts), len(column)), np.float32)  # no shingle repeats in a text: similarity is that of plain sets
    x[tuple(np.array(at).T)] = 1
    both, n = x @ x.T, x.sum(axis=1)
    alike = both / (n[:, None] + n[None, :] - both) >= 0.8
    want = np.arange(len(texts))
    while (want != (least := np.where(alike, want[None, :], len(want)).min(axis=1))).any():
        want = least
    assert (want[2000:] < 2000).all()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, block_rows=50).collect()}
    assert sum(got[i] != c for i, c in enumerate(want.tolist())) == 0


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(1)
    codes = np.sort(rng.integers(1 << 62, size=300, dtype=np.uint64))
    a, b = codes[:260], codes[40:]
    wa, wb = rng.integers(1, 5, 260).astype(float), rng.integers(1, 5, 260).astype(float)
    exact = minhash.probability_jaccard((a, wa), (b, wb))
    assert abs(exact - similarity(dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True)))) < 1e-9
    s = minhash.prob_min_hash(np.r_[np.zeros(260, int), np.ones(260, int)], np.r_[a, b], np.r_[wa, wb], 2, 4096)
    assert abs((s[0] == s[1]).mean() - exact) < 0.04


def test_no_documents(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
