import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import components, vector_join, vector_search

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute_links(rows, threshold):
    def ok(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    def cos(a, b):
        return float(np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)))

    x = [None if not ok(r) else np.array(r[1], np.float32).astype(float) for r in rows]
    links = {
        i: [j for j, b in enumerate(x) if j != i and x[i] is not None and b is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(b) and cos(x[i], b) >= threshold]
        for i in range(len(rows))
    }
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(links[i]), c, None if c is None else r[0] == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell_rows", [12, 1000])
def test_range_join_is_exact(spark, cell_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.12, size=8)).tolist(), i % 3 % 2, "x") for i in range(120)]
    rows += [(200 + i, rows[0][1], 0, "x") for i in range(30)]
    rows += [(300, None, 0, "x"), (301, [0.0] * 8, 0, "x"), (302, [float("nan")] * 8, 0, "x"), (303, [None, 1.0], 0, "x"), (304, [], 0, "x"), (305, rows[1][1], None, "x"), (306, [1.0, 2.0], 0, "x"), (307, [2.0, 4.0], 0, "x"), (None, rows[0][1], 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = vector_join.near_duplicates(df, 0.98, cell_rows=cell_rows, most_pivots=16)
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows, 0.98)


def test_links_of_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 0, ""), (1, [0.0, 1.0], 0, ""), (2, [1.0, 0.001], 0, ""), (5, [0.0, 1.0], 1, ""), (4, [0.0, 1.0], 1, ""), (5, [1.0, 0.0], 1, ""), (3, [1.0, 0.0], 1, "")]
    got = sorted(tuple(r)[:3] for r in vector_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.98).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 1, 3), (5, 1, 3)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vector_join.near_duplicates(df).count() == 0
    assert vector_search.top_k(df, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_search_is_exact(spark, shard_rows):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist(), 0, "") for i in range(700)] + [(1000 + i, [0.5] * 6, 0, "") for i in range(90)]
    rows += [(2000, None, 0, ""), (2020, [float("inf")] * 6, 0, ""), (2040, [None] * 6, 0, ""), (40, rows[40][1], 0, "")]
    got = vector_search.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=7, shard_rows=shard_rows, query_rows=16).collect()
    x = [(r[0], np.floor(64 * np.array(r[1], np.float32).astype(float)).astype(int)) for r in rows[:790] + rows[793:]]
    want = set()
    for q, v in x:
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in x if i != q)[:7]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert len(got) == len(want)
    assert set(map(tuple, got)) == want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 103), (7, 7), (None, 3)] + [(500, 501 + i) for i in range(50)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 103)} | {i: 500 for i in range(500, 551)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_many_labels_share_bins(spark):
    draw = np.random.default_rng(11)
    x = np.repeat(draw.normal(size=(150, 4)), 4, axis=0) + 0.05 * draw.normal(size=(600, 4))
    labels = [int(v) for v in draw.integers(0, 90, 600) * np.where(draw.random(600) < 0.3, 0, 1)]  # a third in one label
    x[:, 3] *= np.array(labels) % 2  # repeats of a zero are vectors like others
    rows = [(i, v.tolist() if i % 7 else v[:3].tolist(), l) for i, (v, l) in enumerate(zip(x, labels, strict=True))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long"), 0.98, cell_rows=16).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    alike = [[j for j, b, m in rows if j != i and l == m and len(a) == len(b) and unit(a) @ unit(b) >= 0.98] for i, a, l in rows]
    least = list(range(600))
    for _ in rows:
        least = [min([least[i], *(least[j] for j in alike[i])]) for i in range(600)]
    assert got == {i: (len(alike[i]), least[i]) for i in range(600)} and sum(map(len, alike)) > 300
