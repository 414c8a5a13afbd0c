"""Blocks of cells that meet in rounds: the same links, and no table larger than that of the vectors."""

import inspect

import numpy as np
import pytest

from sedimenta.llm import vector_join

from .test_vectors import SCHEMA, brute_links


@pytest.mark.parametrize(("cell_rows", "pivots"), [(4, 64), (8, 2), (50, 1)])
def test_rounds_of_blocks(spark, monkeypatch, cell_rows, pivots):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(260, 16))
    x[200:] = x[rng.integers(0, 120, 60)] + rng.normal(scale=0.03, size=(60, 16))
    x[150:170] = x[0] + rng.normal(scale=0.02, size=(20, 16))
    rows = [(i, v.tolist(), int(i % 7 == 0), "x") for i, v in enumerate(x)]
    small = {"block_values": 16 * 12} if "block_values" in inspect.signature(vector_join.near_duplicates).parameters else {}
    sizes = {}

    def counted(df, name, cut=vector_join.cut_lineage):
        out = cut(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(vector_join, "cut_lineage", counted)
    got = vector_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.98, cell_rows, pivots, **small)
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows, 0.98)
    assert max(sizes.values()) <= len(rows), sizes
