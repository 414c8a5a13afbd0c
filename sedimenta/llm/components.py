"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def roots(parent: np.ndarray) -> np.ndarray:
    """Each element's root in a forest of parents."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The forest after joining the trees of i and j, pair by pair."""
    while len(i):
        parent = roots(parent)
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    return roots(parent)


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of links(a, b) of long ids; component is its smallest node.

    Both steps replace a node's links by links to its smallest neighbour, so the table never grows
    beyond its nodes and links, and a node of any degree is only pre-aggregated and joined. Links with
    null ends and links of a node to itself count as none.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges, before = cut_lineage(edges, "links"), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut_lineage(small, "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
