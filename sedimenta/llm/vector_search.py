"""Exact top-k search by inner product: a ball tree per shard, branch and bound, a shared k-th score.

Vectors go to the cell of their nearest pivot; large cells are dealt out by row. Each shard's tree is built
once and stored with its outer ball. A node's upper bound for query q is q.centre + |q| radius. Each query
first searches the shard it lies in; its k-th score there is the bound that it meets all other shards with:
those whose outer ball stays below it never see the query. Inside a shard nodes are taken by upper bound,
each find raises the k-th score, and the search ends when the next node is below it.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .common import cut_lineage, row_key
from .vector_join import FINITE

HITS = "query_id long, query_key long, vec_id long, score long"
TREES = "dim int, cell int, part int, centre array<double>, radius double, tree binary"
LEAF = 256
SHARD = ["dim", "cell", "part"]


class BallTree:
    """Balls around halves of the rows, split at the median of the widest axis down to leaves; a node's rows lie side by side."""

    PARTS = ("x", "ids", "start", "stop", "left", "right", "centre", "radius")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.x, self.ids, self.start, self.stop, self.left, self.right, self.centre, self.radius = (parts[p] for p in self.PARTS)

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray) -> BallTree:
        order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0)]
        children = []
        while todo:
            lo, hi, above, side = todo.pop()
            own = x[order[lo:hi]]
            centre = own.mean(axis=0)
            if above >= 0:
                children[above][side] = len(nodes)
            nodes.append((lo, hi, centre, math.sqrt(((own - centre) ** 2).sum(axis=1).max())))
            children.append([-1, -1])
            if hi - lo > LEAF:
                half = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(own[:, np.ptp(own, axis=0).argmax()], half)]
                todo += [(lo + half, hi, len(nodes) - 1, 1), (lo, lo + half, len(nodes) - 1, 0)]
        left, right = np.array(children, np.int32).T
        start, stop, centre, radius = (np.array(c) for c in zip(*nodes, strict=True))
        return cls(dict(zip(cls.PARTS, (x[order], ids[order], start, stop, left, right, centre, radius), strict=True)))

    def bytes(self) -> bytes:
        small = self.x.astype(np.int16)
        out = io.BytesIO()
        np.savez(out, x=small if (small == self.x).all() else self.x, ids=self.ids, start=self.start, stop=self.stop, left=self.left, right=self.right, centre=self.centre, radius=self.radius)
        return out.getvalue()

    @classmethod
    def read(cls, raw: bytes) -> BallTree:
        with np.load(io.BytesIO(raw)) as parts:
            return cls({p: parts[p].astype(np.float64) if p == "x" else parts[p] for p in cls.PARTS})

    def search(self, q: np.ndarray, upper: np.ndarray, k: int, bound: float, me: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows, other than those of id `me`, whose scores reach bound; upper: of every node."""
        scores, found = np.zeros(0), np.zeros(0, np.int64)
        heap = [(-upper[0], 0)]
        while heap and -heap[0][0] >= bound:
            node = heapq.heappop(heap)[1]
            if self.left[node] >= 0:
                for c in (int(self.left[node]), int(self.right[node])):
                    if upper[c] >= bound:
                        heapq.heappush(heap, (-upper[c], c))
                continue
            own = slice(self.start[node], self.stop[node])
            got = self.x[own] @ q
            hit = (got >= bound) & (self.ids[own] != me)
            if hit.any():
                scores, found = np.r_[scores, got[hit]], np.r_[found, self.ids[own][hit]]
                order = np.lexsort((found, -scores))[:k]
                scores, found = scores[order], found[order]
                if len(scores) == k:
                    bound = max(bound, scores[-1])
        return scores, found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), dtype=np.float64).reshape(len(column), -1)


def _place(pivots: dict[int, np.ndarray]):
    """The cell of each vector: its nearest pivot of the same length, 0 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, cell = np.array(batch.column("dim")), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dim):
                if d in pivots:
                    at = np.flatnonzero(dim == d)
                    x = np.asarray(batch.column("q").take(pa.array(at)).flatten(), dtype=np.float64).reshape(len(at), -1)
                    cell[at] = (2 * x @ pivots[d].T - (pivots[d] ** 2).sum(axis=1)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def _build(t: pa.Table) -> pa.Table:
    tree = BallTree.of(_matrix(t.column("q")), np.array(t.column("vec_id")))
    own = {c: t.column(c).slice(0, 1) for c in SHARD}
    return pa.table(own | {"centre": pa.array([tree.centre[0].tolist()]), "radius": pa.array([float(tree.radius[0])]), "tree": pa.array([tree.bytes()], pa.binary())})


def _upper(asked: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    upper = asked @ centre.T + np.sqrt((asked * asked).sum(axis=1))[:, None] * radius
    return upper + 1e-6 * (1 + np.abs(upper))


def _search(k: int):
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if trees.num_rows and queries.num_rows:
            tree = BallTree.read(trees.column("tree")[0].as_py())
            asked = _matrix(queries.column("q"))
            for lo in range(0, len(asked), 1024):
                rows = queries.slice(lo, 1024)
                upper = _upper(asked[lo : lo + 1024], tree.centre, tree.radius)
                for q, up, bound, me, key in zip(asked[lo : lo + 1024], upper, *(rows.column(c).to_pylist() for c in ("bound", "vec_id", "query_key")), strict=True):
                    scores, found = tree.search(q, up, k, -math.inf if bound is None else bound, me)
                    out += [(me, key, int(v), int(s)) for v, s in zip(found, scores, strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "query_key", "vec_id", "score"])

    return run


def _reached(queries: pa.Table, balls: pa.Table) -> pa.Table:
    """The queries of a block with each shard of a block whose outer ball reaches their bound, their own apart."""
    parts = []
    if queries.num_rows and balls.num_rows:
        asked, centre, radius = _matrix(queries.column("q")), _matrix(balls.column("centre")), np.array(balls.column("radius"))
        bound = np.array([-math.inf if b is None else b for b in queries.column("bound").to_pylist()])
        own = np.array(queries.column("home_cell")).astype(np.int64) << 32 | np.array(queries.column("home_part"))
        shard = np.array(balls.column("cell")).astype(np.int64) << 32 | np.array(balls.column("part"))
        for lo in range(0, len(asked), 512):
            rows = slice(lo, lo + 512)
            i, j = np.nonzero((_upper(asked[rows], centre, radius) >= bound[rows, None]) & (own[rows, None] != shard[None, :]))
            take = queries.take(pa.array(i + lo))
            parts.append(pa.table({c: take.column(c) for c in ("vec_id", "q", "query_key", "bound", "dim")} | {c: balls.column(c).take(pa.array(j)) for c in ("cell", "part")}))
    kinds = pa.schema([("vec_id", pa.int64()), ("q", pa.list_(pa.float64())), ("query_key", pa.int64()), ("bound", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int32())])
    return pa.concat_tables([kinds.empty_table(), *(p.cast(kinds) for p in parts)])


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, shard_rows: int = 8192, query_rows: int = 16384, most_pivots: int = 1024) -> DataFrame:
    """The k best rows of vectors(vec_id, embedding) for each row that is_query (a column) selects.

    Components become floor(scale * x); the score is the integer inner product (exact while it stays
    below 2**53). A query never finds rows of its own vec_id. Ties go to the smaller vec_id. Returns
    query_id, rank, vec_id, score. Rows with null ids, null vectors or null or non-finite components
    take no part; vectors meet only those of their own length; equal repeated queries are answered
    once and equal repeated rows are each found. Other columns are ignored.

    shard_rows: vectors of a tree; query_rows: queries of a task; most_pivots bounds the sample of
    vectors that cells lie around.
    """
    rows = vectors.where(F.expr(f"vec_id is not null and embedding is not null and {FINITE}")).select(
        F.col("vec_id").cast("long"),
        F.expr(f"transform(embedding, x -> cast(floor(cast(x as double) * {scale}D) as double))").alias("q"),
        is_query.alias("asks"),
    )
    rows = rows.withColumn("dim", F.size("q"))
    n = rows.count()
    pivots: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").select("dim", "q").limit(min(most_pivots, math.ceil(n / shard_rows))).collect():
        pivots.setdefault(r.dim, []).append(r.q)
    placed = rows.mapInArrow(kernels.giving_back(_place({d: np.array(p) for d, p in pivots.items()})), "vec_id long, q array<double>, asks boolean, dim int, cell int")
    placed = cut_lineage(placed, "placed")
    parts = placed.groupBy("dim", "cell").agg(F.expr(f"cast(ceil(count(*) / {float(shard_rows)}) as int)").alias("parts"))  # a row for each pivot at most
    shards = placed.withColumn("row", row_key()).join(parts, ["dim", "cell"]).withColumn("part", F.expr("cast(pmod(row, parts) as int)"))
    trees = cut_lineage(shards.select("vec_id", "q", *SHARD).groupBy(*SHARD).applyInArrow(kernels.giving_back(_build), TREES), "trees")
    asked = shards.where("asks").groupBy("vec_id", "q", "dim").agg(F.min(F.struct("cell", "part")).alias("home"))
    asked = cut_lineage(asked.select("vec_id", "q", "dim", F.xxhash64("vec_id", "q").alias("query_key"), F.col("home.cell").alias("home_cell"), F.col("home.part").alias("home_part")), "asked")

    start = asked.select("vec_id", "q", "query_key", F.lit(None).cast("long").alias("bound"), "dim", F.col("home_cell").alias("cell"), F.col("home_part").alias("part"))
    search = kernels.giving_back(_search(k))
    hits = cut_lineage(trees.select(*SHARD, "tree").groupBy(*SHARD).cogroup(start.groupBy(*SHARD)).applyInArrow(search, HITS), "hits")
    n_trees, n_asked = trees.count(), asked.count()
    if n_trees > 1:
        kth = hits.groupBy("query_key", "query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound")).withColumnRenamed("query_id", "vec_id")
        blocks, groups = max(1, -(-n_asked // query_rows)), -(-n_trees // 4096)
        spread = lambda m: F.explode(F.expr(f"sequence(0, {m - 1})"))
        opened = asked.join(kth, ["query_key", "vec_id"], "left").withColumn("block", F.expr(f"cast(pmod(query_key, {blocks}) as int)")).withColumn("ball_group", spread(groups))
        balls = trees.select(*SHARD, "centre", "radius").withColumn("ball_group", F.expr(f"cast(pmod(xxhash64(cell, part), {groups}) as int)")).withColumn("block", spread(blocks))
        of = ["dim", "block", "ball_group"]
        pairs = opened.groupBy(*of).cogroup(balls.groupBy(*of)).applyInArrow(kernels.giving_back(_reached), "vec_id long, q array<double>, query_key long, bound long, dim int, cell int, part int")
        pairs = cut_lineage(pairs, "reached")
        crowds = pairs.groupBy(*SHARD).agg(F.expr(f"cast(ceil(count(*) / {float(query_rows)}) as int)").alias("crowds"))
        sent = pairs.join(crowds, SHARD).withColumn("crowd", F.expr("cast(pmod(query_key, crowds) as int)"))
        copied = trees.select(*SHARD, "tree").join(crowds, SHARD).withColumn("crowd", F.explode(F.expr("sequence(0, crowds - 1)")))
        hits = hits.union(copied.select(*SHARD, "crowd", "tree").groupBy(*SHARD, "crowd").cogroup(sent.groupBy(*SHARD, "crowd")).applyInArrow(search, HITS))
    best = Window.partitionBy("query_key", "query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
