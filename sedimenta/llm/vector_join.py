"""Embedding near-dedup: an exact metric range join over pivot cells.

Equal vectors of a label are joined first and carry their count. Each distinct vector, scaled to unit
length, lies in the cell of its nearest pivot. For chord distance r, y of cell j meets a vector of cell i
only if d(y, p_i) - d(y, p_j) <= 2r (triangle inequality) and y.p_j - y.p_i <= r |p_j - p_i| (the pivots'
bisector); other pairs are not multiplied. Cells are laid into blocks as large as a task holds, and two blocks
meet in one task, in rounds: in each a vector is sent twice at most, and what a round sent goes before the next,
so that disk follows the table while work may be quadratic. A task counts links and returns a spanning forest
of them, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, drop_shuffles
from .components import connected_components, unite

FINITE = "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(values.flatten(), dtype=np.float64).reshape(len(values), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _assign(pivots: dict):
    """Rows with their cell."""

    def run(batches):
        for batch in batches:
            label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            cells = np.zeros(len(label), np.int64)
            order = np.lexsort((dim, label))
            first = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0] | np.r_[True, np.diff(dim[order]) != 0]) if len(order) else order
            for lo, hi in zip(first, np.r_[first[1:], len(order)], strict=True):
                at = order[lo:hi]
                own = pivots.get((int(label[at[0]]), int(dim[at[0]])))
                if own is not None:
                    cells[at] = (_unit(batch.column("embedding").take(pa.array(at))) @ own.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    return run


class _Side:
    """Rows of a block by cell: unit vectors, and where each cell begins."""

    def __init__(self, t: pa.Table, own: np.ndarray | None):
        cell = t.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        self.x, self.cell = _unit(t.column("embedding").take(pa.array(order))), cell[order]
        self.short = self.x.astype(np.float32)
        self.copies, self.key, self.rep = (t.column(c).to_numpy()[order] for c in ("copies", "key", "rep"))
        self.first = np.flatnonzero(np.r_[True, np.diff(self.cell) != 0])
        self.top = np.einsum("ij,ij->i", self.x, own[self.cell]) if own is not None else None

    def reach(self, pivot: int, own: np.ndarray, begin: int, radius: float) -> np.ndarray:
        """Rows from `begin` on that may have a partner in the cell of a pivot."""
        near, top = self.x[begin:] @ own[pivot], self.top[begin:]
        apart = np.sqrt(np.maximum(0, 2 - 2 * own @ own[pivot]))[self.cell[begin:]]
        d = np.sqrt(np.maximum(0, 2 - 2 * near)) - np.sqrt(np.maximum(0, 2 - 2 * top))
        return begin + np.flatnonzero((self.cell[begin:] == pivot) | (top - near <= radius * apart + 1e-9) & (d <= 2 * radius + 1e-9))


def _join(pivots: dict, threshold: float, radius: float):
    """Links within a block, between two blocks, or of each of a bin of small blocks: counts and a forest for the rows that have any."""

    def block(t: pa.Table) -> pa.Table:
        own = pivots.get((t.column("label")[0].as_py(), t.column("dim")[0].as_py()))
        late = t.column("late").to_numpy(zero_copy_only=False)
        one = not late.any()
        a = _Side(t if one else t.filter(pa.array(~late)), own)
        b = a if one else _Side(t.filter(pa.array(late)), own)
        n = len(a.x)
        margin = 1e-6 + 1.2e-7 * a.x.shape[1]  # what single precision may lose
        counts = [np.zeros(n, np.int64), np.zeros(len(b.x), np.int64)]
        parent = np.arange(n if one else n + len(b.x))
        for lo, hi in zip(a.first, np.r_[a.first[1:], n], strict=True):
            begin = hi if one else 0
            other = b.reach(a.cell[lo], own, begin, radius) if own is not None else np.arange(begin, len(b.x))
            for row in range(lo, hi, 512):
                rows = np.arange(row, min(row + 512, hi))
                right = np.r_[rows[0] : hi, other] if one else other
                for at in range(0, len(right), 4096):
                    some = right[at : at + 4096]
                    i, j = np.nonzero(a.short[rows] @ b.short[some].T >= threshold - margin)
                    if len(i) > len(rows) * len(some) // 64:
                        i, j = np.nonzero(a.x[rows] @ b.x[some].T >= threshold)
                        i, j = rows[i], some[j]
                    else:
                        i, j = rows[i], some[j]
                        true = np.einsum("ij,ij->i", a.x[i], b.x[j]) >= threshold
                        i, j = i[true], j[true]
                    if one:  # each pair once
                        i, j = i[i < j], j[i < j]
                    if len(i):
                        counts[0] += np.bincount(i, b.copies[j], n).astype(np.int64)
                        counts[1] += np.bincount(j, a.copies[i], len(b.x)).astype(np.int64)
                        parent = unite(parent, i, j if one else n + j)
        key, rep, links = (a.key, a.rep, counts[0] + counts[1]) if one else (np.r_[a.key, b.key], np.r_[a.rep, b.rep], np.r_[counts[0], counts[1]])
        keep = (links > 0) | (parent != np.arange(len(parent)))
        return pa.table({"key": key[keep], "links": links[keep], "rep": rep[keep], "root": rep[parent][keep]})

    def run(t: pa.Table) -> pa.Table:
        of = [t.column(c).to_numpy() for c in ("label", "dim")]
        order = np.lexsort(of)
        first = np.flatnonzero(np.r_[True, np.diff(of[0][order]) != 0] | np.r_[True, np.diff(of[1][order]) != 0])
        if len(first) == 1:
            return block(t)
        t = t.take(pa.array(order)).combine_chunks()
        return pa.concat_tables(block(t.slice(lo, hi - lo)) for lo, hi in zip(first, np.r_[first[1:], len(order)], strict=True))

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, cell_rows: int = 2048, most_pivots: int = 4096, block_values: int = 1 << 21) -> DataFrame:
    """Links between rows of vectors(vec_id, embedding, label) of equal label whose cosine reaches the threshold.

    Returns vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable,
    itself included) and kept (vec_id = component_id), one row per row. Rows whose vec_id, label or
    vector is null, whose vector is empty or zero or holds null or non-finite components link with
    nothing, nor do vectors of different lengths. Equal rows link with each other; rows that share a
    vec_id have links of their own and one component. Other columns are ignored.

    Pivots are a bounded sample of the distinct vectors (most_pivots), one for cell_rows of them; a task
    holds two blocks of about block_values components each.
    """
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    plain = F.expr(f"transform(cast(embedding as array<{kind}>), x -> cast(x + 0 as {kind}))")  # no negative zeros
    rows = vectors.select(F.col("vec_id").cast("long"), plain.alias("embedding"), F.col("label").cast("long"))
    valid = F.expr(f"vec_id is not null and label is not null and embedding is not null and {FINITE} and exists(embedding, x -> x != 0)")
    rows = rows.withColumn("valid", F.coalesce(valid, F.lit(False)))
    distinct = rows.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    distinct = distinct.withColumn("dim", F.size("embedding").cast("long")).withColumn("key", F.monotonically_increasing_id())
    distinct = cut_lineage(distinct, "vectors")  # keys are as written
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("rep", F.lit(7))).limit(min(most_pivots, math.ceil(n / cell_rows))).collect()
    groups: dict = {}
    for r in sample:
        groups.setdefault((r.label, r.dim), []).append(r.embedding)
    pivots = {key: _unit(pa.array(p, pa.list_(pa.float64()))) for key, p in groups.items()}

    radius = math.sqrt(2 - 2 * threshold)
    of = ["label", "dim"]
    cells = distinct.mapInArrow(_assign(pivots), f"label long, embedding array<{kind}>, rep long, copies long, dim long, key long, cell long")
    sizes = cut_lineage(cells.groupBy(*of, "cell").count(), "cells")
    # cells in order fill blocks; a cell larger than a block is cut by its keys; labels of one block share bins, so that many labels are no more tasks than few
    most = F.greatest(F.lit(2 * cell_rows), F.floor(F.lit(block_values) / F.col("dim")))
    before = F.sum("count").over(Window.partitionBy(*of).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    whole = sizes.groupBy(*of).agg(F.sum("count").alias("held"))
    placed = sizes.join(whole, of).where("held > 1").withColumn("blocks", F.ceil(F.col("held") / most)).withColumn("begin", F.coalesce(before, F.lit(0)))
    placed = placed.withColumn("parts", F.ceil(F.col("count") / most)).withColumn("bin", F.expr(f"if(blocks > 1, null, pmod(xxhash64(label, dim), greatest(1, cast(ceil({n} * dim / {block_values}) as bigint))))"))
    placed = placed.select(*of, "cell", "blocks", "begin", "count", "bin", "parts")
    place = F.expr("cast(least(blocks - 1, floor((begin + if(parts > 1, count * pmod(xxhash64(key), 65536) / 65536, count / 2)) * blocks / held)) as int)")
    placed = cut_lineage(placed.join(whole, of), "placed")
    cells = cells.join(placed, [*of, "cell"]).withColumn("block", place)
    rounds = (placed.agg(F.max("blocks")).first()[0] or 0) // 2 + 1
    found = spark.createDataFrame([], "key long, links long, rep long, root long")
    for turn in range(rounds):
        # blocks b and b + turn meet, each pair once
        ahead = F.expr(f"array(struct(block as block_a, cast(pmod(block + {turn}, blocks) as int) as block_b, false as late))")
        behind = F.expr(f"array(struct(cast(pmod(block - {turn}, blocks) as int) as block_a, block as block_b, true as late))") if turn else F.expr("cast(array() as array<struct<block_a: int, block_b: int, late: boolean>>)")
        jobs = cells.where(F.lit(turn) <= F.floor(F.col("blocks") / 2)).withColumn("job", F.explode(F.concat(ahead, behind))).select("bin", *of, "job.*", "key", "rep", "copies", "embedding", "cell")
        if turn:
            jobs = jobs.where(F.expr(f"2 * {turn} < blocks or block_a < block_b"))
        own = [F.expr(f"if(bin is null, {c}, null)").alias(f"own_{c}") for c in of]
        met = jobs.select("*", *own).groupBy("bin", *(f"own_{c}" for c in of), "block_a", "block_b").applyInArrow(_join(pivots, threshold, radius), "key long, links long, rep long, root long")
        found = found.unionByName(cut_lineage(met, "found"))
        del met, jobs
        drop_shuffles(spark)

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    digest = [F.xxhash64("label", "embedding"), F.xxhash64(F.lit(1), "embedding", "label")]  # 128 bits in place of the vector
    named = lambda df, *columns: df.select(*columns, *(d.alias(f"digest_{i}") for i, d in enumerate(digest)))
    out = named(rows.where("valid"), "vec_id").join(named(distinct, "key", "rep", "copies"), ["digest_0", "digest_1"]).join(links, "key", "left")
    out = cut_lineage(out.select("vec_id", "rep", "copies", "links"), "linked")
    # a vec_id of several vectors joins their components
    several = out.groupBy("vec_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("vec_id")
    ties = out.join(several, "vec_id", "left_semi").select("rep", F.col("vec_id").alias("root"))
    component = connected_components(found.select("rep", "root").union(ties), "rep", "root").withColumnRenamed("node", "rep")
    out = out.join(component, "rep", "left")
    linked = out.select(
        "vec_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
