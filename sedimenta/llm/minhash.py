"""MinHash near-dedup with ProbMinHash signatures of weighted word shingles.

Every distinct shingle of a document emits a Poisson process of arrivals whose rate is its weight;
each arrival falls in one signature slot, and the first arrival of a slot names its shingle. Shingles
stop as soon as their next arrival is later than every slot's first. Two documents agree in a slot
with the probability Jaccard similarity of their weights. Bands of slots propose candidates, and the
exact probability Jaccard of whole texts decides.

Texts of equal words are one class from the start. Members of a bucket whose signatures come near
form families: first those near its smallest member, then, in buckets that still hold several
families, those near any other member, in blocks inside tasks. Each family is compared text by text
inside tasks, in blocks if it is large, and only a spanning forest of its links comes out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import cut_lineage
from .components import connected_components, unite
from .kernels import U8, giving_back, mix

SIGNATURES = "doc_id long, word_key binary, n_bytes long, marks binary, bands array<long>"


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Distinct shingles of the texts: text index, hash and weight (1 + ln count); and a key of each text's words.

    Shorter texts have one shingle, all their words; texts without words have none and no key.
    """
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
    starts = np.cumsum(sizes) - sizes
    word, _, doc = kernels.words(np.frombuffer(b"".join(raws), dtype=np.uint8), starts)
    n = np.bincount(doc, minlength=len(texts))
    at = np.cumsum(n) - n
    place = np.arange(len(word)) - at[doc]
    keys: list[bytes | None] = [None] * len(texts)
    has = np.flatnonzero(n)
    if not len(has):
        return np.zeros(0, np.int64), np.zeros(0, U8), np.zeros(0), keys
    a = np.add.reduceat(mix(word + place.astype(U8) * U8(0xA0761D6478BD642F)), at[has])
    b = np.add.reduceat(mix(word ^ mix(place.astype(U8) + U8(1))), at[has])
    for i, x, y in zip(has.tolist(), mix(a), mix(b + n[has].astype(U8)), strict=True):
        keys[i] = x.tobytes() + y.tobytes()
    code = np.zeros(len(word), dtype=U8)
    inside = np.minimum(n[doc], size)
    for k in range(size):
        ok = k < inside
        code = code * U8(0xE7037ED1A0B428DB) + np.where(ok, mix(np.r_[word[k:], np.zeros(min(k, len(word)), U8)] + U8(k)), U8(0))
        code = code ^ (code >> U8(29))
    whole = place + inside <= n[doc]
    code, doc = mix(code[whole]), doc[whole]
    _, first, count = np.unique(mix(code ^ mix(doc.astype(U8) + U8(1))), return_index=True, return_counts=True)
    return doc[first], code[first], 1 + np.log(count), keys


def prob_min_hash(doc: np.ndarray, code: np.ndarray, weight: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """Signatures (docs x slots) of elements (doc, code, weight); a document without elements gets zeros."""
    best = np.full((docs, slots), np.inf)
    out = np.zeros((docs, slots), dtype=U8)
    total = np.bincount(doc, weights=weight, minlength=docs)
    horizon = np.where(total > 0, slots * (math.log(slots) + 3) / np.maximum(total, 1e-300), 0)
    active = np.arange(len(doc))
    while len(active):
        d, h, w = doc[active], code[active], weight[active]
        t = np.zeros(len(active))
        seed = h
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(d):
            seed = mix(seed + U8(0x9E3779B97F4A7C15))
            u = ((seed >> U8(11)).astype(np.float64) + 0.5) * 2.0**-53
            t = t - np.log(u) / w
            worst = np.minimum(best.max(axis=1), horizon)
            early = t <= worst[d]
            d, h, w, t, seed = d[early], h[early], w[early], t[early], seed[early]
            slot = (mix(seed ^ U8(0x2545F4914F6CDD1D)) % U8(slots)).astype(np.int64)
            cell = d * slots + slot
            np.minimum.at(best.reshape(-1), cell, t)
            found.append((cell, t, h))
        for cell, when, h in found:
            won = best.reshape(-1)[cell] == when
            out.reshape(-1)[cell[won]] = h[won]
        short = (total > 0) & np.isinf(best).any(axis=1)  # too short a horizon: once more with a longer one
        best[short] = np.inf
        horizon[short] *= 3
        active = active[short[doc[active]]]
    return out


def probability_jaccard(x: dict | tuple, y: dict | tuple) -> float:
    """Exact probability Jaccard of two weighted sets, each (sorted codes, weights)."""
    (a, wa), (b, wb) = x, y
    every = np.union1d(a, b)
    p, q = np.zeros(len(every)), np.zeros(len(every))
    p[np.searchsorted(every, a)], q[np.searchsorted(every, b)] = wa, wb
    both = (p > 0) & (q > 0)
    if not both.any():
        return 0.0
    ratio = np.divide(p, q, out=np.full(len(p), np.inf), where=q > 0)
    order = np.argsort(ratio)
    r, p, q = ratio[order], p[order], q[order]
    at = np.searchsorted(r, r)  # elements of a smaller ratio
    above = p.sum() - np.r_[0, np.cumsum(p)][at]
    below = np.r_[0, np.cumsum(q)][at]
    both = both[order]
    return float((1 / (above[both] / p[both] + below[both] / q[both])).sum())


def _batches(texts: list[str]) -> Iterator[range]:
    lo = held = 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t) > kernels.BATCH:
            yield range(lo, i)
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield range(lo, len(texts))


def _sign(size: int, bands: int, rows: int):
    """A key of the words, one byte of each signature slot and the band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in _batches(texts):
                own = [texts[i] for i in part]
                doc, code, weight, keys = shingles(own, size)
                slots = prob_min_hash(doc, code, weight, len(part), bands * rows)
                band = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U8)), (len(part), bands))
                for k in range(rows):
                    band = mix(band * U8(0xD6E8FEB86659FD93) + slots[:, k::rows])
                marks = slots.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.start, len(part)),
                        pa.array(keys, pa.binary()),
                        pa.array([len(t) for t in own], pa.int64()),
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                        pa.array(list(band.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "word_key", "n_bytes", "marks", "bands"],
                )

    return run


def _near(least: float):
    """The pairs (hub, member) that agree in a share of slots of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("hub_marks", "marks"))
                keep = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("hub").filter(keep), batch.column("member").filter(keep)], names=["hub", "member"])

    return run


def _settle(least: float, rows: int = 256):
    """Links that make one family of those with members near each other in a bucket, left members against all."""

    def run(t: pa.Table) -> pa.Table:
        bucket, family, left = (np.array(t.column(c)) for c in ("bucket", "family", "is_left"))
        marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(len(bucket), -1)
        order = np.lexsort((left, bucket))
        bucket, left, marks = bucket[order], left[order], np.ascontiguousarray(marks[order].T)
        ids, of = np.unique(family[order], return_inverse=True)
        parent, enough = np.arange(len(ids)), math.ceil(least * len(marks) - 1e-9)
        ends = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            mid = lo + int((~left[lo:hi]).sum())
            for at in range(mid, hi, rows):
                own = slice(at, min(at + rows, hi))
                same = np.zeros((own.stop - at, mid - lo), np.min_scalar_type(len(marks)))
                for slot in marks:
                    same += slot[own, None] == slot[None, lo:mid]
                i, j = np.nonzero(same >= enough)
                i, j = of[at + i], of[lo + j]
                parent = unite(parent, i[i != j], j[i != j])
        keep = parent != np.arange(len(ids))
        return pa.table({"a": ids[keep], "b": ids[parent][keep]})

    return run


class _Sets:
    """Weighted shingle sets of the texts of one task."""

    def __init__(self, texts: list[str], size: int):
        code, weight = [np.zeros(0, U8)], [np.zeros(0)]
        count: list[np.ndarray] = []
        for part in _batches(texts):
            doc, c, w, _ = shingles([texts[i] for i in part], size)
            by = np.lexsort((c, doc))
            code.append(c[by])
            weight.append(w[by])
            count.append(np.bincount(doc, minlength=len(part)))
        self.n = np.concatenate(count)
        self.code, self.weight = np.concatenate(code), np.concatenate(weight)
        self.at = np.r_[0, np.cumsum(self.n)]
        self.even = np.array([self.n[i] > 0 and np.ptp(self.weight[self.at[i] : self.at[i + 1]]) == 0 for i in range(len(texts))], dtype=bool)

    def one(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.code[self.at[i] : self.at[i + 1]], self.weight[self.at[i] : self.at[i + 1]]

    def links(self, left: np.ndarray, right: np.ndarray, threshold: float, parent: np.ndarray) -> np.ndarray:
        """Unite documents of left and right that are similar enough."""
        rows = np.unique(np.r_[left, right])
        if len(rows) <= 6:
            for i in left.tolist():
                for j in right.tolist():
                    if i < j and parent[i] != parent[j] and probability_jaccard(self.one(i), self.one(j)) >= threshold:
                        parent = unite(parent, np.array([i]), np.array([j]))
            return parent
        parts = [self.one(i)[0] for i in rows]
        codes, column, found = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = found[column] > 1  # a shingle of one document is in no intersection
        place = np.cumsum(found > 1)[column][shared] - 1
        row = np.repeat(rows, self.n[rows])[shared]
        value = np.concatenate([np.sqrt(self.one(i)[1] / self.one(i)[1].sum()) for i in rows])[shared]
        by = np.argsort(place, kind="stable")
        place, row, value = place[by], row[by], value[by]
        to_left, to_right = np.full(len(self.n), -1), np.full(len(self.n), -1)
        to_left[left], to_right[right] = np.arange(len(left)), np.arange(len(right))
        inside, alike = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
        mixed = not self.even[rows].all()
        for lo in range(0, int(found.size and (found > 1).sum()), 2048):
            a, b = np.searchsorted(place, [lo, lo + 2048])
            pair = []
            for to in (to_left, to_right):
                mine = to[row[a:b]] >= 0
                x = np.zeros((len(left) if to is to_left else len(right), 2048), np.float32)
                x[to[row[a:b]][mine], place[a:b][mine] - lo] = value[a:b][mine] if mixed else 1
                pair.append(x)
            if mixed:
                alike += pair[0] @ pair[1].T  # an upper bound of the similarity
            inside += (pair[0] > 0).astype(np.float32) @ (pair[1] > 0).astype(np.float32).T if mixed else pair[0] @ pair[1].T
        both = self.even[left][:, None] & self.even[right][None, :]
        hit = both & (inside / np.maximum(self.n[left][:, None] + self.n[right][None, :] - inside.astype(np.float64), 1) >= threshold)
        i, j = np.nonzero(hit)
        parent = unite(parent, left[i], right[j])
        if mixed:
            for i, j in zip(*np.nonzero(~both & (alike >= threshold - 1e-4)), strict=True):
                x, y = left[i], right[j]
                if parent[x] != parent[y] and probability_jaccard(self.one(x), self.one(y)) >= threshold:
                    parent = unite(parent, np.array([x]), np.array([y]))
        return parent


def _verify(size: int, threshold: float):
    """A spanning forest of the links inside families, or between two blocks of one."""

    def run(t: pa.Table) -> pa.Table:
        ids, family, block = np.array(t.column("member")), np.array(t.column("family")), np.array(t.column("block"))
        a, b = t.column("block_a")[0].as_py(), t.column("block_b")[0].as_py()
        order = np.lexsort((ids, block, family))
        ids, family, block = ids[order], family[order], block[order]
        texts = t.column("text").take(pa.array(order)).to_pylist()
        sets, parent = _Sets(texts, size), np.arange(len(ids))
        ends = np.flatnonzero(np.r_[True, family[1:] != family[:-1], True])
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            rows = np.arange(lo, hi)
            parent = sets.links(rows[block[rows] == a], rows[block[rows] == b], threshold, parent)
        keep = parent != np.arange(len(ids))
        return pa.table({"a": ids[keep], "b": ids[parent][keep]})

    return run


def _between_families(spokes: DataFrame, families: DataFrame, marks: DataFrame, least: float, block_rows: int) -> DataFrame:
    """Links (a, b) of families that have members near each other in a bucket of spokes(bucket, member).

    The largest family of a bucket is not compared with itself; all others are compared with all members.
    """
    own = cut_lineage(spokes.join(families, "member", "left").select("bucket", "member", F.coalesce("family", "member").alias("family")), "own")
    sizes = own.groupBy("bucket", "family").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "family")).alias("most"), F.sum("n").alias("n"))
    blocks = F.expr(f"cast(ceil((n - most.n) / {float(block_rows)}) as int)").alias("lefts"), F.expr(f"cast(ceil(n / {float(block_rows)}) as int)").alias("alls")
    sizes = cut_lineage(sizes.where("n > most.n").select("bucket", "n", F.col("most.family").alias("most"), *blocks), "sizes")
    bins = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // (2 * block_rows)))
    held = own.join(sizes, "bucket").join(marks.withColumnRenamed("rep", "member"), "member")
    place = lambda n: F.expr(f"cast(pmod(xxhash64(member), {n}) as int)")
    spread = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    left = held.where("family != most").withColumn("is_left", F.lit(True)).withColumn("block_a", place("lefts")).withColumn("block_b", spread("alls"))
    right = held.withColumn("is_left", F.lit(False)).withColumn("block_b", place("alls")).withColumn("block_a", spread("lefts"))
    units = left.unionByName(right).withColumn("unit", F.expr(f"if(alls > 1, bucket, pmod(xxhash64(bucket), {bins}))"))
    units = units.select("unit", F.expr("if(alls > 1, block_a, -1)").alias("block_a"), "block_b", "bucket", "family", "is_left", "marks")
    return cut_lineage(units.groupBy("unit", "block_a", "block_b").applyInArrow(giving_back(_settle(least)), "a long, b long"), "between")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 24, band_rows: int = 4, block_bytes: int = 3 << 20, block_rows: int = 2048) -> DataFrame:
    """Classes of near copies among documents(doc_id, text): doc_id, component_id, kept; one row per row.

    Documents link when the probability Jaccard of their word shingles (weights 1 + ln count, `size`
    words, words split at ASCII white space, A-Z lower-cased) reaches the threshold. component_id is
    the smallest doc_id reachable by links, itself included; kept marks that document. A pair at the
    threshold escapes all bands with probability (1 - threshold ** band_rows) ** bands, 3e-6 here.

    block_bytes: text that a task gets, on average, from one block; block_rows: signatures, likewise. Texts shorter than `size` words
    are one shingle. Null texts and texts without words link with nothing. Rows that share a doc_id
    count as one document; rows with a null doc_id link with nothing and have null component_id and
    kept. Other columns are ignored; no group of any kind is capped.
    """
    slots = bands * band_rows
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    signed = cut_lineage(rows.mapInArrow(giving_back(_sign(size, bands, band_rows)), SIGNATURES), "signatures")
    usable = signed.where("doc_id is not null and word_key is not null")
    classes = usable.groupBy("word_key").agg(F.min("doc_id").alias("rep"), F.max("n_bytes").alias("n_bytes"), F.min("marks").alias("marks"), F.min("bands").alias("bands"))
    classes = cut_lineage(classes, "classes")

    buckets = cut_lineage(classes.select(F.explode("bands").alias("bucket"), "rep"), "buckets")
    hubs = buckets.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    spokes = cut_lineage(buckets.join(hubs, "bucket").where("rep != hub").select("bucket", "hub", F.col("rep").alias("member")), "spokes")
    stars = cut_lineage(spokes.select("hub", "member").distinct(), "stars")
    marks = classes.select("rep", "marks")
    signs = stars.join(marks.select(F.col("rep").alias("member"), "marks"), "member").join(marks.select(F.col("rep").alias("hub"), F.col("marks").alias("hub_marks")), "hub")
    least = threshold - 4 * math.sqrt(threshold * (1 - threshold) / slots)
    near = signs.mapInArrow(giving_back(_near(least)), "hub long, member long")
    families = connected_components(near, "hub", "member").select(F.col("node").alias("member"), F.col("component").alias("family"))
    more = _between_families(spokes, families, marks, least, block_rows)
    if more.first():
        every = families.select(F.col("member").alias("a"), F.col("family").alias("b")).union(more)
        families = connected_components(every, "a", "b").select(F.col("node").alias("member"), F.col("component").alias("family"))

    sized = families.join(classes.select(F.col("rep").alias("member"), "n_bytes"), "member")
    blocks = sized.groupBy("family").agg(F.sum("n_bytes").alias("all_bytes"))
    total = blocks.agg(F.sum("all_bytes")).first()[0] or 0
    bins = max(1, -(-total // block_bytes))
    blocks = blocks.select("family", F.expr(f"cast(ceil(all_bytes / {float(block_bytes)}) as int)").alias("blocks"))
    placed = families.join(blocks, "family").withColumn("block", F.expr("cast(pmod(xxhash64(member), blocks) as int)"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.withColumn("block_a", F.least("block", "other")).withColumn("block_b", F.greatest("block", "other"))
    placed = placed.withColumn("unit", F.expr(f"if(blocks > 1, family, pmod(xxhash64(family), {bins}) - {bins})"))
    placed = cut_lineage(placed.select("unit", "family", "block", "block_a", "block_b", "member"), "placed")
    texts = placed.join(rows.where("text is not null").withColumnRenamed("doc_id", "member"), "member")
    forest = texts.groupBy("unit", "block_a", "block_b").applyInArrow(giving_back(_verify(size, threshold)), "a long, b long")
    same_id = usable.join(classes.select("word_key", "rep"), "word_key").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    final = connected_components(forest.union(same_id), "a", "b")
    return (
        signed.select("doc_id")
        .join(final, F.col("doc_id") == F.col("node"), "left")
        .select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
