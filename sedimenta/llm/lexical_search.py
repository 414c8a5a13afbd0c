"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

The index is a table: a row for each term of each shard of documents, with postings (gaps of places and counts,
packed in blocks of 64 that can be read one by one) and, beside them, what bounds each block's best impact: its
(count, document length) pairs that no other pair of the block beats in both. A row with an empty term holds the
shard's documents.

A query's lists are sorted by the bound of their whole list. Those whose bounds together stay below the k-th score
so far are not essential: only documents of the other lists are candidates. Candidates go through the non-essential
lists from the largest bound down; the maximum of the block that would hold them rejects them before that block is
read. Heaps of shards are merged at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .common import cut_lineage, scanned
from .kernels import Vocabulary

#: Terms are runs of ASCII letters and digits and of bytes beyond ASCII, only A-Z lower-cased.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LOWER = bytes(range(256)).lower()
#: Postings of a block.
BLOCK = 64
INDEX = "shard long, term binary, n long, total long, postings binary, blocks binary, bounds binary"
HITS = "item_id long, doc_id long, score long"
#: The columns of an index row of documents: ids, whether an id is null, lengths.
DOCUMENTS = b""


def terms_of(text: str) -> Iterator[list[bytes]]:
    """All terms of a text in order, part by part."""
    for part in kernels.pieces_of(text, 1 << 20):  # cut before a space, so that no term is cut
        yield TERM.findall(part.encode("utf-8", "surrogatepass").translate(_LOWER))


def _packed(values: np.ndarray, at: np.ndarray, width: np.ndarray, out: np.ndarray) -> None:
    """Write each value to out[at : at + width], low byte first."""
    for k in range(4):
        wide = width > k
        out[at[wide] + k] = values[wide] >> (8 * k) & 255


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 256, 1, np.where(most < 65536, 2, 4))


def _binary(ends: np.ndarray, flat: np.ndarray) -> pa.Array:
    """Slices of flat bytes that end at `ends`, as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _index_rows(shard: int, doc_ids: list, lengths: np.ndarray, terms: list[np.ndarray], known: Vocabulary) -> pa.RecordBatch:
    """Index rows of one shard; terms: each document's term numbers."""
    docs = len(doc_ids)
    key, tf = np.unique(np.concatenate(terms) * docs + np.repeat(np.arange(docs), lengths), return_counts=True)
    term, doc = np.divmod(key, docs)
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    size = np.diff(np.r_[first, len(key)])
    gap = doc - np.r_[-1, doc[:-1]]
    gap[first] = doc[first] + 1
    rank = np.arange(len(key)) - np.repeat(first, size)
    head = np.flatnonzero(rank % BLOCK == 0)
    count = np.diff(np.r_[head, len(key)])
    block = np.repeat(np.arange(len(head)), count)
    gap_width, tf_width = _width(np.maximum.reduceat(gap, head)), _width(np.maximum.reduceat(tf, head))
    # a block: one byte with both widths, gaps, counts
    nbytes = 1 + count * (gap_width + tf_width)
    at = np.cumsum(nbytes) - nbytes
    flat = np.zeros(int(nbytes.sum()), np.uint8)
    flat[at] = gap_width + 16 * tf_width
    place = rank % BLOCK
    _packed(gap, at[block] + 1 + place * gap_width[block], gap_width[block], flat)
    _packed(tf, at[block] + 1 + (count * gap_width)[block] + place * tf_width[block], tf_width[block], flat)
    blocks_of = -(-size // BLOCK)
    block_ends = np.cumsum(blocks_of)
    own_term = np.repeat(np.arange(len(first)), blocks_of)
    many = blocks_of > 1
    base = at[block_ends - blocks_of]
    shape = np.stack([doc[head + count - 1], at - base[own_term]], 1)[many[own_term]]
    # pairs of a block in order of falling counts stay while lengths fall
    inside = np.flatnonzero(np.repeat(many, size))
    order = inside[np.lexsort((lengths[doc[inside]], -tf[inside], block[inside]))]
    n = lengths[doc[order]]
    far = int(lengths.max(initial=0)) + 1
    low = np.minimum.accumulate(n - block[order] * far) if len(order) else n
    best = np.r_[True, (low[1:] < low[:-1])] if len(order) else np.zeros(0, bool)
    pairs = order[best]
    own_block = block[pairs] - (block_ends - blocks_of)[own_term[block[pairs]]]
    bounds = np.stack([own_block, tf[pairs], lengths[doc[pairs]]], 1)
    pair_ends = np.cumsum(np.bincount(own_term[block[pairs]], minlength=len(first)))
    names = list(known)
    nulls = np.array([d is None for d in doc_ids])
    own = np.array([0 if d is None else d for d in doc_ids], np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(first) + 1, shard)),
            pa.array([DOCUMENTS, *(names[t] for t in term[first].tolist())], pa.binary()),
            pa.array(np.r_[docs, size]),
            pa.array(np.r_[lengths.sum(), np.add.reduceat(tf, first)]),
            pa.concat_arrays([pa.array([own.tobytes()], pa.binary()), _binary(np.cumsum(np.add.reduceat(nbytes, block_ends - blocks_of)), flat)]),
            pa.concat_arrays([pa.array([nulls.tobytes()], pa.binary()), _binary(8 * np.cumsum(np.where(many, blocks_of, 0)), shape.astype("<i4").reshape(-1).view(np.uint8))]),
            pa.concat_arrays([pa.array([lengths.astype("<i4").tobytes()], pa.binary()), _binary(12 * pair_ends, bounds.astype("<i4").reshape(-1).view(np.uint8))]),
        ],
        names=[c.split()[0] for c in INDEX.split(", ")],
    )


def build_index(docs: DataFrame, shard_bytes: int = 16 << 20) -> DataFrame:
    """The inverted index of documents(doc_id, text): a table in the shared folder, columns as in INDEX.

    Shards are consecutive rows of a scan split, of about shard_bytes of text; no text is shuffled. Documents without
    a term (null texts among them) are not in it. Repeated rows and null doc_ids are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 33
        ids, lengths, terms, known, held = [], [], [], Vocabulary(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = np.concatenate([known.ids(found) for found in terms_of(text or "")])
                if not len(own):
                    continue
                ids.append(doc_id)
                lengths.append(len(own))
                terms.append(own)
                held += len(text)
                if held >= shard_bytes:
                    yield _index_rows(shard, ids, np.array(lengths), terms, known)
                    shard += 1
                    ids, lengths, terms, known, held = [], [], [], Vocabulary(), 0
        if ids:
            yield _index_rows(shard, ids, np.array(lengths), terms, known)

    rows = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return cut_lineage(rows.mapInArrow(kernels.giving_back(run), INDEX), "lexical-index")


class PostingList:
    """One term's postings in a shard: bounds of its blocks, and documents and scores of the blocks read so far."""

    def __init__(self, weight: int, n: int, postings: bytes, blocks: bytes, bounds: bytes, impact, lengths: np.ndarray):
        self.weight, self.raw, self.impact, self.lengths = weight, postings, impact, lengths
        count = -(-n // BLOCK)
        self.first = np.arange(count + 1) * BLOCK
        self.first[-1] = n
        self.read = np.zeros(count, bool)
        self.scores = np.zeros(n, np.int64)
        if count == 1:
            self.at, self.docs = np.zeros(1, np.int64), np.zeros(n, np.int64)
            self.need(np.zeros(1, np.int64))
            self.last, self.best = self.docs[-1:], np.array([self.scores.max()])
        else:
            self.last, self.at = np.frombuffer(blocks, "<i4").reshape(-1, 2).T.astype(np.int64)
            self.docs = np.repeat(self.last, np.diff(self.first))
            block, tf, length = np.frombuffer(bounds, "<i4").reshape(-1, 3).T.astype(np.int64)
            self.best = weight * np.maximum.reduceat(impact(tf, length), np.searchsorted(block, np.arange(count)))
        self.bound = int(self.best.max())

    def need(self, blocks: np.ndarray) -> None:
        """Read those of the blocks that were not read yet."""
        for b in blocks[~self.read[blocks]].tolist():
            lo, hi = int(self.first[b]), int(self.first[b + 1])
            at, n = int(self.at[b]), hi - lo
            gap_width, tf_width = self.raw[at] & 15, self.raw[at] >> 4
            gaps = np.frombuffer(self.raw, f"<u{gap_width}", n, at + 1)
            tf = np.frombuffer(self.raw, f"<u{tf_width}", n, at + 1 + n * gap_width).astype(np.int64)
            self.docs[lo:hi] = np.cumsum(gaps, dtype=np.int64) + (self.last[b - 1] if b else -1)
            self.scores[lo:hi] = self.weight * self.impact(tf, self.lengths[self.docs[lo:hi]])
            self.read[b] = True

    def within(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from low to high - 1 and their scores."""
        b0, b1 = np.searchsorted(self.last, (low, high - 1))
        self.need(np.arange(b0, min(b1 + 1, len(self.last))))
        lo, hi = np.searchsorted(self.docs, (low, high))
        return self.docs[lo:hi], self.scores[lo:hi]


class Best:
    """The k best documents so far: highest scores, equal ones by rank."""

    def __init__(self, k: int, rank: np.ndarray):
        self.k, self.rank, self.docs, self.scores = k, rank, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """The score below which a document cannot come in."""
        return int(self.scores[-1]) if len(self.docs) == self.k else 1

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = np.r_[self.docs, docs], np.r_[self.scores, scores]
        order = np.lexsort((self.rank[docs], -scores))[: self.k]
        self.docs, self.scores = docs[order], scores[order]


def block_max_maxscore(lists: list[PostingList], n_docs: int, best: Best, window: int = 2048) -> Best:
    """The best documents by the sum of their scores in the lists; documents are numbers from 0 to n_docs - 1."""
    lists = sorted(lists, key=lambda x: x.bound)
    below = np.cumsum([0, *(x.bound for x in lists)])  # below[i]: the most that lists before i can add
    low, high = 0, window // 4
    while low < n_docs:
        high = min(high, n_docs)
        essential = int(np.searchsorted(below[1:], best.least))
        if essential == len(lists):
            break
        sums = np.zeros(high - low, np.int64)
        for x in lists[essential:]:
            docs, scores = x.within(low, high)
            sums[docs - low] += scores
        found = np.flatnonzero(sums)
        sums, found = sums[found], found + low
        for i in range(essential - 1, -1, -1):
            x = lists[i]
            alive = sums + below[i + 1] >= best.least
            sums, found = sums[alive], found[alive]
            block = np.searchsorted(x.last, found)
            inside = block < len(x.last)
            block = np.minimum(block, len(x.last) - 1)
            alive = sums + np.where(inside, x.best[block], 0) + below[i] >= best.least
            sums, found, block, inside = sums[alive], found[alive], block[alive], inside[alive]
            if not len(found):
                break
            x.need(np.unique(block[inside]))
            place = np.minimum(np.searchsorted(x.docs, found), len(x.docs) - 1)
            sums = sums + np.where(inside & (x.docs[place] == found), x.scores[place], 0)
        alive = sums >= best.least
        best.add(found[alive], sums[alive])
        low, high = high, high + window
    return best


def _search_shard(n: int, total: int, k: int):
    """The k best documents of a shard for each item of a block of items."""

    def impact(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 20 * (50 + 50 * length * n // total))

    def run(t: pa.Table) -> pa.Table:
        rows = {c: t.column(c).to_pylist() for c in ("term", "n", "weight", "items", "postings", "blocks", "bounds")}
        d = rows["term"].index(DOCUMENTS)
        doc_ids, nulls = np.frombuffer(rows["postings"][d], np.int64), np.frombuffer(rows["blocks"][d], bool)
        lengths = np.frombuffer(rows["bounds"][d], "<i4").astype(np.int64)
        rank = np.empty(len(doc_ids), np.int64)
        rank[np.lexsort((doc_ids, nulls))] = np.arange(len(doc_ids))
        queries = {}
        for i, items in enumerate(rows["items"]):
            if i != d:
                own = PostingList(rows["weight"][i], rows["n"][i], rows["postings"][i], rows["blocks"][i], rows["bounds"][i], impact, lengths)
                for item in items:
                    queries.setdefault(item["item_id"], []).append(own)
        ids, docs, scores = [], [], []
        for item, lists in queries.items():
            best = block_max_maxscore(lists, len(doc_ids), Best(k, rank))
            ids += [item] * len(best.docs)
            docs.append(best.docs)
            scores.append(best.scores)
        docs = np.concatenate([*docs, np.zeros(0, np.int64)])
        return pa.table({"item_id": pa.array(ids, pa.int64()), "doc_id": pa.array(doc_ids[docs], mask=nulls[docs]), "score": pa.array(np.concatenate([*scores, np.zeros(0, np.int64)]))})

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = set().union(*terms_of(text or ""))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(sorted(found), pa.binary())], names=["item_id", "term"])


def search(index: DataFrame, items: DataFrame, k: int = 50, items_at_once: int = 1024, shards_at_once: int = 64) -> DataFrame:
    """The k best documents of an index for each of items(item_id, text): item_id, rank (from 1), doc_id, score.

    N documents with a term have L terms in all; df of them hold a term, tf times in one of n terms. A term's weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))); a document scores weight * (10**9 tf div (1000 tf + 20 m)) for each term of
    the item, with m = 50 + 50 n N div L. Scores above 0 rank highest first, equal ones by doc_id, null doc_ids last.

    Rows that share an item_id (a null one too) are one item with the terms of all; items without terms have no rows.
    Each block of about items_at_once items meets the rows of its terms in groups of shards_at_once shards, so that a
    term found in every shard is spread; a shard's postings of those terms and its documents are searched by one task.
    """
    documents, none = F.col("term") == F.lit(DOCUMENTS), F.lit(b"")
    shards, n, total = index.where(documents).agg(F.count("*"), F.sum("n"), F.sum("total")).first()
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_terms, "item_id long, term binary").distinct()
    asked = cut_lineage(asked, "item-terms")
    blocks = max(1, -(-asked.select("item_id").distinct().count() // items_at_once))
    held = index.select("term", "n").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n or 0).cast("long") + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = held.select("term", weight.alias("weight")).where("weight > 0")
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    wanted = asked.join(weights, "term").groupBy(block.alias("items_block"), "term").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("item_id")).alias("items"))
    every = wanted.select("items_block").distinct().select("items_block", none.alias("term"), F.lit(0).cast("long").alias("weight"), F.array().cast("array<struct<item_id: long>>").alias("items"))
    groups = max(1, -(-shards // shards_at_once))
    spread = wanted.unionByName(every).withColumn("shards_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    rows = index.withColumn("shards_group", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int")).join(spread, ["term", "shards_group"])
    hits = rows.groupBy("shard", "items_block").applyInArrow(kernels.giving_back(_search_shard(n or 0, total or 1, k)), HITS)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
