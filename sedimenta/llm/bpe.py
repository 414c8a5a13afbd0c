"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each distinct pre-token is encoded once per worker. Pairs wait in one bucket per merge rank, which
holds positions of a linked list; a bitmap of three levels marks the buckets in use, and
find-first-set steps down it to the next rank. A popped position whose pair has changed is stale and
skipped. Each merge costs a constant number of steps, so that pre-tokens of millions of bytes work.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import kernels


class RankQueue:
    """Positions by merge rank; the lowest rank first, and in it the leftmost position."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.bits: dict[int, int] = {}  # of ranks, by rank // 64
        self.over: dict[int, int] = {}  # of words of bits, by rank // 4096
        self.top = 0  # of words of over

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word, block = rank >> 6, rank >> 12
        self.bits[word] = self.bits.get(word, 0) | 1 << (rank & 63)
        self.over[block] = self.over.get(block, 0) | 1 << (word & 63)
        self.top |= 1 << block

    def pop(self) -> tuple[int, int]:
        block = (self.top & -self.top).bit_length() - 1
        marks = self.over[block]
        word = block << 6 | (marks & -marks).bit_length() - 1
        marks = self.bits[word]
        rank = word << 6 | (marks & -marks).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            self.bits[word] &= ~(1 << (rank & 63))
            if not self.bits[word]:
                self.over[block] &= ~(1 << (word & 63))
                if not self.over[block]:
                    self.top &= ~(1 << block)
        return rank, position


class BytePairEncoder:
    """Merges the bytes of one pre-token by rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def encode(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        after = list(range(1, n + 1))  # end of the token that starts here
        before = list(range(-1, n - 1))  # start of the token before the one that starts here
        waiting = [-1] * n  # rank of the token that starts here with the next one, if they merge
        queue = RankQueue()
        get = ranks.get
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                waiting[i] = rank
                queue.push(rank, i)
        while queue.top:
            rank, i = queue.pop()
            if waiting[i] != rank:
                continue  # stale
            gone = after[i]
            end = after[i] = after[gone]
            waiting[gone] = waiting[i] = -1
            if end < n:
                before[end] = i
                rank = get(piece[i : after[end]])
                if rank is not None:
                    waiting[i] = rank
                    queue.push(rank, i)
            left = before[i]
            if left >= 0:
                rank = get(piece[left:end])
                waiting[left] = -1
                if rank is not None:
                    waiting[left] = rank
                    queue.push(rank, left)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out


_loaded: dict = {}


def _load(path: str) -> tuple[BytePairEncoder, kernels.SpanTable, np.ndarray, np.ndarray, np.ndarray]:
    """The encoder of a rank file, what it has encoded, and each id's place and size in the flat bytes of all tokens."""
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        tokens = {rank: token for token, rank in ranks.items()}
        for rank, token in tokens.items():
            size[rank] = len(token)
        flat = np.frombuffer(b"".join(tokens[r] for r in sorted(tokens)), dtype=np.uint8)
        _loaded[path] = BytePairEncoder(ranks), kernels.SpanTable(), np.cumsum(size) - size, size, flat
    return _loaded[path]


def encode_column(df: DataFrame, ranks_path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add `out`: the ids of each whole text as little-endian unsigned 32-bit integers. Null text counts as empty."""
    if out in df.columns:
        df = df.drop(out)
    schema = StructType([*df.schema.fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known, *_ = _load(ranks_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                ids = kernels.encode_texts([t or "" for t in rows.column(text).to_pylist()], lambda p: encoder.encode(p.encode()), known)
                encoded = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, encoded], names=[*rows.schema.names, out])

    return df.mapInArrow(kernels.giving_back(run), schema)


def decode_column(df: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add `out`: the bytes that the ids stand for. Null ids give null."""
    if out in df.columns:
        df = df.drop(out)
    schema = StructType([*df.schema.fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, at, size, flat = _load(ranks_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                found = [None if x is None else np.frombuffer(x, dtype="<u4") for x in rows.column(ids).to_pylist()]
                decoded = [None if x is None else kernels.gather(at[x], size[x], flat).tobytes() for x in found]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(decoded, pa.binary())], names=[*rows.schema.names, out])

    return df.mapInArrow(kernels.giving_back(run), schema)


def encode_decode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, token_ids and decoded bytes of every whole text of documents(doc_id, text).

    Null and empty texts give no ids and no bytes; rows stay one for one, repeated or null doc_ids
    included; other columns are ignored; an empty table gives no rows.
    """
    return decode_column(encode_column(docs.select(F.col("doc_id").cast("long"), "text"), ranks_path).drop("text"), ranks_path)
