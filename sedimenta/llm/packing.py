"""Packing documents into training sequences: first-fit decreasing in randomised groups.

Every document is tokenized and closed by an end id. Rows go to randomised groups of bounded size;
in each group, whole windows become sequences, and first-fit decreasing places what remains, finding
the first bin that still fits with a tournament tree of bin capacities. The gaps left are then filled
with cuts from the emptiest bins, so that one sequence per group is short at most.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import row_key, scanned, text_bytes

#: Ids of one row between tokenizing and packing, at most; longer documents travel in parts.
PART_WINDOWS = 64
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, token_ids binary"


class CapacityTree:
    """Tournament tree over bins: each inner node holds the larger capacity of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, math.ceil(math.log2(max(bins, 1))))
        self.best = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin with room for size, which it fills by size."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        leaf = node
        best[node] -= size
        while node > 1:
            node //= 2
            best[node] = max(best[2 * node], best[2 * node + 1])
        return leaf - self.leaves


def first_fit_decreasing(sizes: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start in the item, length); no item is larger than window."""
    tree = CapacityTree(len(sizes), window)
    bins: list[list[tuple[int, int, int]]] = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if sizes[item]:
            b = tree.take(sizes[item])
            if b == len(bins):
                bins.append([])
            bins[b].append((item, 0, sizes[item]))
    return bins


def fill_gaps(bins: list[list[tuple[int, int, int]]], window: int) -> list[list[tuple[int, int, int]]]:
    """Fill the gaps of full bins with cuts from the emptiest ones until one bin at most has a gap."""
    bins = sorted(bins, key=lambda b: -sum(x[2] for x in b))
    low, high = 0, len(bins) - 1
    while low < high:
        gap = window - sum(x[2] for x in bins[low])
        while gap and low < high:
            item, start, size = bins[high].pop()
            if size > gap:
                bins[high].append((item, start + gap, size - gap))
                size = gap
            bins[low].append((item, start, size))
            gap -= size
            if not bins[high]:
                high -= 1
        low += 1
    return [b for b in bins if b]


def _tokenize(tokenizer_path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, special = _encoder(tokenizer_path)
        most = PART_WINDOWS * window
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                ids = _encode(rows.column("text").to_pylist(), encode, known, special)
                ids = [np.append(x, np.uint32(end_id)).astype("<u4") for x in ids]
                parts = [(i, at) for i, x in enumerate(ids) for at in range(0, len(x), most)]
                of = pa.array([i for i, _ in parts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").take(of),
                        rows.column("key").take(of),
                        pa.array([at for _, at in parts], pa.int64()),
                        pa.array([len(ids[i]) for i, _ in parts], pa.int64()),
                        pa.array([_narrow(ids[i][at : at + most]) for i, at in parts], pa.binary()),
                    ],
                    names=["doc_id", "key", "start", "doc_tokens", "ids"],
                )

    return run


def _encode(texts: list[str | None], encode, known, special: dict[str, int]) -> list[np.ndarray]:
    """Ids of each text; the tokenizer's special strings inside it are their own ids, and what stands between them is encoded apart."""
    between = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    parts, of, cut = [], [], set()
    for i, text in enumerate(texts):
        own = between.split(text or "") if between and any(x in (text or "") for x in special) else [text or ""]
        if len(own) > 1:
            cut.add(i)
        parts += own
        of += [i] * len(own)
    ids = kernels.encode_texts(["" if i in cut and p in special else p for i, p in zip(of, parts, strict=True)], encode, known)
    if not cut:
        return ids
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for i, p, x in zip(of, parts, ids, strict=True):
        out[i].append(np.array([special[p]], np.uint32) if i in cut and p in special else x)
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as their two low bytes planes, then the two high ones: high planes are zeros, which compress away."""
    planes = ids.view(np.uint16).reshape(-1, 2)
    return planes[:, 0].tobytes() + (planes[:, 1].tobytes() if planes[:, 1].any() else b"")


def _widen(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(raw, dtype="<u2")
    low = planes[:n].astype("<u4")
    return low if len(planes) == n else low | planes[n:].astype("<u4") << 16


_encoders: dict = {}


def _encoder(path: str):
    """A pre-token encoder for a byte-level BPE file of the tokenizers library, a table of what it has seen, and the ids of special strings."""
    if path not in _encoders:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {x["content"]: x["id"] for x in file["added_tokens"]}
        vocabulary = {token: i for token, i in file["model"]["vocab"].items() if token not in special}
        ranks = {bytes(_BYTE_OF[c] for c in token): i for token, i in vocabulary.items() if all(c in _BYTE_OF for c in token)}
        encode = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _encoders[path] = encode, kernels.SpanTable(), special
    return _encoders[path]


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE's letters: printable Latin-1 stands for itself, other bytes for 256 and up in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


_BYTE_OF = _byte_letters()


def _pack(window: int):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("pack_group")[0].as_py()
        raw = table.column("ids").to_pylist()
        starts = np.array(table.column("start"), dtype=np.int64)
        totals = np.array(table.column("doc_tokens"), dtype=np.int64)
        most = PART_WINDOWS * window
        ids = [_widen(x, min(most, int(n - s))) for x, n, s in zip(raw, totals, starts, strict=True)]
        docs = table.column("doc_id").to_pylist()
        keys = table.column("key").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (docs[i] is None, docs[i] or 0, keys[i], starts[i]))
        bins = [[(i, at, window)] for i in order for at in range(0, len(ids[i]) - window + 1, window)]
        tails = [(i, len(ids[i]) // window * window) for i in order if len(ids[i]) % window]
        placed = fill_gaps(first_fit_decreasing([len(ids[i]) - at for i, at in tails], window), window)
        bins += [[(tails[t][0], tails[t][1] + at, size) for t, at, size in b] for b in placed]
        rows = []
        for b, pieces in enumerate(bins):
            offset = 0
            for i, at, size in pieces:
                rows.append((docs[i], int(starts[i]) + at, size, int(totals[i]), group << 32 | b, offset, ids[i][at : at + size].tobytes()))
                offset += size
        kinds = [pa.int64()] * 6 + [pa.binary()]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=PIECES.replace(" long", "").replace(" binary", "").split(", "))

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, group_bytes: int = 8 << 20) -> DataFrame:
    """Pack documents(doc_id, text) into sequences of at most `window` tokens.

    tokenizer_path: a byte-level BPE file of the tokenizers library. group_bytes: text bytes that a
    group gets on average, which bounds a packing task. Returns one row per piece: doc_id, start (ids
    of its document before it), length, doc_tokens (ids of its document with the end id), sequence_id,
    offset in the sequence, token_ids (little-endian unsigned 32-bit).

    Null and empty texts give the end id alone; repeated rows and repeated or null doc_ids are packed
    each for itself; other columns are ignored; an empty table gives no pieces. Texts of any length
    are tokenized whole, as the library does by default: its special strings are ids of their own.
    """
    docs = scanned(docs.select("doc_id", "text"))
    groups = max(1, -(-text_bytes(docs) // group_bytes))
    key = row_key()
    rows = docs.select(F.col("doc_id").cast("long"), "text", key.alias("key"))
    parts = rows.mapInArrow(kernels.giving_back(_tokenize(tokenizer_path, end_id, window)), "doc_id long, key long, start long, doc_tokens long, ids binary")
    spread = parts.withColumn("pack_group", F.pmod(F.xxhash64("key", "start"), F.lit(groups)))
    return spread.groupBy("pack_group").applyInArrow(kernels.giving_back(_pack(window)), PIECES)
