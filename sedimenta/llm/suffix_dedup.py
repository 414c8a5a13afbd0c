"""Suffix-array dedup: remove every byte that a repeated string of `length` bytes covers, but for its first occurrence.

Each window of `length` bytes is filed under its anchor, the place of the least hash among its short
grams, so that equal windows share the anchor's offset. Only suffixes at anchors are sorted (a sparse
suffix array), and only those whose gram occurs again anywhere:

1. Documents go to blocks. A block asks which of its anchor grams occur in other blocks; hash ranges reply.
2. A block sends the contexts of repeated anchors: the bytes of all windows filed there.
3. Ranges of anchors sort the contexts to the right and, reversed, to the left of the anchor by
   deep-shallow sorting: multikey quicksort down to a shallow depth, then blind tries for groups whose
   common prefix is longer. Common prefixes of neighbours tell which windows are equal, and the
   earliest stays. The contexts of anchors with too many for one task are cut to ranges of window
   offsets and parted by the bytes that all windows of a range share, again and again; only windows
   that are still too many when each stands alone, all equal then, need no sorting: the first stays.
4. Spans go back to their blocks, which cut them out.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import cut_lineage, in_blocks
from .kernels import U8, giving_back, mix

GRAM = 24
SHALLOW = 40
#: Widths of the ranges of offsets that the contexts of a crowded anchor are split into, one after the other.
SPLITS = (39, 13, 4, 1)
LAST = (1 << 63) - 1
CONTEXTS = "anchor long, context binary, ahead int, behind int, doc_id long, row long, position long, block int"
CONTEXT_TYPES = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in CONTEXTS.split(", ")])
SPANS = "block int, row long, start long, stop long"


def anchors(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows inside slices that end at `ends`: gram hash, place, first and last window start.

    The hash is mixed again after the least was taken, since the least of many lie in the lowest range of hashes alone.
    """
    n, grams = len(raw), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return np.zeros(0, U8), none, none, none
    padded = np.concatenate([raw, np.zeros(16, np.uint8)]).tobytes()
    word = np.empty((n // 8 + 1) * 8, dtype=U8)
    for k in range(8):
        own = np.frombuffer(padded, dtype="<u8", offset=k, count=(len(padded) - k) // 8)[: len(word) // 8]
        word[k::8][: len(own)] = own
    word = word[:n]
    m = n - GRAM + 1
    code = mix(word[:m] * U8(0x9FB21C651E98DF25) + mix(word[8 : 8 + m] + U8(0x3C79AC492BA7B653)) + word[16 : 16 + m] * U8(0xA0761D6478BD642F))
    bits = int(m).bit_length()
    least = (code >> U8(bits) << U8(bits)) | np.arange(m, dtype=U8)
    span = 1
    while span * 2 <= grams:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = grams - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    place = (least & U8((1 << bits) - 1)).astype(np.int64)
    valid = np.ones(len(place), dtype=bool)
    for e in ends[:-1].tolist():
        valid[max(0, e - length + 1) : e] = False
    first = valid & np.r_[True, (place[1:] != place[:-1]) | ~valid[:-1]]
    last = valid & np.r_[(place[1:] != place[:-1]) | ~valid[1:], True]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return mix(code[place[lo]]), place[lo], lo, hi


def _slices(texts: list[bytes], length: int, most: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Batches of (document, offset, bytes); long documents are cut so that each window lies in one slice."""
    batch, held = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), most):
            part = text[at : at + most + length - 1]
            if held and held + len(part) > most:
                yield batch
                batch, held = [], 0
            batch.append((i, at, part))
            held += len(part)
    if batch:
        yield batch


def _anchored(texts: list[bytes], length: int):
    """For each batch: its bytes, and its anchors with their document and the place that its offset has in the bytes."""
    for batch in _slices(texts, length, kernels.BATCH):
        raw = np.frombuffer(b"".join(p for _, _, p in batch), dtype=np.uint8)
        sizes = np.fromiter((len(p) for _, _, p in batch), dtype=np.int64, count=len(batch))
        ends = np.cumsum(sizes)
        code, place, lo, hi = anchors(raw, ends, length)
        of = np.searchsorted(ends, lo, side="right")
        doc = np.array([i for i, _, _ in batch])[of]
        shift = (np.array([at for _, at, _ in batch]) - (ends - sizes))[of]
        yield raw, code, place, lo, hi, doc, shift


def _texts(table: pa.Table) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]


def _ask(length: int, buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        found = [code for _, code, *_ in _anchored(_texts(docs), length)]
        keys = np.unique(np.concatenate([np.zeros(0, U8), *found]))
        rows = [(b, docs.column("block")[0].as_py(), keys[part].tobytes()) for b, part in kernels.by_range(keys, buckets)]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "block", "keys"])

    return run


def _reply(table: pa.Table) -> pa.Table:
    """The keys that more than one block asked for, to each block that did."""
    keys = [np.frombuffer(k, dtype=U8) for k in table.column("keys").to_pylist()]
    every, count = np.unique(np.concatenate(keys), return_counts=True)
    again = every[count > 1]
    out = [k[np.isin(k, again, assume_unique=True)].tobytes() for k in keys]
    return pa.table({"block": table.column("block"), "keys": pa.array(out, pa.binary())})


def _least(doc: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The rank of each occurrence: by document, row, place."""
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((place, row, doc))] = np.arange(len(doc))
    return rank


def _contexts(length: int):
    """Contexts of repeated anchors, each distinct one with its first occurrence in the block; spans of the others."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        parts: list[pa.Table] = []
        if docs.num_rows:
            texts = _texts(docs)
            ids = [LAST if x is None else x for x in docs.column("doc_id").to_pylist()]
            rows, block = np.array(docs.column("row")), docs.column("block")[0].as_py()
            order = np.lexsort((rows, np.array(ids, dtype=np.int64)))
            elsewhere = np.concatenate([np.zeros(0, U8), *(np.frombuffer(k, dtype=U8) for k in replies.column("keys").to_pylist())])
            every = [code for _, code, *_ in _anchored(texts, length)]
            keys, count = np.unique(np.concatenate([np.zeros(0, U8), *every]), return_counts=True)
            wanted = np.union1d(keys[count > 1], elsewhere)
            seen: set[bytes] = set()
            text, ends, numbers = bytearray(), array("q"), array("q")
            spans: list[tuple[int, int, int]] = []
            for raw, code, place, lo, hi, doc, shift in _anchored([texts[i] for i in order], length):
                data = raw.tobytes()
                at = np.flatnonzero(np.isin(code, wanted))
                for a, p, s, e, d, move in zip(code[at].view(np.int64).tolist(), place[at].tolist(), lo[at].tolist(), hi[at].tolist(), order[doc[at]].tolist(), shift[at].tolist(), strict=True):
                    context = data[s : e + length]
                    key = xxhash.xxh3_128_digest(context, seed=p - s)  # the anchor follows from the context and its offset
                    if key in seen:
                        spans.append((int(rows[d]), s + move, e + length + move))
                    else:
                        seen.add(key)
                        text += context
                        ends.append(len(text))
                        numbers.extend((a, p - s, p - e, ids[d], int(rows[d]), p + move))
            parts = [_context_rows(text, ends, numbers, block), _span_rows(_merged(spans), block)]
        return pa.concat_tables([pa.Table.from_batches([], CONTEXT_TYPES), *parts])

    return run


def _context_rows(text: bytearray, ends: array, numbers: array, block: int) -> pa.Table:
    n = len(ends)
    values = np.frombuffer(numbers, np.int64).reshape(n, 6) if n else np.zeros((0, 6), np.int64)
    at = pa.py_buffer(np.r_[0, np.array(ends, np.int64)].astype(np.int32))
    contexts = pa.BinaryArray.from_buffers(pa.binary(), n, [None, at, pa.py_buffer(text)])
    anchor, ahead, behind, doc, row, place = (pa.array(np.ascontiguousarray(values[:, k])) for k in range(6))
    small = pa.int32()
    return pa.table([anchor, contexts, ahead.cast(small), behind.cast(small), doc, row, place, pa.array(np.full(n, block, np.int32))], CONTEXT_TYPES)


def _span_rows(spans: list[tuple[int, int, int]], block: int) -> pa.Table:
    """Spans that a block settled itself: no anchor, start as position, stop as doc_id."""
    row, start, stop = (pa.array(c, pa.int64()) for c in (zip(*spans, strict=True) if spans else ((), (), ())))
    none = [pa.nulls(len(row), CONTEXT_TYPES.field(k).type) for k in range(4)]
    return pa.table([*none, stop, row, start, pa.array(np.full(len(row), block, np.int32))], CONTEXT_TYPES)


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the same row that touch, as one."""
    out: list[tuple[int, int, int]] = []
    for row, start, stop in sorted(spans):
        if out and out[-1][0] == row and start <= out[-1][2]:
            out[-1] = (row, out[-1][1], max(stop, out[-1][2]))
        else:
            out.append((row, start, stop))
    return out


class BlindTrie:
    """Orders strings of equal length that share a long prefix; nodes keep only the place where strings part."""

    def __init__(self, first: int, strings: list[bytes]):
        self.strings, self.root = strings, [first]

    def add(self, i: int) -> None:
        """A node is [place, {byte: node}], a leaf is a list of one or more equal strings."""
        text, node = self.strings[i], self.root
        while len(node) == 2 and isinstance(node[1], dict):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        if text == other:
            node.append(i)
            return
        size = len(text)
        apart = size - 1 - ((int.from_bytes(text) ^ int.from_bytes(other)).bit_length() - 1) // 8
        above, node = None, self.root
        while len(node) == 2 and isinstance(node[1], dict) and node[0] < apart:
            above, node = node, node[1][text[node[0]]]
        if len(node) == 2 and isinstance(node[1], dict) and node[0] == apart:
            node[1][text[apart]] = [i]
            return
        fork = [apart, {text[apart]: [i], other[apart]: node}]
        if above is None:
            self.root = fork
        else:
            above[1][text[above[0]]] = fork

    def ordered(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if len(node) == 2 and isinstance(node[1], dict):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow_sort(rows: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of equally long byte strings (rows): multikey quicksort on words of 8 bytes to the shallow depth, then blind tries.

    The quicksort splits all segments at once: each by its own pivot into smaller, equal and larger,
    of which the equal part goes on with the next word.
    """
    n, width = rows.shape
    order = np.arange(n)
    words = np.ascontiguousarray(rows[:, : shallow // 8 * 8]).view(">u8")
    segment, depth = np.zeros(n, np.int64), np.zeros(n, np.int64)  # by place in order; segment: where it starts
    live = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    while len(live):
        start = segment[live]
        head = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
        size = np.diff(np.r_[head, len(live)])
        value = words[order[live], depth[live]]
        pivot = np.repeat(value[head + size // 2], size)
        side = (value > pivot).astype(np.int64) - (value < pivot)
        which = np.argsort(start * 3 + side + 1, kind="stable")
        order[live], side = order[live][which], side[which]
        code = start * 3 + side + 1
        new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        long = np.diff(np.r_[new, len(live)])
        segment[live] = np.repeat(live[new], long)
        depth[live] += side == 0
        live = live[(np.repeat(long, long) > 1) & (depth[live] < words.shape[1])]
    head = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]][:n])
    for lo, hi in zip(head.tolist(), np.r_[head, n][1:].tolist(), strict=True):
        if hi - lo > 1:
            own = order[lo:hi]
            strings = [r.tobytes() for r in rows[own]]
            trie = BlindTrie(0, strings)
            for i in range(1, hi - lo):
                trie.add(i)
            order[lo:hi] = own[trie.ordered()]
    return order


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows and the common prefix of each with the one before it."""
    order = deep_shallow_sort(rows)
    common = np.zeros(len(rows), np.int64)
    for lo in range(1, len(rows), 1 << 16):
        a, b = rows[order[lo - 1 : lo - 1 + (1 << 16)]], rows[order[lo : lo + (1 << 16)]]
        differ = a[: len(b)] != b
        common[lo : lo + len(b)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, common


def _settle(length: int):
    """Windows of an anchor range that occurred before, as spans."""
    most = length - GRAM

    def run(t: pa.Table) -> pa.Table:
        ahead, behind = np.array(t.column("ahead"), np.int64), np.array(t.column("behind"), np.int64)
        doc, row, place, block = (np.array(t.column(c), np.int64) for c in ("doc_id", "row", "position", "block"))
        rank = np.argsort(_least(doc, row, place))
        ahead, behind, doc, row, place, block = (x[rank] for x in (ahead, behind, doc, row, place, block))
        text = t.column("context").take(pa.array(rank)).combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks)
        at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        n = len(rank)
        size = np.diff(at)
        key = mix(kernels.span_hashes_long(raw, at[:-1], at[1:]) + ahead.astype(U8))
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        alone = first[same]  # the earliest occurrence of the same context
        sure = (ahead == ahead[alone]) & (size == size[alone])
        sure[sure] = kernels.equal_spans(raw, at[:-1][sure], raw, at[:-1][alone[sure]], size[sure])
        alone = np.where(sure, alone, np.arange(n))  # one that only shares its hash stands for itself
        spare = np.flatnonzero(alone != np.arange(n))
        spans = [(block[spare], row[spare], place[spare] - ahead[spare], place[spare] - ahead[spare] + size[spare])]
        use = np.flatnonzero(alone == np.arange(n))
        if len(use):
            own = use
            right, left = np.zeros((len(own), length), np.uint8), np.zeros((len(own), most + 8 - most % 8), np.uint8)
            for k in range(length):
                has = ahead[own] + k < size[own]
                right[has, k] = raw[at[own][has] + ahead[own][has] + k]
            for k in range(most):
                has = k < ahead[own]
                left[has, k] = raw[at[own][has] + ahead[own][has] - 1 - k]
            order_r, common_r = _groups(right)
            order_l, common_l = _groups(left)
            repeat = np.zeros((len(own), most + 3), dtype=bool)  # by offset + 1
            for o in range(most + 1):
                rows = np.flatnonzero((behind[own] <= o) & (o <= ahead[own]))
                if len(rows) > 1:
                    r, l = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
                    r[order_r] = np.cumsum(common_r < length - o)
                    l[order_l] = np.cumsum(common_l < o)
                    _, before = np.unique(r[rows] * (len(own) + 1) + l[rows], return_index=True)
                    again = np.ones(len(rows), dtype=bool)
                    again[before] = False
                    repeat[rows[again], o + 1] = True
            i, lo_o = np.nonzero(repeat[:, 1:] & ~repeat[:, :-1])
            _, hi_o = np.nonzero(repeat[:, :-1] & ~repeat[:, 1:])
            spans.append((block[own][i], row[own][i], place[own][i] - hi_o + 1, place[own][i] - lo_o + length))
        columns = [np.concatenate(c) for c in zip(*spans, strict=True)]
        return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["block", "row", "start", "stop"])

    return run


def _split(length: int, width: int):
    """Contexts cut to windows whose offsets lie in one range of `width`, with a key of the bytes that all windows of the range share: equal windows have equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(0, batch.num_rows, 512):
                rows = batch.slice(one, 512)
                of, contexts, keys, aheads, behinds = [], [], [], [], []
                for i, (context, ahead, behind) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("context", "ahead", "behind")), strict=True)):
                    for first in range(behind // width * width, ahead + 1, width):
                        last = min(first + width - 1, length - GRAM)
                        high, low = min(ahead, last), max(behind, first)
                        of.append(i)
                        contexts.append(context[ahead - high : ahead - low + length])
                        keys.append(xxhash.xxh3_128_digest(context[ahead - first : ahead - last + length], seed=first))
                        aheads.append(high)
                        behinds.append(low)
                own = rows.take(pa.array(of, pa.int64()))
                made = {"context": pa.array(contexts, pa.binary()), "ahead": pa.array(aheads, pa.int32()), "behind": pa.array(behinds, pa.int32())}
                columns = [made.get(c) if c in made else own.column(c) for c in CONTEXT_TYPES.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.binary())], names=[*CONTEXT_TYPES.names, "key"])

    return run


def _whole_characters(text: bytes, spans: list[tuple[int, int, int]]) -> str:
    """The text without spans, which give back characters that they cut."""
    kept, at = [], 0
    for _, start, stop in spans:
        while start < stop and text[start] & 0xC0 == 0x80:
            start += 1
        while stop < len(text) and start < stop and text[stop] & 0xC0 == 0x80:
            stop -= 1
        kept.append(text[at:start])
        at = stop
    return b"".join([*kept, text[at:]]).decode("utf-8", "replace")


def _cut(columns: list[str], with_text: bool):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        by_row: dict[int, list[tuple[int, int, int]]] = {}
        for row, start, stop in zip(spans.column("row").to_pylist(), spans.column("start").to_pylist(), spans.column("stop").to_pylist(), strict=True):
            by_row.setdefault(row, []).append((row, start, stop))
        out = []
        for row, text in zip(docs.column("row").to_pylist(), _texts(docs), strict=True):
            own, at, kept = _merged(by_row.get(row, [])), 0, []
            for _, start, stop in own:
                kept.append(text[at:start])
                at = stop
            kept.append(text[at:])
            whole = _whole_characters(text, own) if with_text else None
            out.append((len(text), sum(e - s for _, s, e in own), len(own), b"".join(kept), [x for _, s, e in own for x in (s, e)], whole))
        data = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.string())
        made = [pa.array(c, k) for c, k in zip(data, kinds, strict=True)]
        return pa.table([*(docs.column(c) for c in columns), *made], names=[*columns, "n_bytes", "n_removed", "n_spans", "kept", "spans", "text"])

    return run


def remove_repeats(docs: DataFrame, length: int = 100, columns: tuple[str, ...] = (), with_text: bool = False, block_bytes: int = 8 << 20, most_contexts: int = 200_000) -> DataFrame:
    """doc_id, `columns`, n_bytes, n_removed, n_spans, kept (bytes), spans and text of every row of documents(doc_id, text).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a smaller doc_id,
    or in the same document at an earlier place; strings are those of the input texts as UTF-8 and
    never cross documents. spans: starts and stops of the maximal removed runs, in order. text: null, or with_text what is
    kept with the characters whole that runs cut into.

    Null texts are empty; texts shorter than `length` stay whole. Rows with equal doc_ids are separate
    documents in the order they are scanned; null doc_ids come last. Documents that are not read from files
    are written to the shared folder first, so that lost tasks see the same rows again. block_bytes bounds a task's text;
    most_contexts: contexts that are sorted
    together, beyond which they are split further.
    """
    blocked, blocks = in_blocks(docs, block_bytes, *columns)
    buckets = max(1, blocks // 4)
    asked = blocked.select("doc_id", "text", "row", "block").groupBy("block").applyInArrow(giving_back(_ask(length, buckets)), "bucket int, block int, keys binary")
    replies = cut_lineage(asked.groupBy("bucket").applyInArrow(giving_back(_reply), "block int, keys binary"), "replies")
    found = blocked.select("doc_id", "text", "row", "block").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(giving_back(_contexts(length)), CONTEXTS)
    found = cut_lineage(found, "contexts")
    spans = found.where("anchor is null").select("block", "row", F.col("position").alias("start"), F.col("doc_id").alias("stop"))

    contexts = found.where("anchor is not null")
    crowded = cut_lineage(contexts.groupBy("anchor").count().where(F.col("count") > most_contexts).select("anchor"), "crowded")
    ranges = max(1, blocks)

    def settled(rows: DataFrame, key: str) -> DataFrame:
        calm = rows.join(crowded, key, "left_anti").select(*CONTEXT_TYPES.names, F.expr(f"pmod(xxhash64({key}), {ranges})").alias("part"))
        return calm.groupBy("part").applyInArrow(giving_back(_settle(length)), SPANS)

    spans = spans.union(settled(contexts, "anchor"))
    left = contexts.join(crowded, "anchor", "left_semi")
    for width in SPLITS if crowded.first() else ():
        pieces = cut_lineage(left.mapInArrow(giving_back(_split(length, width)), f"{CONTEXTS}, key binary"), "pieces")
        if width == 1:  # a key is one window
            first = pieces.groupBy("key").agg(F.min(F.struct("doc_id", "row", "position")).alias("first"))
            later = pieces.join(first, "key").where(F.struct("doc_id", "row", "position") != F.col("first"))
            start = F.col("position") - F.col("ahead")
            spans = spans.union(later.select("block", "row", start.alias("start"), (start + length).alias("stop")))
            break
        crowded = cut_lineage(pieces.groupBy("key").count().where(F.col("count") > most_contexts).select("key"), "crowded")
        spans = spans.union(settled(pieces, "key"))
        if not crowded.first():
            break
        left = pieces.join(crowded, "key", "left_semi").drop("key")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocked.select("doc_id", *columns).schema)
    return blocked.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(giving_back(_cut(["doc_id", *columns], with_text)), f"{schema}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>, text string")
