"""NumPy kernels that run inside tasks: hashes of text spans, word bounds and pre-token bounds of whole batches."""

from __future__ import annotations

import ctypes
import inspect
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

U8 = np.uint64
#: An odd step between the places of a span.
BASE = 0x9E3779B97F4A7C13
#: Characters or bytes that a kernel handles at once; bounds its temporaries.
BATCH = 1 << 20


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run):
    """A function of Arrow groups or batches that gives freed memory back when it ends: Spark keeps idle Python workers beside busy ones."""
    if inspect.isgeneratorfunction(run):

        def batches(rows):
            try:
                yield from run(rows)
            finally:
                _give_back()

        return batches

    def one(group):
        try:
            return run(group)
        finally:
            _give_back()

    def two(group, other):
        try:
            return run(group, other)
        finally:
            _give_back()

    return two if run.__code__.co_argcount == 2 else one


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer of 64-bit values."""
    x = x ^ (x >> U8(31))
    x = x * U8(0x7FB5D329728EA185)
    x = x ^ (x >> U8(27))
    x = x * U8(0x81DADEF4BC2DD44D)
    return x ^ (x >> U8(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], spans in order and apart; equal spans have equal hashes wherever they lie.

    A hash is the sum of its values, each mixed with its place in the span: not a polynomial, in which
    structured texts (Thue-Morse words) can meet.
    """
    n = len(values)
    place = np.arange(n) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, n]))
    prefix = np.zeros(n + 1, dtype=U8)
    np.cumsum(mix(place.astype(U8) * U8(BASE) + values.astype(U8) + U8(1)), out=prefix[1:])
    return mix(prefix[ends] - prefix[starts] + (ends - starts).astype(U8) * U8(0xD6E8FEB86659FD93))


def span_hashes_long(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hashes of spans that lie in order end to end in an array of any size."""
    out, lo = np.zeros(len(starts), dtype=U8), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BATCH, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        out[lo:hi] = span_hashes(values[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return out


#: ASCII white space: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def words(raw: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes outside ASCII white space) of documents laid end to end, A-Z lower-cased.

    Returns each word's hash, its start and the index of its document.
    """
    if not len(raw):
        return np.zeros(0, U8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[raw]
    first = np.zeros(len(raw), dtype=bool)
    first[doc_starts[doc_starts < len(raw)]] = True
    starts = np.flatnonzero(inside & (first | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & np.r_[first[1:] | ~inside[1:], True]) + 1
    doc = np.searchsorted(doc_starts, starts, side="right") - 1
    return span_hashes(_LOWER[raw], starts, ends), starts, doc


LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Unicode White_Space, fixed values.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[WHITE] = SPACE
    return out


def pretoken_starts(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of documents laid end to end as code points.

    Pre-tokens: contractions, then runs of letters, numbers or other characters with one space
    before them, then white space, of which the last character before other text stands alone.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[cp]
    first = np.zeros(n + 1, dtype=bool)
    first[doc_starts] = True
    first[n] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.r_[run[1:], True] & space & ~first[1:]  # of a white-space run that other text follows
    start = run | last
    led = np.r_[False, last[:-1] & (cp[:-1] == 0x20)]  # a space leads the run
    start &= ~led
    quote = np.flatnonzero(start & (cp == 0x27))
    if len(quote):
        ends = np.append(doc_starts, n)
        end = ends[np.searchsorted(ends, quote, side="right")]
        padded = np.r_[cp, np.zeros(2, cp.dtype)]
        a = np.where(quote + 1 < end, padded[quote + 1], 0)
        b = np.where(quote + 2 < end, padded[np.minimum(quote + 2, n)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for which, size in ((one, 2), (two, 3)):
            at = quote[which]
            for k in range(1, size):
                start[at + k] = False
            after = at + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


def pieces_of(text: str, limit: int):
    """Cut a long text into parts that split into the same pre-tokens: before white space that follows other text."""
    at = 0
    while len(text) - at > limit:
        cut = text.rfind(" ", at + 1, at + limit)
        while cut > at and text[cut - 1].isspace():
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            cut = at + limit
            while cut < len(text) and not (text[cut] == " " and not text[cut - 1].isspace()):
                cut = (text.find(" ", cut + 1) + 1 or len(text) + 1) - 1
        yield text[at:cut]
        at = cut
    yield text[at:]


class _Buffer:
    """A flat array that grows at its end."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            more = np.zeros((self.n + len(values)) * 5 // 4, self.room.dtype)
            more[: self.n] = self.room[: self.n]
            self.room = more
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def flat(self) -> np.ndarray:
        return self.room[: self.n]


class SpanTable:
    """Values (lists of ids) of spans by their hash, with the spans themselves; the entries seen first stay when it is full.

    A cache alone: spans that it has no room for are encoded anew in each batch.
    """

    def __init__(self, most: int = 1_000_000, most_text: int = 8 << 20, longest: int = 1 << 10):
        self.most, self.most_text, self.longest = most, most_text, longest
        self.keys, self.entry = np.zeros(0, U8), np.zeros(0, np.int32)
        self.at, self.size, self.text_at, self.text_size = (_Buffer(np.int32) for _ in range(4))
        self.ids, self.text = _Buffer(np.uint32), _Buffer(np.uint32)

    def find(self, keys: np.ndarray, cp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each span, or -1; and whether its hash has an entry, be it of another span."""
        if not len(self.keys):
            return np.full(len(keys), -1), np.zeros(len(keys), bool)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        taken = self.keys[i] == keys
        entry = self.entry[i]
        same = taken & (self.text_size.flat[entry] == sizes)
        at = np.flatnonzero(same)
        same[at] = equal_spans(cp, starts[at], self.text.flat, self.text_at.flat[entry[at]], sizes[at])
        return np.where(same, entry, -1), taken

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray, text_size: np.ndarray, text: np.ndarray) -> None:
        short = text_size <= self.longest
        if not short.all():
            ids, text = ids[np.repeat(short, size)], text[np.repeat(short, text_size)]
            keys, size, text_size = keys[short], size[short], text_size[short]
        if not len(keys) or len(self.keys) + len(keys) > self.most or self.text.n + len(text) > self.most_text:
            return
        entry = (np.arange(len(keys)) + self.at.n).astype(np.int32)
        for mine, n, buffer, values in ((self.at, size, self.ids, ids), (self.text_at, text_size, self.text, text)):
            mine.add(np.r_[0, np.cumsum(n)[:-1]] + buffer.n)
            buffer.add(values)
        self.size.add(size)
        self.text_size.add(text_size)
        every, entry = np.r_[self.keys, keys], np.r_[self.entry, entry]
        order = np.argsort(every, kind="stable")
        self.keys, self.entry = every[order], entry[order]


def equal_spans(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether x[at:at+size] and y[at:at+size] are the same, for pairs of spans of equal size."""
    out, lo, ends = np.ones(len(size), bool), 0, np.cumsum(size)
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH // 4, side="right")))
        n = size[lo:hi]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        apart = x[np.repeat(x_at[lo:hi], n) + step] != y[np.repeat(y_at[lo:hi], n) + step]
        out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), n)[apart], minlength=hi - lo) == 0
        lo = hi
    return out


def gather(at: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[at:at+size] of each pair, end to end."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(size)
    return flat[np.arange(total) + np.repeat(at - (ends - size), size)]


def encode_texts(texts: list[str], encode_piece, known: SpanTable) -> list[np.ndarray]:
    """Token ids of each text. encode_piece gives the ids of one pre-token; each distinct one is encoded once."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    batch: list[tuple[int, str]] = []
    held = 0
    for i, text in enumerate(texts):
        for part in pieces_of(text, BATCH):
            if held and held + len(part) > BATCH:
                _encode_batch(batch, encode_piece, known, out)
                batch, held = [], 0
            batch.append((i, part))
            held += len(part)
    _encode_batch(batch, encode_piece, known, out)
    return [x[0] if len(x) == 1 else np.concatenate([*x, np.zeros(0, np.uint32)]) for x in out]


def _encode_batch(batch, encode_piece, known: SpanTable, out) -> None:
    whole = "".join(part for _, part in batch)
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.fromiter((len(part) for _, part in batch), dtype=np.int64, count=len(batch))
    doc_starts = np.cumsum(sizes) - sizes
    starts = pretoken_starts(cp, doc_starts[sizes > 0])
    ends = np.r_[starts[1:], len(cp)] if len(starts) else starts
    codes, keys = pd.factorize(span_hashes(cp, starts, ends)) if len(starts) else (starts, np.zeros(0, U8))
    example = np.zeros(len(keys), np.int64)
    example[codes[::-1]] = np.arange(len(codes))[::-1]
    sizes_cp = ends - starts
    same = sizes_cp == sizes_cp[example[codes]]
    same[same] = equal_spans(cp, starts[same], cp, starts[example[codes[same]]], sizes_cp[same])
    other = np.flatnonzero(~same)  # spans that only share a hash with the first of their code
    codes[other] = len(keys) + np.arange(len(other))
    example = np.r_[example, other]
    found, taken = known.find(keys, cp, starts[example[: len(keys)]], sizes_cp[example[: len(keys)]])
    found, taken = np.r_[found, np.full(len(other), -1)], np.r_[taken, np.ones(len(other), bool)]
    new, old = np.flatnonzero(found < 0), found >= 0
    at, size, flat = np.zeros(len(example), np.int64), np.zeros(len(example), np.int64), known.ids.flat
    at[old], size[old] = known.at.flat[found[old]], known.size.flat[found[old]]
    if len(new):
        begin, end = starts[example[new]], ends[example[new]]
        ids = [encode_piece(whole[s:e]) for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
        new_size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        new_flat = np.fromiter((x for y in ids for x in y), dtype=np.uint32, count=int(new_size.sum()))
        at[new], size[new] = np.cumsum(new_size) - new_size + len(flat), new_size
        flat = np.r_[flat, new_flat]
        free = ~taken[new]
        known.add(keys[new[free]], new_size[free], new_flat[np.repeat(free, new_size)], (end - begin)[free], gather(begin[free], (end - begin)[free], cp))
    ids = gather(at[codes], size[codes], flat)
    token_ends = np.r_[0, np.cumsum(size[codes])]
    bounds = token_ends[np.searchsorted(starts, np.r_[doc_starts, len(cp)])]
    for (i, _), a, b in zip(batch, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[i].append(ids[a:b])


def by_range(sorted_keys: np.ndarray, buckets: int):
    """(bucket, slice) of sorted 64-bit keys cut into equal ranges of the key space."""
    step = (1 << 64) // buckets + 1
    ends = np.searchsorted(sorted_keys, np.array([step * b for b in range(1, buckets)], dtype=U8))
    for b, (lo, hi) in enumerate(zip([0, *ends.tolist()], [*ends.tolist(), len(sorted_keys)], strict=True)):
        if hi > lo:
            yield b, slice(lo, hi)


class Vocabulary(dict):
    """Numbers from 0 on for things in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = len(self)
        return len(self) - 1

    def ids(self, found: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))
