"""Periodic run detection by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and length
factor * q or more that neither neighbour extends. Periods are sought at dyadic scales: at scale B a text
is cut into blocks of B words, and a run of period B <= q < 2 B and factor >= 3 holds a whole block whose
copy q words on lies in the run as well. So each block is held against the window of the words B to 3 B - 2
after its start: the sums of squared differences of word numbers at the B lags are a convolution, taken by
number-theoretic transforms modulo as many primes as make the sums exact. Lags of sum zero are the block's
occurrences; their distances are seeds, which are extended to both sides.

Blocks that cannot have such an occurrence are not transformed: a word of the block does not come again
within 2 B words, or the block and its window lie in a run already found, of a period below B (two periods
of a stretch as long as both together divide each other).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .kernels import U8, Vocabulary

#: Primes k * 2**25 + 1 and the like with a primitive root each, fixed values: transforms of up to 2**25 words.
PRIMES = [(2013265921, 31), (469762049, 3), (167772161, 3)]
#: Elements that one transform handles at once, and words of texts handled together.
CELLS, WORDS = 1 << 20, 1 << 19
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@lru_cache(maxsize=256)
def _twiddles(p: int, root: int, half: int, inverse: bool) -> np.ndarray:
    """Powers 0 to half - 1 of a root of unity of order 2 half, as a column."""
    w = pow(root, (p - 1) // (2 * half), p)
    w = pow(w, p - 2, p) if inverse else w
    out = np.ones(half, U8)
    n = 1
    while n < half:
        step = min(n, half - n)
        out[n : n + step] = out[:step] * U8(pow(w, n, p)) % U8(p)
        n += step
    return out[None, :, None]


def _forward(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """Transform of each column (a power of two rows), rows in bit-reversed order."""
    n, m = x.shape
    half = n // 2
    while half:
        y = x.reshape(-1, 2, half, m)
        a, b = y[:, 0], y[:, 1]
        apart = (a + (U8(p) - b)) * _twiddles(p, root, half, False) % U8(p)
        y[:, 0] = (a + b) % U8(p)
        y[:, 1] = apart
        half //= 2
    return x


def _backward(x: np.ndarray, p: int, root: int) -> np.ndarray:
    """Inverse of _forward."""
    n, m = x.shape
    half = 1
    while half < n:
        y = x.reshape(-1, 2, half, m)
        b = y[:, 1] * _twiddles(p, root, half, True) % U8(p)
        a = y[:, 0].copy()
        y[:, 0] = (a + b) % U8(p)
        y[:, 1] = (a + (U8(p) - b)) % U8(p)
        half *= 2
    return x * U8(pow(n, p - 2, p)) % U8(p)


def zero_mismatches(block: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Whether block[:, j] (B words) equals window[lag : lag + B, j], for the lags 0 to B - 1: by sums of squared differences.

    block: (B, m), window: (2 B, m) of numbers, of which the last row is never compared.
    """
    size, m = block.shape
    top = int(max(block.max(initial=0), window.max(initial=0))) + 1
    out, bound, known = np.ones((size, m), bool), size * top * top, 1
    for p, root in PRIMES:
        mod = lambda x: x.astype(U8) % U8(p)
        b, w = mod(block), mod(window)
        squares = np.zeros((2 * size + 1, m), U8)
        np.cumsum(w * w % U8(p), axis=0, out=squares[1:])
        turned = np.zeros((2 * size, m), U8)
        turned[0] = b[0]
        turned[: size : -1] = b[1:]
        products = _backward(_forward(w, p, root) * _forward(turned, p, root) % U8(p), p, root)[:size]
        sums = (b * b % U8(p)).sum(axis=0) + squares[size : 2 * size] - squares[:size]
        out &= sums % U8(p) == 2 * products % U8(p)
        known *= p
        if known > bound:
            return out
    raise ValueError("texts of this many words need more primes")


def _next_distance(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How far on each word comes again in its text, more than any distance for the last."""
    order = np.lexsort((np.arange(len(ids)), ids, doc))
    out = np.full(len(ids), len(ids) + 1)
    a, b = order[:-1], order[1:]
    same = (ids[a] == ids[b]) & (doc[a] == doc[b])
    out[a[same]] = b[same] - a[same]
    return out


def _extent(ids: np.ndarray, at: np.ndarray, lag: np.ndarray, low: np.ndarray, high: np.ndarray, step: int, forth: bool) -> np.ndarray:
    """How many words from `at` on (or before it) equal those `lag` later, not past low and high."""
    out, live, reach = np.zeros(len(at), np.int64), np.arange(len(at)), np.arange(step)
    while len(live):
        place = at[live] + (out[live] if forth else -1 - out[live])
        place = place[:, None] + (reach if forth else -reach)
        later = place + lag[live][:, None]
        inside = (place >= low[live][:, None]) & (later < high[live][:, None])
        same = inside & (ids[np.where(inside, place, 0)] == ids[np.where(inside, later, 0)])
        whole = same.all(axis=1)
        out[live] += np.where(whole, step, np.argmin(same, axis=1))
        live = live[whole]
    return out


def find_runs(ids: np.ndarray, sizes: np.ndarray, least: int = 6, factor: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ids), length and period of all runs of texts laid end to end, ordered by start, then period.

    ids: word numbers; sizes: words of each text. A run has max(least, factor * period) words at least; factor >= 3.
    """
    if factor < 3:
        raise ValueError("blocks find runs of three periods or more")
    ends = np.cumsum(sizes)
    starts = ends - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    again = _next_distance(ids, doc)
    runs = np.zeros((3, 0), np.int64)
    size = 1
    while factor * size <= sizes.max(initial=0):
        most = np.where(sizes >= max(least, factor * size), sizes // size - 1, 0)
        at = np.repeat(starts - size * (np.cumsum(most) - most), most) + size * np.arange(most.sum())
        at = at[np.maximum.reduceat(again, np.stack([at, at + size], 1).reshape(-1))[::2] < 2 * size] if len(at) else at
        high = ends[doc[at]]
        covered = _covered(runs, at, np.minimum(at + 3 * size - 1, high))
        at, high = at[~covered], high[~covered]
        found, lags = [], []
        most_blocks = max(1, CELLS // (2 * size))
        for lo in range(0, len(at), most_blocks):
            x, end = at[lo : lo + most_blocks], high[lo : lo + most_blocks]
            block = ids[np.arange(size)[:, None] + x] + 1
            place = np.arange(size, 3 * size)[:, None] + x
            window = np.where(place < end, ids[np.minimum(place, len(ids) - 1)] + 1, 0)
            lag, which = np.nonzero(zero_mismatches(block, window))
            found.append(x[which])
            lags.append(lag + size)
        if found:
            runs = _with_seeds(runs, ids, np.concatenate(found), np.concatenate(lags), size, starts, ends, doc, least, factor)
        size *= 2
    return tuple(runs[:, np.lexsort((runs[2], runs[0]))])


def _covered(runs: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether one run (in order of their starts) holds all of low to high - 1."""
    if not runs.shape[1]:
        return np.zeros(len(low), bool)
    reach = np.r_[-1, np.maximum.accumulate(runs[0] + runs[1])]
    return reach[np.searchsorted(runs[0], low, side="right")] >= high


def _with_seeds(runs, ids, at, lag, size, starts, ends, doc, least, factor) -> np.ndarray:
    """The runs and those that the seeds extend to."""
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    head = np.r_[True, (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + size) | (doc[at[1:]] != doc[at[:-1]])] if len(at) else np.zeros(0, bool)
    first, last = at[head], at[np.r_[head[1:], True]] if len(at) else at
    lag = lag[head]
    low, high = starts[doc[first]], ends[doc[first]]
    right = last + size + _extent(ids, last + size, lag, low, high, size, True)
    left = first - _extent(ids, first, lag, low, high, size, False)
    new = np.unique(np.stack([left, right + lag - left, lag]), axis=1)
    new = new[:, new[1] >= np.maximum(least, factor * new[2])]
    new = new[:, ~_covered(runs, new[0], new[0] + new[1])]
    runs = np.concatenate([runs, new], axis=1)
    return runs[:, np.argsort(runs[0], kind="stable")]


def _batches(batches: Iterator[pa.RecordBatch], order) -> Iterator[tuple[list, list[np.ndarray], list[bytes]]]:
    """doc_ids, word numbers of each text and the words, of some texts at a time."""
    ids, words, known, held = [], [], Vocabulary(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            parts = [known.ids(part.encode("utf-8", "surrogatepass").split()) for part in kernels.pieces_of(text or "", 1 << 20)]
            own = np.concatenate(parts)
            places = order(doc_id, len(own)) if order and len(own) else None
            ids.append(doc_id)
            words.append(own if places is None else own[places])
            held += len(own)
            if held >= WORDS:
                yield ids, words, list(known)
                ids, words, known, held = [], [], Vocabulary(), 0
    if ids:
        yield ids, words, list(known)


def collapse_runs(docs: DataFrame, least: int = 6, factor: int = 4, order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Every document(doc_id, text) with its periodic runs and its text without their repeats.

    Words are runs of bytes outside ASCII white space, told apart by their bytes, numbered from 0. Returns doc_id,
    n_words, runs (array of start, length and period, by start, then period) and collapsed: the words that are in no
    run after its first period, joined by one space. order(doc_id, n) may give the places from which the n words of a
    text are read (None: as they are).

    One pass over the scan: texts never leave their task. Null and empty texts have no words and collapse to an empty
    text; rows stay one for one, repeated rows and null doc_ids included; other columns are ignored. A text's numbers
    take 8 bytes a word; its transforms at most a few times that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, known in _batches(batches, order):
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            flat = np.concatenate(words)
            start, length, period = find_runs(flat, sizes, least, factor)
            edge = np.zeros(len(flat) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            kept = np.cumsum(edge[:-1]) == 0
            ends = np.cumsum(sizes)
            begins = ends - sizes
            bounds = np.searchsorted(start, np.r_[begins, len(flat)])
            runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(start - np.repeat(begins, np.diff(bounds))), pa.array(length), pa.array(period)], fields=list(RUN)))
            left = [b" ".join(map(known.__getitem__, flat[a:b][kept[a:b]].tolist())) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), runs, pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(kernels.giving_back(run), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
