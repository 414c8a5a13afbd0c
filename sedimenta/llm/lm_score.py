"""LM scoring with a log-frequency Bloom filter of n-gram counts.

Counts of pairs and triples of tokens are quantised to levels (level q stands for base ** (q - 1) and more)
and held by a Bloom filter: an n-gram of level q is entered with each of the numbers 1 to q, and is read by
membership probes with 1, 2, ... until one fails. The filter lies in segments by hash range, each sized by
what it holds, so that no n-gram is left out at any size of the corpus.

A filter of 17 bits for each entry grows with the corpus, so that it cannot be broadcast whole: blocks (runs
of scanned rows) send their distinct n-grams to the segments, which probe each once and reply with levels.
Counts of words are exact.

P(w | v) = (c(v w) + a P(w)) / (c(v) + a) and P(w | u v) = (c(u v w) + b P(w | v)) / (c(u v) + b), where P(w) is
the smoothed share of w. c(v) is exact, c(u v) as a context is the largest count of its level, the other counts
are the least of theirs, so that the probabilities after u v sum to 1 at most, false positives aside.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import cut_lineage, in_runs
from .kernels import U8, mix
from .quality import is_fold

#: The end of a document, which also stands before its first word.
END = U8(0x5851F42D4C957F2D)
#: Probes of one level: a false positive in 2**12 at most.
PROBES = 12
LAST = (1 << 64) - 1
#: Bytes of an n-gram's key that are zero.
LOW = 2
ASKED = "bucket int, block long, keys binary, counts binary"
REPLIED = "bucket int, block long, checksum long, counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with one end for each text, and the index of their text."""
    found, of, batch, held = [], [], [], 0

    def flush() -> None:
        if batch:
            raws = [part.encode("utf-8", "surrogatepass") for _, part in batch]
            sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
            key, _, part = kernels.words(np.frombuffer(b"".join(raws), dtype=np.uint8), np.cumsum(sizes) - sizes)
            found.append(key)
            of.append(np.array([i for i, _ in batch])[part])

    for i, text in enumerate(texts):
        for part in kernels.pieces_of(text, kernels.BATCH // 4):
            if held and held + len(part) > kernels.BATCH // 2:
                flush()
                batch, held = [], 0
            batch.append((i, part))
            held += len(part)
    flush()
    doc = np.concatenate([*of, np.arange(len(texts))])
    key = np.concatenate([*found, np.full(len(texts), END)])
    order = np.argsort(doc, kind="stable")
    return key[order], doc[order]


def ngrams(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether a token is the first of its text, the token before it (the end for a first one), and keys of pair and triple (for a first one the pair)."""
    first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    before = np.where(first, END, np.r_[END, key[:-1]]) if len(key) else key
    pair = mix(before * U8(0xD1342543DE82EF95) + key)
    triple = np.where(first, pair, mix(np.r_[U8(0), pair[:-1]] * U8(0xA0761D6478BD642F) + key)) if len(key) else key
    cut = U8(0xFFFFFFFFFFFF0000)
    return first, before, pair & cut, triple & cut


def _planes(values: np.ndarray, low: int = 0) -> bytes:
    """The bytes of 64-bit values from byte `low` on, byte by byte: the equal upper bytes of sorted keys and small counts compress away."""
    return np.ascontiguousarray(values.astype("<i8" if values.dtype != U8 else U8).view(np.uint8).reshape(-1, 8)[:, low:].T).tobytes()


def _values(raw: bytes, low: int = 0, kind=U8) -> np.ndarray:
    out = np.zeros((len(raw) // (8 - low), 8), np.uint8)
    out[:, low:] = np.frombuffer(raw, np.uint8).reshape(8 - low, -1).T
    return out.reshape(-1).view(kind)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """Block, texts and whether each is for training; a block that batches cut is put together again."""
    at, texts, learn = None, [], []
    for batch in batches:
        for block, text, held_out in zip(*(batch.column(c).to_pylist() for c in ("block", "text", "held_out")), strict=True):
            if block != at and texts:
                yield at, texts, np.array(learn)
                texts, learn = [], []
            at = block
            texts.append(text or "")
            learn.append(not held_out)
    if texts:
        yield at, texts, np.array(learn)


def _asking(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "block", "keys", "counts"])


def _ask(buckets: int, ranges: int):
    """The words, pairs and triples of each block with their training counts, a row for each hash range of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts, learn in _whole_blocks(batches):
            key, doc = tokens(texts)
            first, _, pair, triple = ngrams(key, doc)
            learned = learn[doc]
            for own, use, start, n, low in ((key, learned, 0, buckets, 0), (pair, learned, buckets, ranges, LOW), (triple[~first], learned[~first], buckets + ranges, ranges, LOW)):
                keys, of = np.unique(own, return_inverse=True)
                counts = np.bincount(of, weights=use, minlength=len(keys))
                for b, part in kernels.by_range(keys, n):
                    yield _asking([(start + b, block, _planes(keys[part], low), _planes(counts[part]))])

    return run


def _summed(t: pa.Table, low: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    keys = [_values(k, low) for k in t.column("keys").to_pylist()]
    counts = np.concatenate([_values(c, kind="<i8") for c in t.column("counts").to_pylist()])
    every, of = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, every, np.bincount(of, weights=counts, minlength=len(every)).astype("<i8")


def _count(buckets: int, base: float):
    """What each block asked of a hash range, in the order of the keys, whose checksum stands for them: counts of words,
    levels of other n-grams as the range's segment of the filter holds them; block -1 has how many tokens and words there are."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        words = bucket < buckets
        keys, every, total = _summed(t, 0 if words else LOW)
        if not words:
            held = total > 0
            total = LogFrequencyFilter.of(every[held], total[held], base).levels(every)
        raw = lambda k: (_planes if words else bytes)(total[np.searchsorted(every, k)])
        replies = [(bucket, b, zlib.crc32(k), raw(k)) for b, k in zip(t.column("block").to_pylist(), keys, strict=True)]
        if words:
            replies.append((bucket, -1, 0, np.array([total.sum(), (total > 0).sum()], "<i8").tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*replies, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "checksum", "counts"])

    return run


def _replied(keys: np.ndarray, first: int, buckets: int, replies: pa.Table, levels: bool) -> np.ndarray:
    """Counts or levels of a block's sorted keys, from the replies of `buckets` hash ranges from `first` on."""
    rows = zip(*(replies.column(c).to_pylist() for c in ("bucket", "checksum", "counts")), strict=True)
    got = {b - first: (checksum, counts) for b, checksum, counts in rows if first <= b < first + buckets}
    out = np.zeros(len(keys), np.uint8 if levels else np.int64)
    for b, part in kernels.by_range(keys, buckets):
        checksum, counts = got.pop(b, (None, b""))
        if checksum != zlib.crc32(np.ascontiguousarray(keys[part])):
            raise RuntimeError("a block holds other rows than when it asked for counts")
        out[part] = np.frombuffer(counts, np.uint8) if levels else _values(counts, kind="<i8")
    if got:
        raise RuntimeError("a block holds fewer keys than when it asked for counts")
    return out


def level_of(count: np.ndarray, base: float) -> np.ndarray:
    """The level of each count of 1 or more: how many powers of base from 1 on it reaches."""
    return 1 + np.floor(np.log(count) / np.log(base) + 1e-9).astype(np.int64)


def least_of(level: np.ndarray, base: float) -> np.ndarray:
    """The least count of each level, 0 of level 0."""
    return np.where(level > 0, np.ceil(base ** (level - 1.0) - 1e-6), 0)


def most_of(level: np.ndarray, base: float) -> np.ndarray:
    """The largest count of each level, 0 of level 0."""
    return np.where(level > 0, np.ceil(base ** level.astype(float) - 1e-6) - 1, 0)


class LogFrequencyFilter:
    """One segment of the Bloom filter: the levels of its n-grams, read without false negatives and with few false positives."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, key: np.ndarray, count: np.ndarray, base: float) -> LogFrequencyFilter:
        """As many bits as leave half of them unset."""
        level = level_of(count, base)
        out = cls(np.zeros(max(64, int(np.ceil(level.sum() * PROBES / np.log(2)))), dtype=bool))
        for q in range(1, int(level.max(initial=0)) + 1):
            for place in out._places(key[level >= q], q):
                out.bits[place] = True
        return out

    def _places(self, key: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """The bit of (key, level) in each probe."""
        a = mix(key + U8(level * 0x9E3779B97F4A7C15 & LAST))
        b = mix(a ^ U8(0xC2B2AE3D27D4EB4F)) | U8(1)
        for k in range(PROBES):
            yield (((a + U8(k) * b) >> U8(20)) % U8(len(self.bits))).astype(np.int64)

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Each key's level, 0 if it is not held: membership probes of level 1, 2, ... until one fails."""
        level, alive, q = np.zeros(len(key), np.uint8), np.arange(len(key)), 0
        while len(alive):
            q += 1
            own, left = key[alive], np.arange(len(alive))
            a = mix(own + U8(q * 0x9E3779B97F4A7C15 & LAST))
            b = mix(a ^ U8(0xC2B2AE3D27D4EB4F)) | U8(1)
            for k in range(PROBES):
                place = ((a[left] + U8(k) * b[left]) >> U8(20)) % U8(len(self.bits))
                left = left[self.bits[place.astype(np.int64)]]
            alive = alive[left]
            level[alive] = q
        return level


def _score(buckets: int, ranges: int, n: int, v: int, base: float, weights: tuple[float, float]):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=[c.split()[0] for c in SCORES.split(", ")])
        key, doc = tokens([t or "" for t in docs.column("text").to_pylist()])
        words, of = np.unique(key, return_inverse=True)
        counts = _replied(words, 0, buckets, replies, False)
        first, before, pair, triple = ngrams(key, doc)
        count, context = counts[of], counts[np.searchsorted(words, before)]
        share = (count + 0.5) / (n + 0.5 * (v + 1))
        own, which = np.unique(pair, return_inverse=True)
        level = _replied(own, buckets, ranges, replies, True)[which]
        seen = np.minimum(least_of(level, base), np.minimum(count, context))
        likely = (seen + weights[0] * share) / (context + weights[0])
        later = np.flatnonzero(~first)
        own, which = np.unique(triple[later], return_inverse=True)
        held = most_of(level[later - 1], base)  # of the pair before
        seen = np.minimum(least_of(_replied(own, buckets + ranges, ranges, replies, True)[which], base), np.minimum(held, seen[later]))
        likely[later] = (seen + weights[1] * likely[later]) / (held + weights[1])
        per = lambda x: np.bincount(doc, weights=x, minlength=docs.num_rows)
        return pa.table({
            "doc_id": docs.column("doc_id"),
            "held_out": docs.column("held_out"),
            "n_tokens": pa.array(np.bincount(doc, minlength=docs.num_rows), pa.int64()),
            "n_known": pa.array(np.bincount(doc[count > 0], minlength=docs.num_rows), pa.int64()),
            "base_score": pa.array(per(np.log10(share))),
            "score": pa.array(per(np.log10(likely))),
        })

    return run


def score_documents(docs: DataFrame, held_out_fold: int = 1, base: float = 1.5, weights: tuple[float, float] = (1000.0, 20.0), block_bytes: int = 8 << 20) -> DataFrame:
    """Scores of every whole text of documents(doc_id, text) under a model of the documents outside the fold.

    Words are runs outside ASCII white space with A-Z lower-cased; each document also has one end.
    Returns doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score
    (log10 by word shares alone) and score (log10 by pairs and triples, see above). base: step of the
    quantised counts; weights: a and b.

    A level is read too high with probability 2**-12, never too low. Null and empty texts have the end
    alone. A null doc_id is in training. Rows stay one for one; other columns are ignored. Words are
    told apart by 64-bit hashes, pairs and triples by 48 bits. Documents that are not read from files
    are written to the shared folder first, so that lost tasks see the same rows again.
    """
    rows, blocks = in_runs(docs, block_bytes)
    blocked = rows.withColumn("held_out", is_fold(F.col("doc_id"), held_out_fold))
    buckets, ranges = max(1, blocks // 4), blocks
    asked = blocked.mapInArrow(kernels.giving_back(_ask(buckets, ranges)), ASKED)
    counts = cut_lineage(asked.groupBy("bucket").applyInArrow(kernels.giving_back(_count(buckets, base)), REPLIED), "counts")
    sums = [np.frombuffer(r.counts, "<i8") for r in counts.where("block = -1").select("counts").toLocalIterator()]
    n, v = (int(x) for x in np.sum(sums, axis=0)) if sums else (0, 0)
    score = kernels.giving_back(_score(buckets, ranges, n, v, base, weights))
    scored = blocked.groupBy("block").cogroup(counts.where("block >= 0").groupBy("block")).applyInArrow(score, SCORES)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))
