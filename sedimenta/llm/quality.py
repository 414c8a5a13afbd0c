"""Quality scores by Bradley-Terry pairwise ranking.

A document's score is linear in features of its bytes, words and lines, and of its words hashed to buckets. It is learned from preference
pairs (a document labelled 1 beats one labelled 0) by logistic loss on feature differences. A quantile
of the training scores is the threshold; scores are shifted so that it lies at `cut`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels

#: Classes of bytes; one feature is the share of each.
_CLASSES = [
    range(ord("a"), ord("z") + 1),
    range(ord("A"), ord("Z") + 1),
    range(ord("0"), ord("9") + 1),
    b" ",
    b"\n",
    b".,;:'\"-()",
    b"!?",
    b"#$%&*+/<=>@\\^_`{|}~[]",
    range(0x80, 0x100),
]
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _members in enumerate(_CLASSES):
    _CLASS[list(_members)] = _i
_N = len(_CLASSES) + 1
#: Buckets of hashed words, and the weight of their features beside the others.
BUCKETS, BUCKET_WEIGHT = 64, 0.3
_SUMS = _N + 6 + BUCKETS
_SYMBOLS = np.isin(_CLASS, (6, 7))


def _distinct(doc: np.ndarray, key: np.ndarray, docs: int) -> np.ndarray:
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    first = np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])] if len(d) else np.zeros(0, bool)
    return np.bincount(d[first], minlength=docs)


def _per_doc(parts: list[bytes], of: np.ndarray, docs: int) -> np.ndarray:
    """Sums that features are made of; distinct words, lines and distinct lines are right only of documents in one part."""
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    if not len(raw):
        return np.zeros((docs, _SUMS))
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(of, sizes)
    kind = _CLASS[raw]
    counts = np.bincount(doc * _N + kind, minlength=docs * _N).reshape(docs, _N)
    inside = doc[1:] == doc[:-1]
    same = np.r_[False, inside & (raw[1:] == raw[:-1])]
    again = np.bincount(doc[same & _SYMBOLS[raw]], minlength=docs)
    caps = np.bincount(doc[np.r_[False, inside & (kind[1:] == 1) & (kind[:-1] == 1)]], minlength=docs)
    key, word_at, part = kernels.words(raw, starts)
    word_doc = of[part]
    n_words = np.bincount(word_doc, minlength=docs)
    ends = np.flatnonzero(raw == 0x0A)
    line_start = np.unique(np.r_[starts[sizes > 0], ends[ends + 1 < len(raw)] + 1]).astype(np.int64)
    line_end = np.r_[line_start[1:], len(raw)]
    line_doc = doc[line_start]
    line_key = kernels.span_hashes(raw, line_start, line_end - (raw[line_end - 1] == 0x0A))
    bucket = np.bincount(word_doc * BUCKETS + (key % kernels.U8(BUCKETS)).astype(np.int64), minlength=docs * BUCKETS).reshape(docs, BUCKETS)
    sums = [counts, n_words, _distinct(word_doc, key, docs), np.bincount(line_doc, minlength=docs), _distinct(line_doc, line_key, docs), again, caps, bucket]
    return np.column_stack(sums).astype(float)


def _of_long(text: str) -> np.ndarray:
    """The sums of one text read part by part; what is distinct is kept as hashes over all parts."""
    sums, seen, new, held = np.zeros(_SUMS), np.zeros(0, kernels.U8), [], 0
    lines, n_lines, line, open_bytes = set(), 0, hashlib.blake2b(digest_size=16), 0
    for part in kernels.pieces_of(text, kernels.BATCH // 4):  # cut before a space: no word and no run of symbols or capitals is cut
        raw = part.encode("utf-8", "surrogatepass")
        if not raw:
            continue
        sums += _per_doc([raw], np.zeros(1, np.int64), 1)[0]
        new.append(np.unique(kernels.words(np.frombuffer(raw, dtype=np.uint8), np.zeros(1, np.int64))[0]))
        held += len(new[-1])
        if held > max(len(seen), kernels.BATCH):
            seen, new, held = np.unique(np.concatenate([seen, *new])), [], 0
        for k, piece in enumerate(raw.split(b"\n")):
            if k:
                lines.add(line.digest())
                n_lines, line, open_bytes = n_lines + 1, hashlib.blake2b(digest_size=16), 0
            line.update(piece)
            open_bytes += len(piece)
    if open_bytes:
        lines.add(line.digest())
        n_lines += 1
    sums[_N + 1 : _N + 4] = len(np.unique(np.concatenate([seen, *new]))), n_lines, len(lines)
    return sums


def features(texts: list[str]) -> np.ndarray:
    """One row of features for each text."""
    out, batch, of, held = np.zeros((len(texts), _SUMS)), [], [], 0

    def flush() -> None:
        if batch:
            at = np.array(of)
            base = at[0]
            out[base : at[-1] + 1] += _per_doc(batch, at - base, at[-1] + 1 - base)

    for i, text in enumerate(texts):
        if len(text) > kernels.BATCH // 4:
            out[i] = _of_long(text)
            continue
        raw = text.encode("utf-8", "surrogatepass")
        if held and held + len(raw) > kernels.BATCH:
            flush()
            batch, of, held = [], [], 0
        batch.append(raw)
        of.append(i)
        held += len(raw)
    flush()
    n = out[:, :_N].sum(axis=1)
    share = out[:, :_N] / np.maximum(n, 1)[:, None]
    words, distinct, lines, distinct_lines, again, caps = out[:, _N : _N + 6].T
    w, ln = np.maximum(words, 1), np.maximum(lines, 1)
    columns = [share, np.sqrt(share), np.log1p(n), n / w / 10, distinct / w, words / ln / 20, distinct_lines / ln, np.sqrt(again / w), np.sqrt(caps / w), np.log1p(lines), n > 0, np.sqrt(out[:, _N + 6 :] / w[:, None])]
    return np.column_stack(columns)


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights w that minimise the mean of log(1 + exp(-w.(better - worse))) plus ridge |w|^2 / 2, by Newton steps."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = -(d * p[:, None]).mean(axis=0) + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class QualityModel:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float):
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray, pairs: int, seed: int) -> QualityModel:
        """x: features of labelled documents; good: their labels. Without both labels all documents score alike."""
        mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        scale = np.where(scale > 1e-9, scale, 1)
        scale[-BUCKETS:] /= BUCKET_WEIGHT
        if good.all() or not good.any():
            return cls(mean, scale, np.zeros(x.shape[1]), 0.0 if not len(x) or good.all() else math.inf)
        z = np.clip((x - mean) / scale, -8, 8)
        rng = np.random.default_rng(seed)
        better, worse = z[good], z[~good]
        weights = bradley_terry(better[rng.integers(len(better), size=pairs)], worse[rng.integers(len(worse), size=pairs)])
        scores = z @ weights
        levels = np.linspace(0, 1, 1001)
        cuts = np.quantile(scores, levels)
        kept = np.array([(scores[good] >= c).mean() for c in cuts])
        dropped = np.array([(scores[~good] < c).mean() for c in cuts])
        right = kept + dropped
        level = np.median(levels[right >= right.max() - 1e-12])
        return cls(mean, scale, weights, float(np.quantile(scores, level)))

    def score(self, x: np.ndarray, cut: float) -> np.ndarray:
        """0 to 1; the threshold scores `cut`."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(np.clip(self.threshold - z - math.log(cut / (1 - cut)), -500, 500)))


def is_fold(doc_id: Column, fold: int, folds: int = 5) -> Column:
    """Whether crc32 of doc_id as text falls in the fold; a null id in none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features([t or "" for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])


def train(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000, pairs: int = 60_000, seed: int = 11, held_out: int = 0) -> QualityModel:
    """Fit on labels(doc_id, quality) of documents outside the held-out fold.

    The fit uses the most_labels labels that come first by a hash of doc_id, and that many preference
    pairs drawn from them; both are bounded. A doc_id that repeats counts once, with its least label.
    """
    own = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_fold(F.col("doc_id"), held_out))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    sample = own.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most_labels)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    rows = texts.mapInArrow(_features, "doc_id long, quality int, x array<double>").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("x").alias("x"))
    got = sorted(map(tuple, rows.limit(most_labels).collect()))
    x = np.array([r[2] for r in got]) if got else np.zeros((0, features([""]).shape[1]))
    return QualityModel.fit(x, np.array([r[1] == 1 for r in got], dtype=bool), pairs, seed)


def score_documents(docs: DataFrame, model: QualityModel, cut: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= cut) added; columns of those names are replaced.

    Only text decides. Null and empty texts are scored like any other; rows stay one for one.
    """
    rows = docs.drop("score", "predicted")
    schema = f"{rows._jdf.schema().toDDL()}, score double, predicted int" if rows.columns else "score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(features([t or "" for t in batch.column("text").to_pylist()]), cut)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= cut).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return rows.mapInArrow(kernels.giving_back(run), schema)
