"""Language ID by a byte convolutional network.

Bytes (A-Z lower-cased) become vectors; filters over 2, 3 and 4 of them are rectified, their maximum over a window of fixed length
is what the window holds of each filter, and a softmax over these gives the window's language. A text is all its
windows (each but the last whole, with an overlap of the widest filter less one), weighted by their bytes: the mean of
their log probabilities decides. The network is trained in NumPy, by Adam on cross entropy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .quality import is_fold

WIDTHS, FILTERS, DIMENSIONS, WINDOW = (2, 3, 4), 16, 8, 256
STEP = WINDOW - max(WIDTHS) + 1
#: Windows that go through the network together.
TOGETHER = 512


def windows_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, A-Z lower-cased, as rows of byte numbers from 1 (0 pads the last), and how many bytes each adds."""
    raw = raw.lower()
    n = max(1, -(-(len(raw) - WINDOW) // STEP) + 1)
    padded = np.zeros((n - 1) * STEP + WINDOW, np.uint16)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    padded[: len(raw)] += 1
    new = np.full(n, STEP)
    new[-1] = len(raw) - (n - 1) * STEP
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP], new


class ByteNetwork:
    """Parameters by name: bytes (257, d), w2, w3, w4 (width * d, filters), b2, b3, b4, out (all filters, languages), bias."""

    def __init__(self, languages: list[str], parameters: dict[str, np.ndarray]):
        self.languages, self.parameters = languages, parameters

    @classmethod
    def untrained(cls, languages: list[str], seed: int) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(scale=scale, size=shape).astype(np.float32)
        p = {"bytes": draw(257, DIMENSIONS, scale=0.5)}
        for w in WIDTHS:
            p[f"w{w}"], p[f"b{w}"] = draw(w * DIMENSIONS, FILTERS, scale=(w * DIMENSIONS) ** -0.5), np.zeros(FILTERS, np.float32)
        p["out"], p["bias"] = draw(FILTERS * len(WIDTHS), len(languages), scale=0.1), np.zeros(len(languages), np.float32)
        p["bytes"][0] = 0
        return cls(languages, p)

    def _pooled(self, windows: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter in each window (zeros follow its end), and where it lies if asked for; one place of all windows at a time."""
        p, m, widest = self.parameters, len(windows), max(WIDTHS)
        filters = np.zeros((FILTERS * len(WIDTHS), widest * DIMENSIONS), np.float32)
        for k, w in enumerate(WIDTHS):
            filters[k * FILTERS : (k + 1) * FILTERS, : w * DIMENSIONS] = p[f"w{w}"].T
        by_place = np.ascontiguousarray(windows.T)
        x = np.zeros((WINDOW + widest - 1, DIMENSIONS, m), np.float32)
        for d in range(DIMENSIONS):
            x[:WINDOW, d] = p["bytes"][:, d].take(by_place)
        x = x.reshape(-1, m)
        best, at, own = np.full((len(filters), m), -np.inf, np.float32), np.zeros((len(filters) if places else 0, m), np.int64), np.empty((len(filters), m), np.float32)
        for place in range(WINDOW):
            np.matmul(filters, x[place * DIMENSIONS : (place + widest) * DIMENSIONS], out=own)
            if places:
                at[own > best] = place
            np.maximum(best, own, out=best)
        bias = np.concatenate([p[f"b{w}"] for w in WIDTHS])
        return np.maximum(best.T + bias, 0), at.T

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Log of the softmax for each window, in double precision."""
        out = np.zeros((len(windows), len(self.languages)))
        for lo in range(0, len(windows), TOGETHER):
            z = (self._pooled(windows[lo : lo + TOGETHER])[0] @ self.parameters["out"] + self.parameters["bias"]).astype(float)
            z -= z.max(axis=1, keepdims=True)
            out[lo : lo + TOGETHER] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def gradient(self, windows: np.ndarray, language: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of windows; each filter's share goes through the place of its maximum."""
        p, n = self.parameters, len(windows)
        pooled, at = self._pooled(windows, True)
        z = pooled @ p["out"] + p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), language] -= 1
        z /= n
        g = {"out": pooled.T @ z, "bias": z.sum(axis=0), "bytes": np.zeros_like(p["bytes"])}
        back = (z @ p["out"].T) * (pooled > 0)
        padded = np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)))
        for k, w in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            which = padded[np.arange(n)[:, None, None], at[:, own, None] + np.arange(w)]
            g[f"w{w}"] = np.einsum("nfp,nf->pf", p["bytes"][which].reshape(n, FILTERS, -1), back[:, own])
            g[f"b{w}"] = back[:, own].sum(axis=0)
            np.add.at(g["bytes"], which.reshape(-1), (back[:, own, None] * p[f"w{w}"].T).reshape(-1, DIMENSIONS))
        g["bytes"][0] = 0
        return g

    @classmethod
    def fit(cls, windows: np.ndarray, language: np.ndarray, languages: list[str], epochs: int, seed: int, rate: float = 0.01) -> ByteNetwork:
        """Adam over batches of 64 windows in random order; the rate falls to a tenth."""
        net, rng = cls.untrained(languages, seed), np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in net.parameters.items()}
        second = {k: np.zeros_like(v) for k, v in net.parameters.items()}
        steps, t = epochs * -(-len(windows) // 64), 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(windows), 64):
                t += 1
                for k, g in net.gradient(windows[order[lo : lo + 64]], language[order[lo : lo + 64]]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    step = rate * 10 ** (-t / steps) / (1 - 0.9**t)
                    net.parameters[k] -= step * first[k] / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        return net


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _drawn(count: int, seed: int):
    """Up to `count` windows of each text with a letter, drawn by the text's own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, names = [], []
            for text, lang, draw in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "draw")), strict=True):
                if _has_letter(text):
                    windows, new = windows_of(text.encode("utf-8", "surrogatepass"))
                    rng = np.random.default_rng([seed, draw & (1 << 63) - 1])
                    for i in rng.choice(len(new), size=min(count, len(new)), replace=False, p=np.maximum(new, 1) / np.maximum(new, 1).sum()):
                        own.append(windows[i].astype("<u2").tobytes())
                        names.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(own, pa.binary())], names=["lang", "bytes"])

    return run


def train(docs: DataFrame, fold: int = 2, folds: int = 4, texts_per_language: int = 500, windows_per_text: int = 4, most_languages: int = 256, epochs: int = 4, seed: int = 5) -> ByteNetwork:
    """Fit on text and lang of documents outside the held-out fold.

    The fit is bounded: of each of the most_languages most frequent values of lang about texts_per_language texts (at
    most four times that), drawn by a hash of the row, and windows_per_text windows of each. Null langs and texts
    without a letter teach nothing. Without any text to learn from there is no language.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_fold(F.col("doc_id"), fold, folds))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return ByteNetwork.untrained([], seed)
    share = docs.sparkSession.createDataFrame([(r.lang, float(min(1, texts_per_language / r["count"]))) for r in counts], "lang string, share double")
    drawn = rows.select("text", "lang", F.xxhash64("doc_id", "text", F.lit(seed)).alias("draw")).join(F.broadcast(share), "lang")
    drawn = drawn.where((F.shiftrightunsigned("draw", 11) * 2.0**-53) < F.col("share"))
    most = len(counts) * texts_per_language * windows_per_text * 4
    got = sorted((r.lang, bytes(r.bytes)) for r in drawn.select("text", "lang", "draw").mapInArrow(_drawn(windows_per_text, seed), "lang string, bytes binary").limit(most).collect())
    languages = sorted({lang for lang, _ in got})
    number = {lang: i for i, lang in enumerate(languages)}
    if not got:
        return ByteNetwork.untrained([], seed)
    windows = np.frombuffer(b"".join(raw for _, raw in got), "<u2").reshape(-1, WINDOW)
    return ByteNetwork.fit(windows, np.array([number[lang] for lang, _ in got]), languages, epochs, seed)


def predict(texts: list[str | None], net: ByteNetwork) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    batch, of, weight, held, sums = [], [], [], 0, np.zeros((len(texts), len(net.languages)))

    def flush() -> None:
        if batch:
            logs = net.log_probabilities(np.concatenate(batch)) * np.concatenate(weight)[:, None]
            np.add.at(sums, np.concatenate(of), logs)

    sizes = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not net.languages or not _has_letter(text):
            continue
        raw = text.encode("utf-8", "surrogatepass")
        sizes[i] = len(raw)
        windows, new = windows_of(raw)
        for lo in range(0, len(new), TOGETHER * 8):
            part = slice(lo, lo + TOGETHER * 8)
            batch.append(windows[part])
            of.append(np.full(len(new[part]), i))
            weight.append(np.maximum(new[part], 0))
            held += len(new[part])
            if held >= TOGETHER * 8:
                flush()
                batch, of, weight, held = [], [], [], 0
    flush()
    at = np.flatnonzero(sizes)
    if len(at):
        z = sums[at] / sizes[at, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        best = z.argmax(axis=1)
        scores[at] = z[np.arange(len(at)), best]
        for i, b in zip(at.tolist(), best.tolist(), strict=True):
            names[i] = net.languages[b]
    return names, scores


def predict_languages(docs: DataFrame, net: ByteNetwork) -> DataFrame:
    """docs with lang_pred and score (0 to 1) added; columns of those names are replaced.

    Only text decides. A null text and one without a letter (a character that Unicode calls alphabetic) are `und`
    with score 0, as are all texts of a network without languages. Every window of a text counts; rows stay one for one.
    """
    rows = docs.drop("lang_pred", "score")
    schema = ", ".join([*([rows._jdf.schema().toDDL()] if rows.columns else []), "lang_pred string, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column("text").to_pylist(), net)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(kernels.giving_back(run), schema)
