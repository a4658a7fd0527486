"""Quality classifier: ridge regression on random Fourier features of document statistics.

The features approximate a Gaussian kernel; the normal equations are sums over partitions. Scores
of each half of the training rows under the model of the other half fit an isotonic curve, which
makes the final scores probabilities.

Defined cases: a null or empty text has all statistics 0 and is scored like any other; without
labelled training rows every score is 0.5; several labels of one document count as their highest;
null labels are left out; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .store import discard, held_out, partition_sums, stash

STATS = (
    "log_words", "log_bytes", "word_length", "upper", "symbols", "digits", "non_ascii", "symbol_ends", "bare_symbols", "lines",
    "distinct_words", "distinct_pairs", "distinct_fives", "top_word", "longest_run", "stops", "commas", "pipes", "long_words", "capital_words",
)
UPPER, SYMBOL, DIGIT, HIGH = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = DIGIT[48:58] = HIGH[128:] = True
SYMBOL[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = True
#: Limit of a standardised statistic.
CLIP = 6.0
BINS = 4000


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATS`` for each text."""
    words = tk.split(column, lower=False)
    data, n = words.data, len(words)
    out = np.zeros((n, len(STATS)))
    size = np.diff(words.text_off)
    count = words.count

    def per_text(flags: np.ndarray, off: np.ndarray, by: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[off[1:]] - total[off[:-1]]) / np.maximum(by, 1)

    out[:, 0], out[:, 1] = np.log1p(count), np.log1p(size)
    length = words.end - words.start
    out[:, 2] = per_text(length, words.off, count)
    for k, table in ((3, UPPER), (4, SYMBOL), (5, DIGIT), (6, HIGH)):
        out[:, k] = per_text(table[data], words.text_off, size)
    if len(words.start):
        out[:, 7] = per_text(SYMBOL[data[words.end - 1]], words.off, count)
        bare = np.concatenate([[0], np.cumsum(tk.PUNCT[data])])
        out[:, 8] = per_text(bare[words.end] - bare[words.start] == length, words.off, count)
        out[:, 18] = per_text(length > 20, words.off, count)
        out[:, 19] = per_text(UPPER[data[words.start]], words.off, count)
    for k, byte in ((9, 10), (15, 46), (16, 44), (17, 124)):
        out[:, k] = per_text(data == byte, words.text_off, count)
    hashes = tk.word_hashes(tk.Words(tk.LOWER[data], words.text_off, words.start, words.end, words.off))
    pairs, fives = tk.window_hashes(hashes, 2), tk.window_hashes(hashes, 5)
    for i in range(n):
        a, b = words.off[i], words.off[i + 1]
        if b <= a:
            continue
        own = np.sort(hashes[a:b])
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        out[i, 10], out[i, 13] = (len(edge) - 1) / (b - a), np.diff(edge).max() / (b - a)
        for k, (grams, m) in ((11, (pairs, 2)), (12, (fives, 5))):
            g = np.sort(grams[a : b - m + 1]) if b - a >= m else own[:1]
            out[i, k] = (1 + np.count_nonzero(g[1:] != g[:-1])) / max(len(g), 1)
        same = np.flatnonzero(np.concatenate([[True], hashes[a + 1 : b] != hashes[a : b - 1], [True]]))
        out[i, 14] = np.log1p(np.diff(same).max())
    return out


def statistics_table(docs: DataFrame, row: str) -> DataFrame:
    """``row``, doc_id and the statistics of each document, read from whole texts."""

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch):
                values = statistics(part.column(2))
                flat = pa.array(values.ravel(), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.FixedSizeListArray.from_arrays(flat, len(STATS)).cast(pa.list_(pa.float64()))], ["id", "doc_id", "stats"])

    kinds = [docs.schema[c].dataType.simpleString() for c in (row, "doc_id")]
    return docs.select(F.col(f"`{row}`").alias("id"), "doc_id", "text").mapInArrow(run, f"id {kinds[0]}, doc_id {kinds[1]}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, len(STATS))


@dataclass
class Model:
    """Standardisation, Fourier frequencies and phases, ridge weights, and the isotonic curve's knots."""

    mean: np.ndarray
    spread: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: np.ndarray
    level: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -CLIP, CLIP)
        z = np.cos(x @ self.freq + self.phase) * np.sqrt(2.0 / self.freq.shape[1])
        return np.hstack([z, np.ones((len(x), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.level):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.features(stats) @ self.weight, self.knots, self.level), 0.0, 1.0)


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: nondecreasing means of ``y / n`` in the order of ``x``."""
    blocks: list[list[float]] = []
    for a, w, s in zip(x, n, y):
        blocks.append([a * w, w, s])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(training: DataFrame, features: int = 320, ridge: float = 1e-3, seed: int = 11) -> Model:
    """``training``: stats, label (0 or 1) and half (0 or 1). All rows are used."""
    d = len(STATS)
    rng = np.random.default_rng(seed)
    freq, phase = rng.normal(0.0, 1.0 / np.sqrt(d), (d, features)), rng.uniform(0.0, 2 * np.pi, features)

    def moments(batches):
        total = np.zeros(2 * d + 1)
        for b in batches:
            x = _matrix(b.column(0))
            total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        return total

    m = partition_sums(training.select("stats"), moments, (2 * d + 1,))
    if not m[0]:
        return Model(np.zeros(d), np.ones(d), freq, phase, np.zeros(features + 1), np.zeros(0), np.zeros(0))
    mean = m[1 : d + 1] / m[0]
    spread = np.sqrt(np.maximum(m[d + 1 :] / m[0] - mean**2, 0.0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), freq, phase, np.zeros(features + 1), np.zeros(0), np.zeros(0))
    k = features + 1

    def normal(batches):
        total = np.zeros((2, k, k + 1))
        for b in batches:
            z, y, half = model.features(_matrix(b.column(0))), np.asarray(b.column(1), dtype=np.float64), np.asarray(b.column(2))
            for h in (0, 1):
                total[h] += z[half == h].T @ np.hstack([z, y[:, None]])[half == h]
        return total.ravel()

    parts = partition_sums(training.select("stats", "label", "half"), normal, (2, k, k + 1))

    def solve(a: np.ndarray) -> np.ndarray:
        # the last unknown is the intercept, which is not shrunk
        return np.linalg.solve(a[:, :k] + np.diag([ridge * max(a[-1, k - 1], 1.0)] * features + [1e-9]), a[:, k])

    halves = [solve(parts[1]), solve(parts[0])]
    model.weight = solve(parts[0] + parts[1])

    def curve(batches):
        total = np.zeros((BINS, 3))
        for b in batches:
            z, y, half = model.features(_matrix(b.column(0))), np.asarray(b.column(1), dtype=np.float64), np.asarray(b.column(2))
            s = np.where(half == 0, z @ halves[0], z @ halves[1])
            at = np.clip((s + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
            for j, v in enumerate((np.ones(len(s)), s, y)):
                total[:, j] += np.bincount(at, v, BINS)
        return total.ravel()

    c = partition_sums(training.select("stats", "label", "half"), curve, (BINS, 3))
    c = c[c[:, 0] > 0]
    model.knots, model.level = isotonic(c[:, 1] / c[:, 0], c[:, 0], c[:, 2])
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, features: int = 320, row: str = "doc_id") -> DataFrame:
    """``row``, held_out, score and predicted of every document; labels of held-out documents are not used.

    ``row`` names the column that tells rows apart in the result; labels always go by doc_id.
    """
    stats = stash(statistics_table(docs, row), "quality-stats")
    labels = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).where(~held_out())
    half = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 >= 5).cast("int")
    training = stash(stats.join(labels, "doc_id").select("stats", "label", half.alias("half")), "quality-train")
    model = fit(training, features)
    discard(training)

    def run(batches):
        for b in batches:
            score = model.score(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "doc_id", "score", "predicted"])

    kinds = [docs.schema[c].dataType.simpleString() for c in (row, "doc_id")]
    scored = stats.mapInArrow(run, f"id {kinds[0]}, doc_id {kinds[1]}, score double, predicted int")
    return scored.select(F.col("id").alias(row), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
