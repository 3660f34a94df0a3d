"""Quality classifier by positive-unlabelled learning.

Trusted positives are the rows labelled 1, unlabelled are all documents of
the corpus. Each document is described by ratios over its whole text (kinds
of bytes, repeated words and runs of words, word lengths), each cut into bins
at fixed edges; the score is a logistic function of one weight for each bin.
The weights minimise the non-negative unbiased risk

    pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))

by gradient descent over all documents: every step sums the gradient over the
saved bins in Spark, and where the second part is negative its gradient is
reversed. The class prior pi is estimated first, from a plain positive-
against-unlabelled classifier: the least ratio of the shares of unlabelled and
of positive rows above a score, over scores that enough positives exceed.

Null and empty texts have ratios of 0 and are scored like any other. Without
trusted positives every score is 0. Repeated rows each get a score; labels
with a null doc_id or label are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.tables import saved
from tallyspark.llm.words import SPACED, portions, split

THRESHOLD = 0.3
_SHARES = (0.0, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8)
_RATIOS = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
_SIZES = (1, 3, 8, 20, 50, 120, 300, 800, 2000, 6000)
#: Fixed bin edges of each feature.
EDGES = {
    "upper": _SHARES,
    "digit": _SHARES,
    "sentence": _SHARES,
    "sign": _SHARES,
    "space": (0.02, 0.06, 0.1, 0.13, 0.15, 0.17, 0.2, 0.25, 0.35, 0.5),
    "control": _SHARES,
    "word_length": (2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 10, 15),
    "words": _SIZES,
    "distinct_words": _RATIOS,
    "distinct_pairs": _RATIOS,
    "distinct_fives": _RATIOS,
    "same_as_before": _SHARES,
    "most_frequent": _SHARES,
}
WIDTH = max(map(len, EDGES.values())) + 1
N_WEIGHTS = len(EDGES) * WIDTH + 1
_KIND = np.full(256, 3, np.int64)
_KIND[65:91] = 0
_KIND[48:58] = 1
_KIND[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[*range(9), *range(14, 32), 127]] = 5
_KIND[[*range(97, 123), *range(128, 256)]] = 6
KINDS = 7


def _distinct(owner: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    """How many distinct values, by 44 bits of their hashes, each document has."""
    key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] >> np.uint64(44)).astype(np.int64), minlength=docs)


def described(texts: pa.Array) -> np.ndarray:
    """One row of bins for each text."""
    docs = len(texts)
    raw = texts.fill_null(b"")
    length = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    kind = _KIND[data] + KINDS * np.repeat(np.arange(docs), length)
    kinds = np.bincount(kind, minlength=docs * KINDS).reshape(docs, KINDS)
    size = np.maximum(length, 1)
    words = split(texts, SPACED)
    n = words.counts
    owner = np.repeat(np.arange(docs), n)
    codes = words.codes
    lengths = np.bincount(owner, weights=np.fromiter(map(len, words.vocab), np.int64, len(words.vocab))[codes], minlength=docs)

    def runs(width: int) -> np.ndarray:
        m = max(0, len(codes) - width + 1)
        value = np.zeros(m, np.uint64)
        for j in range(width):
            value = (value + codes[j : j + m].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(32)
        whole = owner[:m] == owner[width - 1 : width - 1 + m] if m else np.zeros(0, bool)
        return _distinct(owner[:m][whole], value[whole], docs) / np.maximum(n - width + 1, 1)

    same = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1]) if len(codes) else np.zeros(0, bool)
    pair, count = np.unique(owner * max(len(words.vocab), 1) + codes, return_counts=True)
    most = np.zeros(docs)
    np.maximum.at(most, pair // max(len(words.vocab), 1), count)
    some = np.maximum(n, 1)
    values = {
        "upper": kinds[:, 0] / size,
        "digit": kinds[:, 1] / size,
        "sentence": kinds[:, 2] / size,
        "sign": kinds[:, 3] / size,
        "space": kinds[:, 4] / size,
        "control": kinds[:, 5] / size,
        "word_length": lengths / some,
        "words": n,
        "distinct_words": np.bincount(pair // max(len(words.vocab), 1), minlength=docs) / some,
        "distinct_pairs": runs(2),
        "distinct_fives": runs(5),
        "same_as_before": np.bincount(owner[1:][same], minlength=docs) / some if len(codes) else np.zeros(docs),
        "most_frequent": most / some,
    }
    return np.stack([np.searchsorted(edges, values[k], side="left") for k, edges in EDGES.items()], axis=1).astype(np.uint8)


def _flat(bins: pa.Array, rows: int) -> np.ndarray:
    """Positions of each row's weights; the last is the intercept."""
    b = np.frombuffer(b"".join(bins.to_pylist()), np.uint8).reshape(rows, len(EDGES))
    at = b + WIDTH * np.arange(len(EDGES))
    return np.concatenate([at, np.full((rows, 1), N_WEIGHTS - 1)], axis=1)


def binned(docs: DataFrame, positives: DataFrame) -> DataFrame:
    """(doc_id, bins, positive) of every document, saved; positives are ids, each once."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text"):
            b = described(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in b], pa.binary())], ["doc_id", "bins"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("_text")).mapInArrow(describe, f"doc_id {kind}, bins binary")
    marked = rows.join(positives.select("doc_id").distinct().withColumn("positive", F.lit(1)), "doc_id", "left")
    return saved(marked.select("doc_id", "bins", F.coalesce("positive", F.lit(0)).alias("positive")), "quality-bins")


def _summed(rows: DataFrame, function, size: int) -> np.ndarray:
    """The sum over all batches of a vector function(flat positions, positive)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += function(_flat(batch.column("bins"), batch.num_rows), np.asarray(batch.column("positive")).astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    parts = rows.select("bins", "positive").mapInArrow(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in parts:
        out[r["i"]] = r["v"]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _step_sums(w: np.ndarray):
    """Function for _summed: gradients of the logistic losses and their sums, apart by part of the risk."""

    def sums(at: np.ndarray, positive: np.ndarray) -> np.ndarray:
        g = w[at].sum(axis=1)
        p = _sigmoid(g)
        out = np.zeros(3 * N_WEIGHTS + 4)
        for k, weight in enumerate((np.where(positive, p - 1, 0.0), np.where(positive, p, 0.0), p)):  # R_p(+1), R_p(-1), R_u(-1)
            out[k * N_WEIGHTS : (k + 1) * N_WEIGHTS] = np.bincount(at.ravel(), weights=np.repeat(weight, at.shape[1]), minlength=N_WEIGHTS)
        loss = np.logaddexp(0, g)
        out[-4:] = positive.sum(), len(g), loss[positive].sum(), loss.sum()
        return out

    return sums


def _descend(rows: DataFrame, prior: float | None, steps: int, w: np.ndarray, rate: float = 0.25, decay: float = 2e-4) -> np.ndarray:
    """Adam on the risk; without a prior on plain positive against unlabelled, both halves alike."""
    m, v = np.zeros(N_WEIGHTS), np.zeros(N_WEIGHTS)
    for t in range(1, steps + 1):
        s = _summed(rows, _step_sums(w), 3 * N_WEIGHTS + 4)
        n_p, n_u, loss_p, loss_u = s[-4:]
        plus, minus, unlabelled = (s[k * N_WEIGHTS : (k + 1) * N_WEIGHTS] / n for k, n in ((0, n_p), (1, n_p), (2, n_u)))
        if prior is None:
            gradient = (plus + unlabelled) / 2
        else:
            rest = loss_u / n_u - prior * loss_p / n_p
            gradient = prior * plus + unlabelled - prior * minus if rest >= 0 else prior * minus - unlabelled
        gradient = gradient + decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def class_prior(rows: DataFrame, w: np.ndarray, least: float = 0.2, cells: int = 512) -> float:
    """Share of positives among all rows: the least ratio of tails, over scores that a share of at least least of the positives exceed."""

    def tails(at: np.ndarray, positive: np.ndarray) -> np.ndarray:
        cell = np.minimum((_sigmoid(w[at].sum(axis=1)) * cells).astype(np.int64), cells - 1)
        return np.concatenate([np.bincount(cell[positive], minlength=cells), np.bincount(cell, minlength=cells)]).astype(float)

    s = _summed(rows, tails, 2 * cells)
    p, u = s[:cells][::-1].cumsum() / max(s[:cells].sum(), 1), s[cells:][::-1].cumsum() / max(s[cells:].sum(), 1)
    good = p >= least
    return float(np.clip((u[good] / p[good]).min(), 0.02, 0.98)) if good.any() else 0.5


def fit(rows: DataFrame, warm_steps: int = 12, steps: int = 45) -> np.ndarray | None:
    """Weights from saved rows (bins, positive); None without positives."""
    if not rows.filter("positive = 1").limit(1).count():
        return None
    w = _descend(rows, None, warm_steps, np.zeros(N_WEIGHTS))
    return _descend(rows, class_prior(rows, w), steps, w)


def scored(rows: DataFrame, w: np.ndarray | None) -> DataFrame:
    """(doc_id, score) of saved rows."""
    if w is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = w[_flat(batch.column("bins"), batch.num_rows)].sum(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_sigmoid(g))], ["doc_id", "score"])

    return rows.select("doc_id", "bins").mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
