"""Quality classifier by positive-unlabelled learning.

A logistic model minimises the non-negative unbiased risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with trusted
positives, unlabelled text and an estimated class prior. Where the second term falls below zero its gradient is turned round, so
that the model doesn't fit the positives among the unlabelled texts. Label 0 is never learned from.

The prior is estimated from positives and unlabelled texts alone: a first model tells them apart; among the texts that it was not
fitted on, the share of unlabelled over the share of positives above a threshold is at least the prior, and nearly equals it
where the threshold leaves hardly any negatives. The threshold with the least upper bound of that ratio is taken.

Features of the whole text: trigrams of character classes (lower case, upper case, digit, beyond ASCII, each other character
itself), hashed, and bins of the share of distinct words, of words that repeat the word before, of the number of
words, their mean length and the share of upper case.

Fitting uses bounded samples by a hash of doc_id: about ``positives`` trusted and ``unlabelled`` other documents, whatever the
corpus; so the driver holds a bounded matrix.

Cases: null and empty texts are scored like any text, from their bins; no positive label: every score is the prior, 0; rows
repeated are scored alike; a doc_id with several labels is trusted if one of them is 1; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunklake.llm.features import collected, ngrams, unit_hash
from chunklake.llm.tokens import chunks

DIMS = 512
CLASSES = bytes(ord("u") if c >= 128 else ord("a") if 97 <= c <= 122 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))
BINS = {
    "distinct": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "repeats": (0.001, 0.01, 0.03, 0.1, 0.2, 0.4, 0.6, 0.8),
    "words": (1, 3, 6, 12, 25, 50, 100, 400, 1600, 6400),
    "length": (1.5, 3, 4, 5, 6, 7, 8, 10, 14),
    "upper": (0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7),
}
WIDTH = DIMS + sum(len(v) + 1 for v in BINS.values())
UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)


def statistics(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return 1.0, 0.0, 0.0, 0.0, 0.0
    letters = sum(map(len, words))
    return len(set(words)) / n, sum(map(eq, words, words[1:])) / n, float(n), letters / n, len(text.translate(None, UPPER)) / letters


def vectors(texts: list[bytes]) -> np.ndarray:
    stats = np.array([statistics(t) for t in texts]).reshape(len(texts), len(BINS))
    cols = [ngrams(texts, CLASSES, DIMS, (1, 3))]
    for k, edges in enumerate(BINS.values()):
        cols.append(0.5 * np.eye(len(edges) + 1, dtype=np.float32)[np.searchsorted(edges, stats[:, k], side="right")])
    return np.hstack(cols)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x @ self.weights).astype(np.float64) + self.bias, -60, 60)))


def _descended(rows: int, gradient: Callable[[np.ndarray], np.ndarray], steps: int, rate: float) -> np.ndarray:
    """Weights after ``steps`` steps of Adam."""
    w = np.zeros(rows)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, ridge: float = 1e-5) -> Model:
    """Minimises the non-negative risk with logistic loss (all rows in each step)."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH, np.float32), -60.0, 0.0)
    p, u = _with_one(positive), _with_one(unlabelled)

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w.astype(np.float32), u @ w.astype(np.float32)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_positive = prior * (p.T @ (sp - 1)) / len(p)
        g_negative = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        return (g_positive + g_negative if negative >= 0 else -g_negative) + ridge * w

    w = _descended(p.shape[1], gradient, steps, rate)
    return Model(w[:-1].astype(np.float32), float(w[-1]), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300, rate: float = 0.05, ridge: float = 1e-3, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled, as the mean of two: each from the half that the model which ranks it was not fitted on."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    p, u = _with_one(positive), _with_one(unlabelled)

    def estimate(fit_p: np.ndarray, fit_u: np.ndarray, own_p: np.ndarray, own_u: np.ndarray) -> float:
        def gradient(w: np.ndarray) -> np.ndarray:
            sp, su = (1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -60, 60))) for x in (fit_p, fit_u))
            return (fit_p.T @ (sp - 1)) / len(fit_p) + (fit_u.T @ su) / len(fit_u) + ridge * w

        w = _descended(p.shape[1], gradient, steps, rate)
        by_p, by_u = np.sort(own_p @ w), np.sort(own_u @ w)
        above_p = 1 - np.arange(len(by_p)) / len(by_p)  # share of positives at or above each one
        above_u = 1 - np.searchsorted(by_u, by_p, side="left") / len(by_u)
        slack = np.sqrt(np.log(4 / doubt) / 2 / len(by_u)) + np.sqrt(np.log(4 / doubt) / 2 / len(by_p))
        at = int(np.argmin((above_u + slack) / above_p))
        return float(above_u[at] / above_p[at])

    halves = (p[::2], u[::2]), (p[1::2], u[1::2])
    return float(np.clip((estimate(*halves[0], *halves[1]) + estimate(*halves[1], *halves[0])) / 2, 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000) -> Model:
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    n = good.count()
    if not n:
        return nn_pu(np.zeros((0, WIDTH)), np.zeros((0, WIDTH)), 0.0)
    total = docs.count()
    trusted = good.where(unit_hash(31) < positives / n).select(F.col("doc_id").alias("trusted"))
    # about ``positives`` rows: the bound is a parameter
    both = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted"), "left")
    free = unit_hash(32) < unlabelled / max(1, total)
    kinds, x = collected(both.where(F.col("trusted").isNotNull() | free), F.concat(F.col("trusted").isNotNull().cast("int").cast("string"), free.cast("int").cast("string")), vectors)
    kinds = np.array(kinds, object)
    p, u = x[np.isin(kinds, ["10", "11"])], x[np.isin(kinds, ["01", "11"])]
    return nn_pu(p, u, estimated_prior(p, u))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for c in chunks(iter([b])):
                s = model.score(vectors([t or b"" for t in c.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([c.column(0).cast(pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(batches, "doc_id long, score double")
