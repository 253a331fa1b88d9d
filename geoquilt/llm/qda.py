"""Document quality by regularised quadratic discriminant analysis.

A text becomes a vector of transformed statistics. Each class is a Gaussian whose covariance is
shrunk towards the pooled one and towards the pooled diagonal; the score is the logistic of the
difference of the two log densities, from Mahalanobis distances by Cholesky factors that are
computed once and travel to the workers with the function.

Labels are taken as noisy: after a first fit, rows whose label the model finds very unlikely are
set aside and the model is fitted again. Every text gets a score: null counts as empty, and
the statistics of an empty text are all defined. Nothing but the text enters a score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquilt.llm.common import labelled_sample

#: Labelled rows that the model is fitted on, at most.
MAX_TRAINING = 20_000
THRESHOLD = 0.3
#: Share of the pooled covariance in a class's, and of its diagonal in that.
TO_POOLED, TO_DIAGONAL = 0.3, 0.2
#: Labels with less than this probability after the first fit are left out of the second.
UNLIKELY = 0.02

_DROP = {
    "upper": bytes(range(65, 91)),
    "digit": bytes(range(48, 58)),
    "stop": b".,",
    "mark": b"!?",
    "quote": b"\"'():;-",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
    "break": b"\n",
    "space": b" \t\r\v\f",
    "wide": bytes(range(128, 256)),
}


#: Units of a text, on top of its own, that count as ordinary in its shares.
ORDINARY = 15.0


def counts(text: str) -> list[float]:
    """Raw counts of one text: three sizes, a mean, then parts and wholes of shares."""
    data = text.encode()
    size = len(data)
    words = data.lower().split()
    lines = [x for x in data.split(b"\n") if x]
    n = len(words)
    out = [size, n, len(lines), n / max(len(lines), 1)]
    for drop in _DROP.values():
        out += [size - len(data.translate(None, drop)), size]
    sizes = np.fromiter(map(len, words), np.int64, n)
    out += [
        int(sizes.sum()), 12 * n,
        int(sizes.max(initial=0)), 60,
        int((sizes <= 3).sum()), n,
        int((sizes >= 12).sum()), n,
        len(set(words)), n,
        len(set(lines)), len(lines),
        data.count(b". ") + data.count(b", ") + data.count(b".\n"), n,
        len(zlib.compress(data, 1)), size,
    ]
    return out


def transformed(raw: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Logarithms of sizes and logits of shares, of rows of counts. A share counts as many as
    ORDINARY units more that have the `ordinary` share, so that a few words say little."""
    part, whole = raw[:, 4::2], raw[:, 5::2]
    share = np.clip((part + ORDINARY * ordinary) / (whole + ORDINARY), 0, 1.5)
    return np.hstack([np.log1p(raw[:, :4]), np.log((share + 0.002) / (1.502 - share))])


def ordinary_shares(raw: np.ndarray) -> np.ndarray:
    return raw[:, 4::2].sum(0) / np.maximum(raw[:, 5::2].sum(0), 1)


@dataclass(frozen=True)
class Model:
    ordinary: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    #: Inverses of the Cholesky factors, and log densities' constants, by class.
    whiten: list[np.ndarray]
    constants: list[float]

    def log_odds(self, raw: np.ndarray) -> np.ndarray:
        z = (transformed(raw, self.ordinary) - self.shift) / self.scale
        density = []
        for mean, whiten, constant in zip(self.means, self.whiten, self.constants, strict=True):
            y = (z - mean) @ whiten.T
            density.append(constant - 0.5 * np.einsum("ij,ij->i", y, y))
        return density[1] - density[0]

    def score(self, raw: np.ndarray) -> np.ndarray:
        # the statistics are correlated, which overstates odds: tempered
        return 1 / (1 + np.exp(-np.clip(self.log_odds(raw) / math.sqrt(len(self.shift)), -30, 30)))


def fit(raw: np.ndarray, y: np.ndarray) -> Model:
    """Without rows of a class, it takes the pooled Gaussian."""
    model = _fit_once(raw, y)
    if len(y):
        p = 1 / (1 + np.exp(-np.clip(model.log_odds(raw), -30, 30)))
        likely = np.where(y == 1, p, 1 - p) >= UNLIKELY
        if min(likely[y == 0].sum(), likely[y == 1].sum()) >= 10:
            model = _fit_once(raw[likely], y[likely], prior=y.mean())
    return model


def _fit_once(raw: np.ndarray, y: np.ndarray, prior: float | None = None) -> Model:
    if not len(raw):
        raw, y = np.zeros((1, raw.shape[1])), np.zeros(1)
    ordinary = ordinary_shares(raw[y == 1] if (y == 1).any() else raw)
    x = transformed(raw, ordinary)
    d = x.shape[1]
    prior = float(y.mean()) if prior is None else prior
    prior = min(max(prior, 0.01), 0.99)
    shift, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - shift) / scale
    # within-class scatter, then shrunk to its diagonal
    centred = z.copy()
    for c in (0, 1):
        if (y == c).any():
            centred[y == c] -= z[y == c].mean(0)
    pooled = centred.T @ centred / len(z) + 1e-3 * np.eye(d)
    target = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
    means, whiten, constants = [], [], []
    for c, share in ((0, 1 - prior), (1, prior)):
        rows = z[y == c]
        if len(rows) > 1:
            mean = rows.mean(0)
            own = np.cov(rows, rowvar=False, bias=True)
            keep = (1 - TO_POOLED) * len(rows) / (len(rows) + d)
            cov = keep * own + (1 - keep) * target
        else:
            mean, cov = z.mean(0), target
        factor = np.linalg.cholesky(cov + 1e-4 * np.eye(d))
        means.append(mean)
        whiten.append(np.linalg.inv(factor))
        constants.append(math.log(share) - float(np.log(np.diag(factor)).sum()))
    return Model(ordinary, shift, scale, means, whiten, constants)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, bound: int = MAX_TRAINING) -> Model:
    """Fitted on at most `bound` labelled documents outside the held-out fold."""

    @F.pandas_udf("array<double>")
    def measured(text: pd.Series) -> pd.Series:
        return text.map(counts)

    sample = labelled_sample(docs, labels, "quality", folds, held, bound)
    rows = sample.select("doc_id", "y", measured("text").alias("x")).toPandas().sort_values("doc_id")
    d = len(counts(""))
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, d)
    return fit(x, rows["y"].to_numpy())


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([counts(t) for t in batch], dtype=float).reshape(len(batch), -1)
            yield pd.Series(model.score(x) if len(batch) else np.empty(0))

    return scored(F.coalesce(text, F.lit("")))
