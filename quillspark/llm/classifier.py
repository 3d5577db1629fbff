"""Quality classifier: Naive Bayes log-count ratios under a linear support vector machine.

Indicators of hashed n-grams (four-byte grams, words, word pairs) and, an extension of the
method, of how many of the text's word pairs and triples repeat are scaled by their class
log-count ratios; the linear hinge-loss model over them is fitted by dual coordinate
descent, and a logistic curve maps its margin to a score from 0 to 1. The curve is fitted on a
sample with as many rows of either class; the classes' counts over all labelled rows put
the prior right.

The fit sees at most :data:`MOST_TRAINING` labelled rows, those with the least hash of their
key in each class (a documented bound; whole texts). A key with both labels teaches nothing; of rows
that repeat a key one is used. Everything else covers all rows. Null and empty
texts have no indicators and get the score of the bare intercept. If the training rows
hold one class only, or none, the score is that class's smoothed share for every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .hashing import U, _BASE, mix, words

#: Labelled rows the model is fitted on, half from each class where there are so many.
MOST_TRAINING = 6000
BITS = 17
SMOOTHING, COST, EPOCHS, SEED = 1.0, 1.0, 12, 7
#: Part of the training rows that the logistic curve is fitted on, one in so many.
HELD_FOR_CURVE = 5
#: Shares of repeated pairs and triples that have an indicator, and how often each counts.
LEVELS, WEIGHT = (0.02, 0.05, 0.1, 0.2, 0.4, 0.8), 8
SIZE = (3 << BITS) + 2 * len(LEVELS) * WEIGHT
_MASK = U((1 << BITS) - 1)
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Distinct hashed n-grams of each row, sorted."""
    rows = len(offsets) - 1
    h, first = words(data, offsets)
    one = ((h & _MASK) + (U(1) << U(BITS))).astype(np.int32)
    pair = ((mix(h[:-1] * U(3) + h[1:] * _BASE) & _MASK) + (U(2) << U(BITS))).astype(np.int32) if len(h) > 1 else np.zeros(0, np.int32)
    low = _LOWER[data]
    n = len(low)
    gram = np.zeros(0, np.int32)
    if n >= 4:
        x = low[: n - 3] | low[1 : n - 2] << 8 | low[2 : n - 1] << 16 | low[3:] << 24
        gram = ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    triple = h[:-2] * U(3) + h[1:-1] * U(5) + h[2:] * _BASE if len(h) > 2 else np.zeros(0, np.uint64)
    marks = np.arange(2 * len(LEVELS) * WEIGHT, dtype=np.int32) + (3 << BITS)
    out = []
    for i in range(rows):
        a, b, p, q = offsets[i], offsets[i + 1], first[i], first[i + 1]
        parts = [gram[a : max(a, b - 3)], one[p:q], pair[p : max(p, q - 1)]]
        if q - p > 2:
            twice = (h[p + 1 : q] == h[p : q - 1]).mean()
            again = 1 - len(np.unique(triple[p : q - 2])) / (q - p - 2)
            for k, share in enumerate((twice, again)):
                n_levels = sum(share >= x for x in LEVELS)
                parts.append(marks[k * len(LEVELS) * WEIGHT :][: n_levels * WEIGHT])
        out.append(np.unique(np.concatenate(parts)))
    return out


@dataclass
class Model:
    """Weights for each indicator (the log-count ratio is multiplied in), intercept, curve."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        z = np.array([self.weights[r].sum() / np.sqrt(max(1, len(r))) for r in rows]) + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on the indicator sets ``rows`` and 0/1 ``labels``."""
    size = SIZE
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    positive = (y > 0).sum()
    if positive in (0, len(y)):
        share = (positive + 1) / (len(y) + 2)
        return Model(np.zeros(size, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    count = {s: np.full(size, SMOOTHING) for s in (1.0, -1.0)}
    for r, s in zip(rows, y, strict=True):
        count[s][r] += 1
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    curve = np.arange(len(y)) % HELD_FOR_CURVE == 0
    if len(set(y[curve])) < 2 or len(set(y[~curve])) < 2:
        curve[:] = False
    rng = np.random.default_rng(SEED)
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    scale = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([x @ x + 1 for x in scale])
    # the classes weigh the same together
    cost = np.where(y > 0, COST * len(y) / (2 * positive), COST * len(y) / (2 * (len(y) - positive)))
    train = np.flatnonzero(~curve)
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            r, x = rows[i], scale[i]
            g = y[i] * (w[r] @ x + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * x
                b += step
                alpha[i] = new
    used = np.flatnonzero(curve) if curve.any() else train
    z = np.array([w[rows[i]] @ scale[i] + b for i in used])
    t = y[used] > 0
    k, c = 1.0, 0.0
    target = np.where(t, (t.sum() + 1) / (t.sum() + 2), 1 / ((~t).sum() + 2))
    for _ in range(50):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(k * z + c, -30, 30)))
        e, v = p - target, np.maximum(p * (1 - p), 1e-6)
        hkk, hkc, hcc = (v * z * z).sum() + 1e-3, (v * z).sum(), v.sum() + 1e-3
        gk, gc, det = (e * z).sum() + 1e-3 * (k - 1), e.sum(), hkk * hcc - hkc * hkc
        dk, dc = (hcc * gk - hkc * gc) / det, (hkk * gc - hkc * gk) / det
        k, c = k - dk, c - dc
        if abs(dk) + abs(dc) < 1e-8:
            break
    return Model((w * ratio).astype(np.float32), float(b), float(max(k, 1e-3)), float(c))


def train(docs: DataFrame, labels: DataFrame, target: str, key: str = "doc_id", text: str = "text", most: int = MOST_TRAINING) -> Model:
    """Fit on at most ``most`` rows of ``labels``: those with the least hash of their key in each class."""
    named = labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{target}`").cast("int").alias("_y")).where("_y in (0, 1) AND _key IS NOT NULL")
    named = named.groupBy("_key").agg(F.min("_y").alias("_y"), F.max("_y").alias("_most")).where("_y = _most").drop("_most")
    chosen = None
    for y in (0, 1):
        part = named.where(F.col("_y") == y).orderBy(F.xxhash64("_key"), "_key").limit(most // 2)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_key")
    # of rows that repeat a key the one with the least text hash: the bound holds, and the choice
    rows = rows.groupBy("_key", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, 1 << 21):
                part = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                packed = pa.array([x.tobytes() for x in part], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], packed], names=["key", "y", "x"])

    kind = docs.schema[key].dataType.simpleString()
    got = rows.select("_key", "_text", "_y").mapInArrow(run, f"key {kind}, y int, x binary").collect()
    got.sort(key=lambda r: (str(r[0]), bytes(r[2])))  # the order of arrival must not matter
    model = fit([np.frombuffer(r[2], np.int32) for r in got], np.array([r[1] for r in got]))
    sampled = np.bincount([r[1] for r in got], minlength=2)
    every = dict(named.groupBy("_y").count().collect())
    if sampled.min() > 0:
        model.shift += float(np.log(every[1] / every[0]) - np.log(sampled[1] / sampled[0]))
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score)`` for each row; the model is broadcast, its size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets, 1 << 21):
                s = shared.value.score(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(s, pa.float64())], names=[key, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
