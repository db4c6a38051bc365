"""Quality classifier: n-gram indicators scaled by class log-count ratios, linear hinge
loss by dual coordinate descent, logistic calibration.

Ratios come from all labelled documents of the learning folds, weights from at most
``cap`` of them, a fixed sample by hash of the id; every document is scored.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.llm import common as C
from stancekit.llm import features as X

BITS, WORDS, SHAPES = 18, 2, 3
CAP = 8000


@dataclass
class Model:
    weights: np.ndarray      # float32 per bucket, ratio and weight multiplied
    ratio2: np.ndarray       # float32 per bucket, squared ratio: a row's length
    bias: float
    slope: float
    shift: float

    def margins(self, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        dot = np.bincount(row, weights=self.weights[flat], minlength=len(off) - 1)
        norm = np.sqrt(np.bincount(row, weights=self.ratio2[flat], minlength=len(off) - 1))
        return dot / np.maximum(norm, 1e-12) + self.bias

    def scores(self, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(flat, off) + self.shift, -30, 30)))


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray,
                 epochs: int = 15, seed: int = 0) -> tuple[np.ndarray, float]:
    """min 1/2 |w|^2 + sum cost_i max(0, 1 - y_i (w x_i + b)), the bias as a constant feature."""
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    q = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            k, v = rows[i]
            g = y[i] * (w[k] @ v + b) - 1.0
            a = min(max(alpha[i] - g / q[i], 0.0), cost[i])
            step = (a - alpha[i]) * y[i]
            if step:
                w[k] += step * v
                b += step
                moved = max(moved, abs(step))
                alpha[i] = a
        if moved < 1e-3:
            break
    return w, b


def calibrate(f: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins (Newton, smoothed targets)."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    m = np.stack([f, np.ones_like(f)], 1)
    z = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ z, -30, 30)))
        h = (m * (p * (1 - p))[:, None]).T @ m + 1e-6 * np.eye(2)
        d = np.linalg.solve(h, m.T @ (p - t))
        z -= d
        if np.abs(d).max() < 1e-8:
            break
    return float(z[0]), float(z[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 1, folds: int = 3, cap: int = CAP,
        smooth: float = 1.0, cost: float = 4.0, blend: float = 0.75, bits: int = BITS, words: int = WORDS,
        shapes: int = SHAPES, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from labelled documents whose crc32 fold is not ``fold``.

    No usable labels, or one class only, gives a model that scores every text alike:
    0.5, or that class's side.
    """
    # written, so that its size is known before the join: a small one is broadcast and no text moves
    y = C.written(X.labelled(docs, labels, label, fold, folds, id_col), "quality-labels")
    size = 1 << bits
    few = X.sparse_rows(X.sample_texts(docs, X.first_by_hash(y, cap, seed), id_col, text_col), ["y"], bits, words, shapes).toArrow()
    have = [(1.0 if y > 0 else -1.0, np.frombuffer(b, "<u4")) for b, y in
            sorted(zip(few.column("buckets").to_pylist(), few.column("y").to_pylist()))]      # order of tasks must not matter
    got = X.bucket_counts(X.labelled_texts(docs, y, fold, folds, id_col, text_col), ["p", "q"], bits, words, shapes).toArrow()   # at most 2**bits rows
    p, q = np.zeros(size), np.zeros(size)
    for total, c in ((p, "p"), (q, "q")):
        total[np.asarray(got.column("bucket"))] = np.asarray(got.column(c))
    r = (np.log((p + smooth) / (p.sum() + smooth * size)) - np.log((q + smooth) / (q.sum() + smooth * size))).astype(np.float32)
    rows, sign = [], []
    for t, k in have:
        v = r[k]
        norm = np.sqrt(v @ v)
        rows.append((k, v / norm if norm else v))
        sign.append(t)
    sign = np.array(sign)
    if not len(sign) or abs(sign.sum()) == len(sign):
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 1.0, float(sign.sum() and np.sign(sign.sum()) * 2))
    part = np.random.default_rng(seed).random(len(sign)) < 0.8
    share = np.array([(sign > 0).mean(), (sign < 0).mean()])
    weight = cost * np.where(sign > 0, 0.5 / share[0], 0.5 / share[1])
    fitted = np.flatnonzero(part)
    w, b = dual_descent([rows[i] for i in fitted], sign[fitted], size, weight[fitted], seed=seed)
    w = (1 - blend) * np.abs(w).mean() + blend * w          # pulled towards the plain ratio, as the method proposes
    model = Model((w * r).astype(np.float32), (r * r).astype(np.float32), b, 1.0, 0.0)
    rest = np.flatnonzero(~part) if len(np.unique(sign[~part])) == 2 else np.arange(len(sign))
    f = np.array([model.weights[k] @ np.ones(len(k)) / max(np.sqrt(model.ratio2[k].sum()), 1e-12) + b if len(k) else b for k in (rows[i][0] for i in rest)])
    model.slope, model.shift = calibrate(f, sign[rest])
    return model


def score(model: Model, text: Column, bits: int = BITS, words: int = WORDS, shapes: int = SHAPES) -> Column:
    """Probability of label 1 for each text (null: empty; a text without tokens scores by the bias alone)."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(model.scores(*X.indicators(c, bits, words, shapes)) for c in X.parts(column))]))

    return run(text)


def classify(docs: DataFrame, model: Model, fold: int = 1, folds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row (null id: held_out is null)."""
    return docs.select(
        id_col, (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold).alias("held_out"),
        score(model, F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
