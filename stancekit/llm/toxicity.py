"""Toxicity from confirmed toxic examples and unlabelled text: non-negative
positive-unlabelled learning of a linear model over word indicators.

Risk: pi R+(P) + max(0, R-(U) - pi R-(P)), sigmoid loss; when the bracket falls
below zero a step goes up its gradient instead. The class prior pi is the
share of toxic rows among the labelled ones of the learning folds. Document
frequencies, which decide what words are features, cover all documents; weights
are fitted on at most ``cap`` confirmed and ``cap_unlabelled`` other documents,
whose labels are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.llm import features as X

BITS, WORDS = 18, 1
CAP, CAP_UNLABELLED = 4000, 12000


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        z = np.bincount(row, weights=self.weights[flat], minlength=len(off) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def train(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, size: int, epochs: int = 30, least_steps: int = 1000, batch: int = 500,
          rate: float = 0.05, decay: float = 1e-5, beta: float = 0.0, seed: int = 5) -> tuple[np.ndarray, float]:
    """Adam over mini-batches of positives and unlabelled rows in fixed proportion.

    The sigmoid loss is not convex and calling every row negative is a flat place of it, so
    the start is the naive estimate: log ratios of the words' shares, and the prior's log odds.
    """
    rng = np.random.default_rng(seed)
    w = np.zeros(size + 1)
    share = [(np.bincount(_padded(rows)[0], minlength=size) + 0.5) / (len(rows) + 1) for rows in (pos, unl)]
    w[:-1] = np.log(share[0] / share[1])
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v, t = np.zeros(size + 1), np.zeros(size + 1), 0
    steps = max(1, -(-(len(pos) + len(unl)) // batch))

    def part(rows, pick):
        flat, off = _padded([rows[i] for i in pick])
        row = np.repeat(np.arange(len(pick)), np.diff(off))
        z = np.bincount(row, weights=w[flat], minlength=len(pick)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = s * (1 - s)            # of sigmoid(z): loss of calling a row positive, and minus that of calling it negative
        g = np.bincount(flat, weights=(slope / len(pick))[row], minlength=size + 1)
        g[-1] = slope.mean()
        return s.mean(), g

    for _ in range(max(epochs, -(-least_steps // steps))):
        po, uo = rng.permutation(len(pos)), rng.permutation(len(unl))
        for k in range(steps):
            pick_p = po[k::steps] if len(po[k::steps]) else po[:1]
            pick_u = uo[k::steps] if len(uo[k::steps]) else uo[:1]
            sp, gp = part(pos, pick_p)     # mean sigmoid over positives: 1 - sp is R+(P), sp is R-(P)
            su, gu = part(unl, pick_u)
            bracket, slope = su - prior * sp, gu - prior * gp
            g = -prior * gp + slope if bracket >= -beta else -slope
            g = g + decay * np.append(w[:-1], 0.0)
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 0, folds: int = 5, cap: int = CAP,
        cap_unlabelled: int = CAP_UNLABELLED, least_seen: int = 5, least_z: float = 4.0, bits: int = BITS, words: int = WORDS,
        seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from confirmed rows outside ``fold`` and unlabelled texts.

    Features are buckets that at least ``least_seen`` confirmed examples have (with few examples
    the root of their number, but two), and ``least_z`` standard deviations more of them than the
    document frequency over the whole corpus lets expect. Without a confirmed example every text
    scores below 0.5.
    """
    y = X.labelled(docs, labels, label, fold, folds, id_col)
    stats = y.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("y") > 0, 1).otherwise(0)).alias("p")).first()
    size = 1 << bits
    if not stats["n"] or not stats["p"]:
        return Model(np.zeros(size, np.float32), -5.0)
    prior = stats["p"] / stats["n"]
    ids = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    count = np.zeros(size)
    got = X.bucket_counts(ids.select("text", F.lit(1).alias("n")), ["n"], bits, words, 0).toArrow()   # at most 2**bits rows
    count[np.asarray(got.column("bucket"))] = np.asarray(got.column("n"))
    total = docs.count()
    other = (ids.select("id").where(F.col("id").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) % folds != fold))
             .withColumn("y", F.lit(0)))
    picked = X.first_by_hash(y.where("y > 0"), cap, seed).unionByName(X.first_by_hash(other, cap_unlabelled, seed + 1)).distinct()
    got = X.sparse_rows(X.sample_texts(docs, picked, id_col, text_col), ["y"], bits, words, 0).toArrow()
    rows = sorted(zip(got.column("y").to_pylist(), got.column("buckets").to_pylist()))   # order of tasks must not matter
    have = [(y, np.frombuffer(b, "<u4").astype(np.int64)) for y, b in rows]
    # a word is a feature if confirmed examples have it oftener than chance, by the corpus-wide share, explains
    own = np.bincount(np.concatenate([k for y, k in have if y > 0] or [np.zeros(0, np.int64)]), minlength=size)
    chance = sum(y > 0 for y, _ in have) * count / max(total, 1)
    # of few examples no five may share a word; a word of one example says nothing
    floor = min(least_seen, max(2, round(sum(y > 0 for y, _ in have) ** 0.5)))
    used = (own >= floor) & ((own - chance) >= least_z * np.sqrt(np.maximum(chance, 1e-9)))
    column = np.cumsum(used) - 1            # train over the features alone
    pos = [column[k[used[k]]] for y, k in have if y > 0]
    unl = [column[k[used[k]]] for y, k in have if y == 0]
    if not pos or not unl:
        return Model(np.zeros(size, np.float32), -5.0)
    w, b = train(pos, unl, prior, int(used.sum()), seed=seed)
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Model(weights, b)


def score(model: Model, text: Column, bits: int = BITS, words: int = WORDS) -> Column:
    """Score of each whole text (null: empty; a text without tokens scores by the bias)."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(model.scores(*X.indicators(c, bits, words, 0)) for c in X.parts(column))]))

    return run(text)


def classify(docs: DataFrame, model: Model, fold: int = 0, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row (null id: held_out is null)."""
    return docs.select(
        id_col, (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold).alias("held_out"),
        score(model, F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
