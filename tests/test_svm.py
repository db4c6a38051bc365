"""The dual solver against spark.ml's objective, its own bound, and itself over other blocks."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from stancekit.operators import linear as LN

TERMS = [f"t{j}" for j in range(12)]


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(4)
    truth, rows = rng.normal(size=(2, 12)), []
    for i in range(600):
        idx = np.sort(rng.choice(12, rng.integers(0, 6), replace=False))
        val = rng.random(len(idx)) + 0.1
        val = val / np.linalg.norm(val) if len(val) else val
        x = np.zeros(12)
        x[idx] = val
        y = [int(t @ x + 0.3 * rng.normal() > 0.1) for t in truth]
        rows.append((Vectors.sparse(12, idx.tolist(), val.tolist()), [*y, None if i % 2 else 0] if i % 7 else None, int(rng.integers(1, 7))))
    df = spark.createDataFrame(rows, ["features", "gold_vec", "copies"])
    return df.repartition(4).persist()


def objective(vecs, coef, bias, k):
    w = {(r["label"], r["term"]): r["weight"] for r in coef.collect()}
    b = {r["label"]: r["bias"] for r in bias.collect()}
    rows = [(r["features"].toArray(), r["gold_vec"] or [0] * k, r["copies"]) for r in vecs.collect()]
    out = []
    for j in range(k):
        x = np.array([w[j, t] for t in TERMS])
        hinge = sum(c * max(0.0, 1 - (1 if (g[j] or 0) > 0 else -1) * (v @ x + b[j])) for v, g, c in rows)
        out.append(((x @ x) / 2, b[j] ** 2 / 2, hinge))
    return out


@pytest.mark.parametrize("block_rows", [131072, 300])
def test_objective_lies_in_the_gap(vecs, monkeypatch, block_rows):
    monkeypatch.setattr(LN, "BLOCK_ROWS", block_rows)
    report = []
    coef, bias = LN.train_linear_svm(vecs, TERMS, weight_col="copies", k=3, gap=0.05, max_iter=200, report=report)
    for (w2, b2, hinge), (primal, dual) in zip(objective(vecs, coef, bias, 3), report):
        assert w2 + b2 + hinge == pytest.approx(primal, rel=1e-6)
        assert dual <= primal and primal - dual <= 0.05 * primal + 1e-9


def test_objective_equals_that_of_spark_ml(vecs):
    from pyspark.ml.classification import LinearSVC
    coef, bias = LN.train_linear_svm(vecs, TERMS, weight_col="copies", k=2, gap=0.002, max_iter=100)
    mine = objective(vecs, coef, bias, 2)
    n = vecs.agg(F.sum("copies")).first()[0]
    for j in range(2):
        d = vecs.withColumn("_y", F.coalesce(F.get("gold_vec", j), F.lit(0)).cast("double")).withColumn("_w", F.col("copies").cast("double"))
        m = LinearSVC(labelCol="_y", weightCol="_w", regParam=1.0 / n, maxIter=200, standardization=False).fit(d)
        rows = [(r["features"].toArray(), r["_y"], r["copies"]) for r in d.collect()]
        w = m.coefficients.toArray()
        theirs = (w @ w) / 2 + sum(c * max(0.0, 1 - (2 * y - 1) * (v @ w + m.intercept)) for v, y, c in rows)
        assert mine[j][0] + mine[j][2] <= 1.01 * theirs


def test_rounds_repeat(vecs):
    a, b = (sorted(map(tuple, LN.train_linear_svm(vecs, TERMS, weight_col="copies", k=1)[0].collect())) for _ in range(2))
    assert a == b


def test_empty_table(vecs):
    coef, bias = LN.train_linear_svm(vecs.limit(0), TERMS, weight_col="copies", k=2)
    assert {r["weight"] for r in coef.collect()} == {0.0} and bias.count() == 2


def test_a_label_is_a_task_of_its_own(vecs):
    """Labels do not wait for each other in one task: a block stands once a label, each in a partition of its own."""
    blocks = LN.packed_blocks(vecs.coalesce(1), "gold_vec", "features", F.col("copies").cast("double"), 1.0, 3)
    assert [tuple(r) for r in blocks.select("label", F.size("y")).orderBy("label").collect()] == [(j, 600) for j in range(3)]
    assert len(blocks.inputFiles()) == 3
