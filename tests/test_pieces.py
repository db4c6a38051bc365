"""Blocks of the SVM stand in pieces: no row of a table has a block's size, and the fit does not depend on it."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from stancekit.operators import linear as LN

TERMS = [f"t{j}" for j in range(9)]


@pytest.fixture(scope="module")
def vecs(spark):
    rng, rows = np.random.default_rng(8), []
    for _ in range(400):
        idx = np.sort(rng.choice(9, rng.integers(0, 5), replace=False))
        val = rng.random(len(idx)) + 0.1
        rows.append((Vectors.sparse(9, idx.tolist(), val.tolist()), [int(4 in idx), int(rng.random() < 0.3)], int(rng.integers(1, 4))))
    return spark.createDataFrame(rows, ["features", "gold_vec", "copies"]).coalesce(1).persist()


@pytest.mark.parametrize("block_rows", [1 << 17, 150])
def test_pieces_are_bounded(vecs, monkeypatch, block_rows):
    monkeypatch.setattr(LN, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(LN, "PIECE_ROWS", 64)
    blocks = LN.packed_blocks(vecs, "gold_vec", "features", F.col("copies").cast("double"), 1.0, 2)
    w = np.zeros((2, 10))
    done = LN.ascent_round(blocks, w, w, np.zeros(2), 1.0, 2, 0)
    for x in (blocks, done):
        assert x.agg(F.max(F.size("y"))).first()[0] <= 64
        assert x.groupBy("label").agg(F.sum(F.size("cap"))).orderBy("label").collect() == [(0, 400), (1, 400)]
    n = blocks.select("block").distinct().count()
    assert n == (1 if block_rows > 400 else 3)
    assert done.where(F.size("at") > 0).count() == 2 * n       # what a block and label adds is told once
    assert done.where(F.exists("move", lambda m: m != 0)).count() > 2 * n


@pytest.mark.parametrize("block_rows", [1 << 17, 150])
def test_pieces_change_no_weight(vecs, monkeypatch, block_rows):
    monkeypatch.setattr(LN, "BLOCK_ROWS", block_rows)
    found = []
    for size in (1 << 17, 37):
        monkeypatch.setattr(LN, "PIECE_ROWS", size)
        coef, bias = LN.train_linear_svm(vecs, TERMS, weight_col="copies", k=2, max_iter=4)
        found.append(np.array([r["weight"] for r in coef.orderBy("label", "term").collect()] + [r["bias"] for r in bias.orderBy("label").collect()]))
    assert np.allclose(*found, atol=1e-9) and np.abs(found[0]).max() > 0.1
