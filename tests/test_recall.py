"""The approximate search holds its recall whatever the size and the form of the vectors."""
import numpy as np
import pytest

from stancekit.operators import retrieval as R


def _table(spark, x, name):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], f"{name} long, embedding array<double>")


@pytest.mark.parametrize("clusters", [0, 500])
def test_lsh_recall_on_20000_vectors(spark, clusters, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_200, 64))
    if clusters:
        centres = rng.normal(size=(clusters, 64))
        x = (centres / np.linalg.norm(centres, axis=1)[:, None])[rng.integers(0, clusters, len(x))] + 0.03 * x
    q, c = x[:200], x[200:]
    chosen, plan = [], R.lsh_bits
    monkeypatch.setattr(R, "lsh_bits", lambda *a: chosen.append(plan(*a)) or chosen[-1])
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    want = {(i, int(j)) for i, row in enumerate(np.argsort(-(unit(q) @ unit(c).T), axis=1)[:, :8]) for j in row}
    got = [(r["qid"], r["cid"]) for r in R.knn_cosine_lsh(_table(spark, q, "qid"), _table(spark, c, "cid"), 8).collect()]
    assert len(got) == len(set(got)) == len(want)
    assert len(want & set(got)) / len(want) >= 0.9
    # clusters are found by the keys; without them no choice of bits is cheaper than all pairs
    assert (chosen[0][2] <= 0.25) == bool(clusters)


def test_lsh_bits_follow_measured_neighbours():
    sims = np.repeat([0.2, 0.9], 500)
    shared = np.repeat([1, 6], 500)
    kth = np.array([0.9] * 95 + [0.2] * 5)
    bits, cut, share = R.lsh_bits(sims, shared, kth, 10, 4, 0.9)
    assert (bits, cut) == (6, 0.2) and abs(share - (4 / 64 + 0.05)) < 1e-9


def test_cells_hold_recall_without_exact_search(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3_300, 32))
    x = np.concatenate([x, x[:20]])                                    # equal rows tie
    q, c = x[:300], x[300:]
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    want = {(i, int(j)) for i, row in enumerate(np.argsort(-(unit(q) @ unit(c).T), axis=1, kind="stable")[:, :8]) for j in row}
    work = []
    got = [(r["qid"], r["cid"]) for r in R.knn_cosine_lsh(_table(spark, q, "qid"), _table(spark, c, "cid"), 8, work=work).collect()]
    assert len(got) == len(set(got)) == len(want)
    assert len(want & set(got)) / len(want) >= 0.9 and 0 < work[0] < 0.5


def test_probes_follow_measured_ranks():
    assert R.probes_for(np.array([0] * 500 + [3] * 500), 10, 0.9) == 4
    assert R.probes_for(np.zeros(1000, np.int64), 10, 0.9) == 1
    assert R.probes_for(np.arange(10), 10, 0.9) == 10


def test_cells_of_the_sphere():
    x = np.eye(4)[np.arange(40) % 4]
    centres = R.sphere_cells(x, 4, 1)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1) and len(R.sphere_cells(x[:2], 5, 1)) == 2


def test_small_blocks_travel_in_tiles(spark):
    """Blocks of a few rows cost no copies: the corpus goes to one tile of queries, and the answer is that of large blocks."""
    rng = np.random.default_rng(8)
    q, c = (_table(spark, rng.normal(size=(n, 16)), name) for n, name in ((60, "qid"), (400, "cid")))
    near = R.knn_cosine(q, c, 5, block_bytes=1 << 10)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "% 1) AS _tile" in plan                      # one tile of queries: the corpus is dealt once
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, R.knn_cosine(q, c, 5).collect()))


def test_cells_are_opened_by_slices(spark, monkeypatch):
    """The order of the cells is held for a slice of rows, and slices change no answer."""
    rng = np.random.default_rng(9)
    q, c = (_table(spark, rng.normal(size=(n, 16)), name) for n, name in ((90, "qid"), (900, "cid")))
    found = []
    for cells in (R.SLICE_CELLS, 1000):
        monkeypatch.setattr(R, "SLICE_CELLS", cells)
        found.append(sorted(map(tuple, R.knn_cosine_lsh(q, c, 8, most_met=0.0).collect())))
    assert found[0] == found[1] and len(found[0]) == 720
