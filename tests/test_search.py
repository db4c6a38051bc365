"""The lexical search: lists made from rows, rows it does not score, and where its groups go."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from stancekit.operators import retrieval as R


def rows_of(rng, n, terms):
    """Rows of unit length whose terms come by Zipf's law."""
    share = 1 / np.arange(1, terms + 1)
    rows = []
    for _ in range(n):
        t = rng.choice(terms, rng.integers(1, 12), replace=False, p=share / share.sum())
        w = np.log(1 + t) + 0.3 + rng.random(len(t))
        rows.append((t, w / np.linalg.norm(w)))
    return rows


@pytest.mark.parametrize("common", [4, 32, 1 << 40])
def test_lists_of_rows(monkeypatch, common):
    """Whatever counts as a common term, the k best are those of a plain product, and few postings are scored."""
    monkeypatch.setattr(R, "COMMON", common)
    rng = np.random.default_rng(2)
    rows = rows_of(rng, 12_000, 600)
    ptr = np.concatenate([[0], np.cumsum([len(t) for t, _ in rows])])
    term, value = np.concatenate([t for t, _ in rows]), np.concatenate([w for _, w in rows])
    index = R.PostingLists.of_rows(ptr, term, value)
    assert sorted(index.number.tolist()) == list(range(len(rows)))
    index.order = index.number
    dense = np.zeros((len(rows), 601))
    dense[np.repeat(np.arange(len(rows)), np.diff(ptr)), term] = value
    total = used = 0
    for t, w in [*rows_of(rng, 60, 601), (np.array([0, 1, 2]), np.full(3, 3 ** -0.5)), (np.array([600]), np.ones(1))]:
        want = np.round(dense[:, :600][:, t[t < 600]] @ w[t < 600], R.SIM_DIGITS)
        order = [i for i in np.lexsort((np.arange(len(want)), -want))[:8] if want[i] > 0]
        got, sims, shared, scored = R.search_postings(index, index.longest, t, w, 8)
        assert index.number[got].tolist() == order and np.allclose(sims, want[order], atol=2e-9)
        assert not index.sums.any() and not index.weights.any()
        total, used = total + shared, used + scored
    assert used < total / {4: 2, 32: 10}.get(common, 1)


@pytest.mark.parametrize("groups", [1, 7, 8, 20])
def test_groups_are_dealt_evenly(spark, groups):
    """No partition gets a second group before each has one."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = R.even_keys(spark, groups)
    assert len(set(keys)) == groups
    x = spark.createDataFrame([(k,) for k in keys], "k long").select(F.pmod(F.hash("k"), F.lit(n)).alias("p"))
    assert max(r["count"] for r in x.groupBy("p").count().collect()) == -(-groups // n)
