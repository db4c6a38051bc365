"""Each stage of the pipeline against what its operator says about the stage's own input."""
import os

import pytest

import corpus_pipeline as P
from stancekit.llm import common as C
from stancekit.llm import decontam, quality, simhash, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = C.table(spark, SF, "documents"), []
    for name, f in P.STAGES:
        after = C.written(f(spark, docs, SF), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_order_and_columns(stages):
    assert [n for n, *_ in stages] == ["quality", "toxicity", "simhash", "decontamination", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
        assert sorted(map(tuple, after.collect())) <= sorted(map(tuple, before.collect())) or set(map(tuple, after.collect())) <= set(map(tuple, before.collect()))


def test_classifier_stages(spark, stages):
    labels = C.table(spark, SF, "labels")
    for (_, before, after), op, good in ((stages[0], quality, 1), (stages[1], toxicity, 0)):
        scored = op.classify(before, op.fit(before, labels)).collect()
        assert ids(after) == sorted(r["doc_id"] for r in scored if r["predicted"] == good)
        assert 0 < len(ids(after)) < len(ids(before))


def test_simhash_stage(stages):
    _, before, after = stages[2]
    rows = before.collect()
    fps = [simhash.fingerprint_bytes((r["text"] or "").encode()) for r in rows]
    import numpy as np
    x = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    least = {}
    for r, c in zip(rows, simhash.roots(len(rows), a, b)):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert ids(after) == sorted(least.values())


def test_decontamination_stage(spark, stages):
    _, before, after = stages[3]
    items = [decontam.word_shingles(r["text"]) for r in C.table(spark, SF, "benchmark").collect()]
    clean = []
    for r in before.collect():
        s = decontam.word_shingles(r["text"])
        if not any(i and len(i & s) >= 0.8 * len(i) for i in items):
            clean.append(r["doc_id"])
    assert ids(after) == sorted(clean) and len(clean) < before.count()


def test_packing_stage_and_run(spark, stages):
    from tests.llm.test_tokens import FILES, check_pieces, ids as token_ids
    _, before, after = stages[4]
    want = {r["doc_id"]: [token_ids(FILES[0], r["text"]) + [0]] for r in before.collect()}
    check_pieces(after.collect(), want)
    again = P.run(spark, SF)
    assert again.count() == after.count() and again.columns == after.columns


def test_pipeline_of_nothing(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        C.table(spark, SF, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
    some = tmp_path / "some"
    for t in ("labels", "benchmark"):
        C.table(spark, SF, t).limit(0).write.parquet(str(some / f"{t}.parquet"))
    os.makedirs(some, exist_ok=True)
    C.table(spark, SF, "documents").limit(20).write.parquet(str(some / "documents.parquet"))
    assert {r["doc_id"] for r in P.run(spark, str(some)).collect()} <= {r["doc_id"] for r in C.table(spark, str(some), "documents").collect()}
