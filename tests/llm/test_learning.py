"""Quality, toxicity, sharding and nearest neighbours."""
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancekit.llm import ann, common as C, features, quality, sharding, toxicity
from stancekit.llm import queries as Q

SF1 = "/root/testdata/sf0.1"
SF = "/root/testdata/sf0.01"


def held_out(rows, labels, name, part):
    y = {r["doc_id"]: r[name] for r in labels}
    both = [(r["predicted"], y[r["doc_id"]], r["score"]) for r in rows if r["doc_id"] in y and r["held_out"] == part]
    return np.array(both)


@pytest.mark.parametrize("query,label,folds,fold,least", [("op5_quality", "quality", 3, 1, 0.97), ("op3_toxicity", "toxic", 5, 0, 0.95)])
def test_held_out_accuracy(spark, query, label, folds, fold, least):
    rows = Q.QUERIES[query](spark, SF1).collect()
    docs = C.table(spark, SF1, "documents")
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    x = held_out(rows, C.table(spark, SF1, "labels").collect(), label, True)
    assert (x[:, 0] == x[:, 1]).mean() >= least
    # and better than the commoner answer
    assert (x[:, 0] == x[:, 1]).mean() > max(x[:, 1].mean(), 1 - x[:, 1].mean())


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = C.table(spark, SF, "documents"), C.table(spark, SF, "labels")
    for op, name, folds, fold in ((quality, "quality", 3, 1), (toxicity, "toxic", 5, 0)):
        turned = labels.withColumn(name, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, 1 - F.col(name)).otherwise(F.col(name)))
        a, b = op.fit(docs, labels), op.fit(docs.withColumn("source", F.lit("other")), turned)
        assert (a.weights == b.weights).all() and a.bias == b.bias


@pytest.mark.parametrize("op,name", [(quality, "quality"), (toxicity, "toxic")])
def test_learning_edge_rows(spark, op, name):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "no id here", 0.5), (3, "good text " * 20000, 0.5), (4, "bad bad", 0.5), (4, "bad bad", 0.5)], "doc_id long, text string, score double")
    cases = {"none": [], "one class": [(3, 1), (4, 1)], "nulls": [(None, 1), (3, None), (4, 0)], "clash": [(3, 1), (3, 0), (4, 0)]}
    for rows in cases.values():
        labels = spark.createDataFrame(rows, f"doc_id long, {name} int")
        got = op.classify(docs, op.fit(docs, labels)).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
        assert got[0]["score"] == got[1]["score"] and [r["held_out"] for r in got if r["doc_id"] is None] == [None]
    empty = docs.limit(0)
    assert op.classify(empty, op.fit(empty, labels)).collect() == []


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    pos = [np.unique(np.append(rng.integers(10, 200, 20), rng.integers(0, 5))) for _ in range(150)]
    neg = [np.unique(rng.integers(10, 200, 20)) for _ in range(900)]
    more = [np.unique(np.append(rng.integers(10, 200, 20), rng.integers(0, 5))) for _ in range(100)]
    w, b = toxicity.train(pos, neg + more, 0.1, 256)
    score = lambda rows: np.array([w[k].sum() + b > 0 for k in rows])
    assert score(pos).mean() > 0.9 and score(more).mean() > 0.7 and score(neg).mean() < 0.05


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ rng.normal(size=5) + 0.3 > 0, 1.0, -1.0)
    rows = [(np.arange(5), r) for r in x]
    w, b = quality.dual_descent(rows, y, 5, np.full(60, 1.0), epochs=500)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    for _ in range(300):
        assert loss(w + rng.normal(size=5) * 0.05, b + rng.normal() * 0.05) >= best - 1e-6


def test_indicators_against_plain_python():
    import pyarrow as pa

    texts = ["The the THE cat", None, "", "a-b a-b", "x" * 3000 + " y"]
    flat, off = features.indicators(pa.array(texts), 18, 1, 0)
    sizes = list(np.diff(off))
    assert sizes == [2, 0, 0, 3, 2]                          # the, cat / a, -, b / x..., y


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (1, 4), (4, 1)])
def test_hilbert_visits_every_cell_by_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = sharding.hilbert(cells, bits)
    assert sorted(at) == list(range(len(cells)))
    path = cells[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check_shards(rows, n, shards=16):
    sizes = [sum(r["shard"] == s for r in rows) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def curve_by_definition(rows, dims, bits=5):
    """Curve index of each row (tuples), from sorted lists: the brute force of ``curve_index``."""
    cells = []
    for k, _ in enumerate(dims):
        col = sorted(r[k] for r in rows if r[k] is not None)
        if col and isinstance(col[0], str):
            first = {}
            for i, v in enumerate(col):
                if i == 0 or col[i - 1] != v:
                    first.setdefault(i * (1 << bits) // len(col), v)
            edge = sorted(first.values())[1:]
        else:
            edge = sorted({col[-(-len(col) * j // (1 << bits)) - 1] for j in range(1, 1 << bits)}) if col else []
        cells.append([0 if r[k] is None else sum(r[k] >= e for e in edge) for r in rows])
    return sharding.hilbert(np.array(cells).T, bits) if rows else []


def test_op2_order_equals_brute_force(spark):
    docs = [(r["source"], r["lang"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()), r["doc_id"])
            for r in C.table(spark, SF, "documents").collect()]
    curve = curve_by_definition([d[:3] for d in docs], ["source", "lang", "size"])
    order = sorted(range(len(docs)), key=lambda i: (curve[i], docs[i][3], docs[i][4]))
    small, more = divmod(len(docs), 16)
    want = {}
    for rank, i in enumerate(order):
        shard = rank // (small + 1) if rank < more * (small + 1) else more + (rank - more * (small + 1)) // small
        want[docs[i][4]] = (int(curve[i]), shard, rank - shard * small - min(shard, more))
    got = {r["doc_id"]: (r["curve"], r["shard"], r["slot"]) for r in Q.op2_hilbert(spark, SF).collect()}
    assert got == want


def test_strings_with_a_common_start_keep_their_cells(spark):
    rows = [(f"https://www.example.org/{'x' * 40}/{k % 50:03d}", None if k % 11 == 0 else k % 7, "hot" if k % 3 else None, k) for k in range(700)]
    df = spark.createDataFrame(rows, "url string, _dim0 int, `part` string, value int").repartition(5)
    got = {r["value"]: r["curve"] for r in sharding.curve_index(df, ["url", "_dim0", "part"]).collect()}
    curve = curve_by_definition([r[:3] for r in rows], ["url", "_dim0", "part"])
    assert got == {r[3]: int(c) for r, c in zip(rows, curve)} and len(set(got.values())) > 60
    assert sharding.string_cuts(df.where("url is null"), "url", 5) == [] and sharding.curve_index(df.limit(0), ["url"]).count() == 0


def test_sharding_law_and_edges(spark):
    rng = random.Random(5)
    rows = [(i, "t" * rng.randint(0, 300), rng.choice(["en", "de", None]), rng.choice(["a", "bb", "src0", "src0"])) for i in range(333)]
    rows += [(5, "same", "en", "a")] * 40 + [(None, None, None, None), (None, "é", "en", "a")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, shard int, slot int")
    got = sharding.assign(df, ["source", "lang", "size"]).collect()
    check_shards(got, len(rows))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    for few in (0, 1, 5):
        check_shards(sharding.assign(df.limit(few), ["source", "lang", "size"]).collect(), few)


def test_shards_prune(spark, tmp_path):
    docs = C.table(spark, SF, "documents")
    got = sharding.assign(docs, ["source", "lang", "size"])
    sharding.write_shards(docs, got, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count()
    table = sharding.manifest(back.withColumn("size", F.octet_length("text") + 1), ["source", "lang", "size"])
    some = sharding.prune(table, {"lang": ("fr", "fr"), "size": (2000, 3000)}).select("shard").collect()
    need = {r["shard"] for r in back.where("lang = 'fr' and octet_length(text) + 1 between 2000 and 3000").select("shard").distinct().collect()}
    assert need <= {r["shard"] for r in some} and len(some) < 16


def test_op2_query(spark):
    rows = Q.op2_hilbert(spark, SF).collect()
    check_shards(rows, C.table(spark, SF, "documents").count())
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def brute(x, ids, q, qid, k):
    out = {}
    for v, own in zip(q, qid):
        s = x @ v
        order = sorted((-a, i) for a, i in zip(s, ids) if i != own)[:k]
        out[int(own)] = [(i, -a) for a, i in order]
    return out


def test_nearest_recall_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x *= rng.uniform(0.2, 3, (3000, 1)).astype(np.float32)          # lengths differ: inner product is not cosine
    x[1000:1400] = x[999]                                           # a large group of copies
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(9000, None), (9001, [0.0] * 16), (9020, [float("nan")] * 16), (9040, [1.0] * 15 + [float("inf")]), (9060, [1.0] * 15 + [None]), (9080, [1.0] * 3), (None, [1.0] * 16), (9100, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad + rows[:3]], "vec_id long, embedding array<float>, rank int").repartition(6)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), least_shards=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(x.astype(np.float64), range(3000), x[::20].astype(np.float64), range(0, 3000, 20), 20)
    assert set(by) == set(want)
    hits = 0
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert abs(s - x[i].astype(np.float64) @ x[q].astype(np.float64)) < 1e-9
        hits += len({f[1] for f in found} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.95
    copy = sorted(by[1000])
    assert {f[1] for f in copy} == {i for i, _ in want[1000]}       # copies: the smallest ids


def test_nearest_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    assert ann.nearest(df.limit(0), df).collect() == [] and ann.nearest(df, df.limit(0)).collect() == []


def test_op4_query_recall(spark):
    rows = C.table(spark, SF, "embeddings").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], np.float64), [r["vec_id"] for r in rows]
    pick = [k for k, i in enumerate(ids) if i % 20 == 0]
    want = brute(x, ids, x[pick], [ids[k] for k in pick], 20)
    got = Q.op4_graph(spark, SF).collect()
    hit = sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in got)
    assert hit / sum(map(len, want.values())) >= 0.95
