"""Mixing: targets, flow against enumeration, selection against sorting, the query against its law."""
import hashlib
import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stancekit.llm import mixing as M
from stancekit.llm import queries as Q


def test_targets():
    assert M.targets({"a": 10, "b": 10, "c": 10}) == {"a": 20, "b": Fraction(50, 3), "c": Fraction(25, 3)}
    t = M.targets({"b": 100, "a": 1, None: 0, "c": 7})
    assert t["a"] == 2 and t[None] == 0 and sum(t.values()) == 162 and t["b"] + t["c"] == 160 and t["c"] == 14
    assert M.targets({}) == {} and M.targets({"a": 0}) == {"a": 0}
    # code points, not locale: upper case and the empty name come first
    order = M.targets({"b": 100, "B": 100, "": 100})
    assert order[""] >= order["B"] >= order["b"]


def best(sizes, members, quota, repeats, slices):
    """Largest flow, then least cost, over all ways to split whole words."""
    found = None
    ways = [[f for f in itertools.product(range(repeats * n + 1), repeat=len(m)) if sum(f) <= repeats * n] for n, m in zip(sizes, members)]
    for pick in itertools.product(*ways):
        got = {}
        for m, f in zip(members, pick):
            for s, x in zip(m, f):
                got[s] = got.get(s, 0) + x
        if any(got[s] > quota[s] for s in got):
            continue
        worth = (-sum(got.values()), sum(cost(n, sum(f), repeats, slices) for n, f in zip(sizes, pick)))
        found = worth if found is None else min(found, worth)
    return found


def cost(size, words, repeats, slices):
    total, before = 0, 0
    for level in range(1, repeats * slices + 1):
        top = size * level // slices
        total += level * (max(0, min(words, top) - before))
        before = top
    return total


def test_flow_is_the_cheapest_largest():
    r = random.Random(2)
    for _ in range(40):
        names = ["a", "b", "c"][:r.randint(1, 3)]
        members = list({tuple(sorted(r.sample(names, r.randint(1, min(2, len(names)))))) for _ in range(3)})
        sizes = [r.randint(0, 3) for _ in members]
        quota = {s: r.randint(0, 6) for s in names}
        flow = M.route(sizes, members, quota, 2, 2)
        for m, n, f in zip(members, sizes, flow):
            assert set(f) == set(m) and all(x >= 0 for x in f.values()) and sum(f.values()) <= 2 * n
        got = {s: sum(f.get(s, 0) for f in flow) for s in names}
        assert all(got[s] <= quota[s] for s in names)
        worth = (-sum(got.values()), sum(cost(n, sum(f.values()), 2, 2) for n, f in zip(sizes, flow)))
        assert worth == best(sizes, members, quota, 2, 2)


def order(i):
    return int(hashlib.md5(f"17:{'' if i is None else i}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("small,digit", [(4096, 12), (2, 4), (1, 2)])
def test_selection_against_sorting(spark, monkeypatch, small, digit):
    monkeypatch.setattr(M, "SMALL", small)
    monkeypatch.setattr(M, "DIGIT", digit)
    r = random.Random(5)
    rows = [(i, r.choice(["x", "y", None, "z"]), r.choice([0, 1, 5, 50, 400])) for i in range(300)] + [(7, "x", 5)] * 9 + [(None, "y", 3)] * 4
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(6)
    docs, patterns, sources = M.mix(df, F.array("source"), F.col("size"))
    name = {r["pattern"]: r["members"][0] for r in patterns.collect()}
    want = {r["source"]: (r["source_size"], r["target"], r["routed"]) for r in sources.collect()}
    exact = M.targets({s: sum(n for _, q, n in rows if q == s) for s in ("x", "y", "z", None)})
    got = [(r["doc_id"], name[r["pattern"]], r["size"], r["taken"]) for r in docs.collect()]
    assert sorted((x[:3] for x in got), key=str) == sorted(rows, key=str)
    for s in exact:
        size, target, routed = want[s]
        assert target == float(exact[s]) and routed == int(exact[s])
        turns, rest = divmod(routed, size)
        expected = []
        for i, _, n in sorted((x for x in rows if x[1] == s), key=lambda x: order(x[0])):
            take = min(n, rest)
            rest -= take
            expected.append((i, n, turns * n + take))
        mine = [(i, n, t) for i, q, n, t in got if q == s]
        assert sorted(mine, key=str) == sorted(expected, key=str)
        assert sum(t for *_, t in mine) == routed and all(t <= 2 * n for _, n, t in mine)


def test_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i % 2 else ["a"], 10) for i in range(40)] + [(100, None, 5), (101, [], 5), (102, ["b", "a", "b"], 10), (103, [None, "c"], 7)]
    df = spark.createDataFrame(rows, "doc_id long, src array<string>, size long")
    docs, patterns, sources = M.mix(df, F.col("src"), F.col("size"), weights=(1, 3, 1), share=Fraction(1))
    members = {tuple(r["members"]): r for r in patterns.collect()}
    assert set(members) == {("a",), ("a", "b"), (None,), ("c", None)} and members["a", "b"]["size"] == 210
    s = {r["source"]: r for r in sources.collect()}
    assert s["a"]["source_size"] == 410 and s["b"]["source_size"] == 210
    for r in (s["a"], s["b"]):
        assert 0 <= r["target"] - r["routed"] < 1
    assert s[None]["routed"] + s["c"]["routed"] == 34      # all they have, twice: their targets are 34 and 14
    taken = {r["doc_id"]: r["taken"] for r in docs.collect()}
    assert sum(taken.values()) == sum(r["routed"] for r in s.values()) and set(taken) == {r[0] for r in rows}


def test_nulls_and_empty_tables(spark):
    schema = "doc_id long, source string, text string, size int, pattern int, hash int, members string"
    df = spark.createDataFrame([(1, None, None, 1, 1, 1, "m"), (2, "a", "", 1, 1, 1, "m"), (3, "a", " w\tw ", 1, 1, 1, "m")], schema)
    docs, _, sources = M.mix(df, F.array("source"), M.words("text"))
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in docs.collect()) == [(1, 0, 0), (2, 0, 0), (3, 2, 3)]
    docs, patterns, sources = M.mix(df.limit(0), F.array("source"), M.words("text"))
    assert docs.count() == patterns.count() == sources.count() == 0


def test_too_many_patterns(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_PATTERNS", 3)
    df = spark.range(10).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("s"))
    with pytest.raises(ValueError):
        M.mix(df, F.array("s"), F.lit(1))


def test_query_law(spark):
    x = Q.op13_mix(spark, "/root/testdata/sf0.01")
    a = sorted(map(tuple, x.collect()))
    assert a == sorted(map(tuple, Q.op13_mix(spark, "/root/testdata/sf0.01").collect()))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text").collect()
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    assert {r[0]: r[1] for r in a} == size
    want = M.targets({s: sum(n for i, n in size.items() if source[i] == s) for s in set(source.values())})
    for s, t in want.items():
        rows = [r for r in a if source[r[0]] == s]
        assert all(r[3] == pytest.approx(float(t)) and r[4] <= 2 * r[1] for r in rows)
        assert sum(r[4] for r in rows) == int(t)
