"""Runs of words against all (start, period) pairs."""
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stancekit.llm import periodic as P
from stancekit.llm import queries as Q


def brute(w, min_length=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(min_length, exponent * q) and not any(all(w[x] == w[x + d] for x in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def by_operator(w, min_length=6, exponent=4):
    ids = np.array([sorted(set(w)).index(x) for x in w], np.int64)
    out = []
    for _, a, b in P.regions(ids, np.array([0, len(w)]), min_length, exponent):
        out += [(a + s, n, q) for s, n, q in P.runs_of(ids[a:b].tolist(), min_length, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def texts(draw):
    w = draw(st.lists(st.integers(0, 2), max_size=30))
    for _ in range(draw(st.integers(0, 3))):
        piece = draw(st.lists(st.integers(0, 3), min_size=1, max_size=6))
        at, times = draw(st.integers(0, len(w))), draw(st.integers(1, 6))
        w[at:at] = piece * times
    return w


@settings(max_examples=400, deadline=None)
@given(texts(), st.sampled_from([(6, 4), (2, 2), (5, 3), (9, 2), (6, 6)]))
def test_runs(w, limits):
    want = brute(w, *limits)
    assert sorted(P.runs_of(w, *limits), key=lambda r: (r[0], r[2])) == want      # the automaton over all words
    assert by_operator(w, *limits) == want                                        # and over the stretches


def test_many_rows_keep_apart():
    r = random.Random(4)
    rows = [[r.randrange(2) for _ in range(r.randrange(12))] * r.randrange(1, 7) for _ in range(200)]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in rows])])
    got = [[] for _ in rows]
    for k, a, b in P.regions(np.array([x for w in rows for x in w], np.int64), offsets, 6, 4):
        got[k] += [(a - offsets[k] + s, n, q) for s, n, q in P.runs_of(rows[k][a - offsets[k]:b - offsets[k]], 6, 4)]
    assert [sorted(g, key=lambda x: (x[0], x[2])) for g in got] == [brute(w) for w in rows]


def test_memory_and_time_are_linear():
    w = [k % 700 for k in range(60_000)]
    assert P.runs_of(w, 6, 4) == [(0, 60_000, 700)]
    link, length, ends = P.automaton(w)
    assert len(link) <= 2 * len(w) + 2


ODD = [None, "", "   ", "a a a a a a", "x y\tx\x0by x\ny x y", "           ", "é é é é é é é", "1 " * 5, "no run here at all"]


def test_operator_on_odd_rows(spark):
    rows = [(k, t, 1) for k, t in enumerate(ODD)] + [(None, "b b b b b b b", 2), (3, "a a a a a a", 3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, runs int")
    out = P.find_runs(df)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()), key=str)
    want = []
    for i, t, _ in rows:
        w = (t or "").encode().split()
        found = brute(w)
        gone = {x for s, n, q in found for x in range(s + q, s + n)}
        want.append((i, len(w), found, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    assert got == sorted(want, key=str)
    assert P.digests(P.find_runs(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        P.find_runs(df, exponent=1)


def planted(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in Q.op12_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    some = 0
    for doc_id, text in docs:
        w, r = planted(doc_id, text), got[doc_id]
        if len(w) > 3000:
            continue                        # brute force is quadratic; long rows are held in the next test
        runs = brute(w)
        some += bool(runs)
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (top or (None, None, None))
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if top else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    assert some > 3


def test_long_rows(spark):
    r = random.Random(8)
    body = [f"w{r.randrange(5000)}" for _ in range(30_000)]
    body[10_000:10_000] = [f"p{k % 900}" for k in range(4 * 900 + 17)]
    body[100:100] = ["z"] * 6
    df = spark.createDataFrame([(1, " ".join(body))], "doc_id long, text string")
    row = P.find_runs(df).first()
    assert [tuple(x) for x in row["runs"]] == [(100, 6, 1), (10_006, 3617, 900)]


def test_strongest_run_and_ties(spark):
    df = spark.createDataFrame([(1, [(5, 12, 3), (0, 8, 2), (9, 16, 4)]), (2, []), (3, [(0, 13, 3), (2, 9, 2)])],
                               "doc_id int, runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = {r[0]: r[1] for r in df.select("doc_id", P.strongest(df["runs"])).collect()}
    assert tuple(got[1]) == (0, 8, 2) and got[2] is None and tuple(got[3]) == (2, 9, 2)
