"""Prefix trie against a dictionary of tuples; scans and queues against plain sorting."""
import hashlib
import heapq
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stancekit.llm import queries as Q
from stancekit.llm import trie as T

SCHEMA = "conv_id long, turn int, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_splice(rows, group=5, most=8):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn), role or "", text or ""))
    for c, x in convs.items():
        md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
        x.sort(key=lambda r: (r[0][0], r[0][1] or 0, md5(md5(r[1]) + md5(r[2]))))
        convs[c] = [r[1:] for r in x]
    out = {}
    for c, x in convs.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        out[c] = convs.get(c - c % group, [])[:h] + x[h:]
    return out


def brute_trie(convs):
    nodes = {}
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    own = {k: (len(m) - 1) * len(k[-1][1].encode()) if k else 0 for k, m in nodes.items()}
    out = []
    for k, m in nodes.items():
        below = [x for x in nodes if x[:len(k)] == k]
        children = {x[:len(k) + 1] for x in below if len(x) > len(k)}
        leaves = sum(1 for x in below if not any(len(y) == len(x) + 1 and y[:-1] == x for y in below))
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(k))
        out.append((m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), len(children), leaves, sum(own[x] for x in below),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def random_rows(seed, n=40):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue
        for turn in range(r.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, r.choice([turn, turn, turn, turn, None]), r.choice(["user", "bot", None]), r.choice(["a", "b", "é", "", None])))
    rows += rows[:5]                                  # repeated rows are turns of their own
    rows += [(None, 0, "user", "x")] * 3
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,shard,step,keep", [(1, T.SHARD, T.STEP, T.KEEP), (2, 3, 2, 2), (3, 20, 3, 4)])
def test_trie_against_brute_force(spark, seed, shard, step, keep):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = T.trie(*T.spliced(T.numbered(df)), shard=shard, step=step, keep=keep)
    assert got(out) == brute_trie(brute_splice(rows))


def test_one_conversation_over_many_partitions(spark):
    """A conversation with most of the rows, and one that all others repeat."""
    rows = [(7, t, "user", f"t{t % 3}") for t in range(300)] + [(c, t, "bot", "same") for c in range(10, 40) for t in range(3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        out = got(T.trie(*T.spliced(T.numbered(spark.createDataFrame(rows, SCHEMA))), shard=50, step=4))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out == brute_trie(brute_splice(rows))


def test_turnless_members_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert got(T.trie(*T.spliced(T.numbered(none)))) == []
    turns = T.numbered(spark.createDataFrame([(3, 0, "user", "x")], SCHEMA))
    members = spark.createDataFrame([(3,), (4,), (9,)], "conv_id long")
    out = {(r["conv_id"], r["depth"]): r for r in T.trie(turns, members).collect()}
    assert set(out) == {(3, 0), (3, 1)}
    assert out[3, 0]["n_convs"] == 3 and out[3, 0]["ends_sha256"] == hashlib.sha256(b"4,9").hexdigest() and out[3, 0]["parent_conv_id"] is None


def test_clashing_and_extra_columns(spark):
    rows = random_rows(5, 15)
    df = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], SCHEMA + ", pos int, depth int, key string")
    assert got(T.trie(*T.spliced(T.numbered(df)))) == brute_trie(brute_splice(rows))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(Q.op11_trie(spark, sf)) == brute_trie(brute_splice(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(-5, 5)), max_size=80), st.integers(2, 6))
def test_queue_that_spills(steps, keep):
    q, want = T.SpillingQueue(keep), []
    for push, x in steps:
        if push or not want:
            q.push((x, 0))
            heapq.heappush(want, (x, 0))
        else:
            assert q.peek() == want[0] and q.pop() == heapq.heappop(want)
    while want:
        assert q.pop() == heapq.heappop(want)
    assert q.peek() is None


def test_carries_compose():
    note = lambda pid, edge, c, n, h: {"pid": pid, "edge": edge, "conv_id": c, "n": n, "key": T.key_bytes(h)}
    out = T.carries([note(0, 1, 1, 2, 5), note(0, 2, 2, 1, 6), note(1, 1, 2, 3, 7), note(2, 1, 2, 1, 8), note(2, 2, 4, 1, 9), note(3, 1, 5, 1, 1)])
    h = (6 * pow(T.BASE, 3, T.PRIME) + 7) % T.PRIME
    assert out == [(1, 2, 1, T.key_bytes(6)), (2, 2, 4, T.key_bytes(h))]
