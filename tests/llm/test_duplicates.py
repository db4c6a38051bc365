"""SimHash near-duplicates and benchmark decontamination against brute force."""
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from stancekit.llm import common as C
from stancekit.llm import decontam, simhash
from stancekit.llm import queries as Q

SF = "/root/testdata/sf0.001"


def spec_fingerprint(text, n=4):
    """The contract, word by word."""
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, bits=4):
    lab = list(range(len(fps)))
    x = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= bits)
    return simhash.roots(len(lab), a, b)


TEXTS = [None, "", "  \n\t ", "one", "One two", "ONE TWO three four", "a b c d a b c d a b c d", "é É ẞ x y z", "x y" * 500, "zero\x1cwidth no break a b c"]


def test_fingerprint_is_the_contract(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in simhash.near_duplicates(df).collect():
        assert int(r["fingerprint"], 16) == spec_fingerprint(texts[r["doc_id"]]), texts[r["doc_id"]]
    # the same hash as Spark's own xxhash64
    assert spark.sql("select xxhash64('a b c d') x").first()["x"] == np.uint64(xxhash.xxh64_intdigest(b"a b c d", 42)).astype(np.int64)


def flipped(rng, base, k):
    for b in rng.sample(range(64), k):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("leaf_rows", [40, 8192])
def test_links_find_every_component(spark, leaf_rows):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(300)]
    chain = rng.getrandbits(64)
    for _ in range(40):                                     # a chain: only neighbours are near
        chain = flipped(rng, chain, 4)
        fps.append(chain)
    centre = rng.getrandbits(64)
    fps += [flipped(rng, centre, rng.randint(1, 3)) for _ in range(900)]      # one large group of near copies
    fps += [flipped(rng, f, rng.randint(1, 6)) for f in fps[:200]]
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(7)
    edges = simhash.near_links(df, leaf_rows=leaf_rows, sample=500).collect()
    at = {f: i for i, f in enumerate(signed)}
    a, b = np.array([at[e["a"]] for e in edges]), np.array([at[e["b"]] for e in edges])
    x = np.array(fps, np.uint64)
    assert (np.bitwise_count(x[a] ^ x[b]) >= 0).all()
    assert len(edges) < 4 * len(fps)                        # spanning links, not all pairs
    want = brute_components(fps)
    assert (simhash.roots(len(fps), a, b) == want).all()
    linked = {r["fp"]: r["label"] for r in simhash.components(simhash.near_links(df, leaf_rows=leaf_rows, sample=500)).collect()}
    groups = {}
    for f, w in zip(signed, want):
        groups.setdefault(w, []).append(f)
    for g in groups.values():
        assert {linked.get(f, f) for f in g} == {min(g)}


def test_block_of_one_shard():
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    x = np.array(sorted({flipped(rng, centre, rng.randint(0, 12)) for _ in range(3000)}), np.uint64)
    home = np.ones(len(x), bool)
    a, b = simhash.links(x, home, 4)
    assert (simhash.roots(len(x), a, b) == brute_components([int(v) for v in x])).all()


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=300)) for _ in range(12)]
    rows = [(i, b) for i, b in enumerate(base)]
    rows += [(100 + i, b + " tail") for i, b in enumerate(base)] + [(200 + i, b) for i, b in enumerate(base[:6])]
    rows += [(300, None), (301, ""), (302, " \n"), (7, base[7]), (7, base[7]), (None, base[3]), (None, "only here and nowhere else at all"), (1, "another text under a used id")]
    return rows


def test_near_duplicates_and_keep_one(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, label string").repartition(4)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    comp = brute_components([spec_fingerprint(t) for _, t in rows])
    least, fp_of = {}, {}
    for (k, t), c in zip(rows, comp):
        fp_of.setdefault((k, "%016x" % spec_fingerprint(t)), c)
        if k is not None:
            least[c] = min(least.get(c, k), k)
    for r in got:
        assert r["component_id"] == least.get(fp_of[(r["doc_id"], r["fingerprint"])])
    kept = simhash.keep_one(df).collect()
    assert set(simhash.keep_one(df).columns) == set(df.columns)
    where = [fp_of[(r["doc_id"], "%016x" % spec_fingerprint(r["text"]))] for r in kept]
    assert sorted(where) == sorted(set(comp))               # exactly one row of each component
    for r, c in zip(kept, where):
        assert r["doc_id"] == least.get(c)
    assert simhash.near_duplicates(df.limit(0)).collect() == [] and simhash.keep_one(df.limit(0)).collect() == []


def test_op8_query(spark):
    docs = C.table(spark, SF, "documents").collect()
    got = {r["doc_id"]: r for r in Q.op8_simhash(spark, SF).collect()}
    fps = [spec_fingerprint(d["text"]) for d in docs]
    comp = brute_components(fps)
    least = {}
    for d, c in zip(docs, comp):
        least[c] = min(least.get(c, d["doc_id"]), d["doc_id"])
    for d, f, c in zip(docs, fps, comp):
        assert (got[d["doc_id"]]["fingerprint"], got[d["doc_id"]]["component_id"]) == ("%016x" % f, least[c])


def test_decontamination_cases(spark):
    rng = random.Random(3)
    words = [f"W{i}é" for i in range(3000)]
    item = [" ".join(rng.choices(words, k=k)) for k in (5, 6, 9, 17, 40, 60, 130, 300)]
    items = [(i, t) for i, t in enumerate(item)] + [(50, item[4]), (60, None), (61, ""), (62, "too few words"), (63, "four words are short"),
                                                    (64, "Lone"), (65, "lone!"), (66, "...")]
    noise = lambda k: " ".join(rng.choices(words, k=k))
    w = item[4].split()
    docs = [(1, noise(20000) + " " + item[3] + " " + noise(9000)), (2, noise(500)), (3, None), (4, ""), (5, item[0]), (6, item[5].upper().replace(" ", "*** ")),
            (7, noise(3000) + " " + item[6] + "\n" + noise(2500)), (8, " ".join(w[:20]) + " " + noise(50) + " " + " ".join(w[20:])), (9, " ".join(w[:30])),
            (10, noise(100) + item[7] + " " + noise(1)), (11, item[1] + " " + item[2] + " " + item[1]), (None, item[3]), (12, item[2]), (12, item[2]),
            (13, noise(30) + " Four, words  ARE short " + noise(40)), (14, "four words are not short"), (15, noise(3) + " lone " + noise(1)),
            (16, "few words too few words"), (17, "lone")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = []
    lengths = {k: min(5, len(re.findall("[^\\x00-/:-@\\[-`{-\\x7f]+", t or ""))) for k, t in items}
    assert [lengths[k] for k in (0, 60, 61, 62, 63, 64, 65, 66)] == [5, 0, 0, 3, 4, 1, 1, 0]
    sets = {k: decontam.word_shingles(t, lengths[k]) if lengths[k] else set() for k, t in items}
    for k, t in docs:
        s = {m: decontam.word_shingles(t, m) for m in range(1, 6)}
        want += [(k, i, len(v & s[lengths[i]]), len(v)) for i, v in sets.items() if v and len(v & s[lengths[i]]) >= 0.8 * len(v)]
    assert {(13, 63), (15, 64), (15, 65), (16, 62), (17, 64)} <= {r[:2] for r in want} and 14 not in {r[0] for r in want}
    assert len(want) > 10
    for options in ({}, {"block_words": 30}):               # many blocks of items change nothing
        got = [tuple(r)[:4] for r in decontam.contaminated(d, b, **options).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    hit = {k for k, *_ in want}
    for options in ({}, {"block_words": 30}):
        assert sorted(str(r["doc_id"]) for r in decontam.clean(d, b, **options).collect()) == sorted(str(k) for k, _ in docs if k not in hit)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [k for k, _ in docs], "text": [t for _, t in docs]}))
    con.register("benchmark", pa.table({"item_id": [k for k, _ in items], "text": [t for _, t in items]}))
    sql = {r[:4] for r in con.sql(decontam.ORACLE).fetchall()}
    assert sql == set(want)
    assert decontam.contaminated(d.limit(0), b).collect() == []
    assert decontam.contaminated(d, b.limit(0)).collect() == [] and decontam.clean(d, b.limit(0)).count() == len(docs)


def test_op7_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    want = sorted(map(tuple, con.sql(decontam.ORACLE).fetchall()))
    got = sorted((r["doc_id"], r["item_id"], r["shared"], r["total"], r["containment"]) for r in Q.op7_decontaminate(spark, "/root/testdata/sf0.01").collect())
    assert got == want and got
