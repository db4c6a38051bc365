"""Encoder, packing, ORC ids and edit-aware counts against the tokenizers library itself."""
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stancekit.llm import counts, orc_ids, packing
from stancekit.llm import common as C
from stancekit.llm import queries as Q
from stancekit.llm.encoder import encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
LIB = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}
ODD = ["a  b\n c\t\n\n d", None, "", "x", "x<|endoftext|> y", "don't it's 'S*** é.× y  z　 q", "日本語 テスト、です。 ok", "  lead", "trail  ",
       "\n", "\n\n", "a\nb\n\nc\n d", "1234 5.6", "á b .x'll! ", "中 文 Привет мир, да", "\x1c \x1d a", "Σας. ΑΣ x", "<|startoftext|>q",
       "w" * 5000, "é .́", "🙂 🙂🙂.ok", "\r\n a\r\n"]


def ids(f, text):
    return LIB[f].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("f", FILES)
def test_encoder_equals_library(f):
    flat, off = encoder(f).ids(pa.array(ODD, pa.string()))
    for i, t in enumerate(ODD):
        assert list(flat[off[i]:off[i + 1]]) == ids(f, t), t
    for t in ODD:
        assert list(encoder(f).ids(pa.array([t], pa.string()))[0]) == ids(f, t), t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab Z.,'\n\t0é×ß 中*s<|>-", max_size=40), max_size=5))
def test_encoder_property(texts):
    for f in FILES:
        flat, off = encoder(f).ids(pa.array(texts, pa.string()))
        assert [list(flat[a:b]) for a, b in zip(off[:-1], off[1:])] == [ids(f, t) for t in texts]


WHITE = ["\u00a0", "\u3000", "\u2028", "\t", "\x85", " ", "\n", "\u200b"]


@pytest.mark.parametrize("f", FILES)
def test_rows_that_open_with_white_space(f):
    """Whatever white space rows open with, in every order and with an empty chunk table."""
    import itertools
    rows = ["a"] + [w * n + tail for w in WHITE for n in (1, 2, 3, 4) for tail in ("b", "")] + [x + y + "c" for x, y in itertools.product(WHITE, WHITE)]
    for order in (rows, rows[::-1], rows[1::2] + rows[::2]):
        enc = encoder(f)
        enc.reset()
        flat, off = enc.ids(pa.array(order, pa.string()))
        assert [list(flat[a:b]) for a, b in zip(off[:-1], off[1:])] == [ids(f, t) for t in order]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="a.\n \u00a0\u3000\t,B", max_size=12), max_size=8))
def test_white_space_property(texts):
    for f in FILES:
        encoder(f).reset()
        flat, off = encoder(f).ids(pa.array(texts, pa.string()))
        assert [list(flat[a:b]) for a, b in zip(off[:-1], off[1:])] == [ids(f, t) for t in texts]


def check_pieces(rows, want, most=1024):
    """Every id in one piece, sequences gapless and within the limit. want: id -> list of id arrays."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for seq in by.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= most
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(want)
    for k, parts in got.items():
        assert sum(r["length"] for r in parts) == sum(map(len, want[k]))
        if len(want[k]) == 1:
            at = 0
            for r in sorted(parts, key=lambda r: r["start"]):
                assert r["start"] == at and list(r["ids"]) == want[k][0][at:at + r["length"]]
                assert r["doc_tokens"] == len(want[k][0])
                at += r["length"]
    return by


def test_pack_edge_rows(spark):
    docs = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "x", "y"), (3, "x", "y"), (None, "no id", "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, start string").coalesce(1)
    want = {}
    for k, t, _ in docs:
        want.setdefault(k, []).append(ids(FILES[0], t) + [0])
    rows = packing.pack(df).collect()
    by = check_pieces(rows, want)
    total = sum(r["length"] for r in rows)
    assert len(by) == -(-total // 1024)         # one task: only its last sequence has padding
    assert packing.pack(df.limit(0)).collect() == []


def test_pack_limits_and_prompts(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(id % 40 as int))").alias("text"),
                                   F.expr("repeat('ask ', cast(id % 7 as int))").alias("prompt")).coalesce(1)
    rows = packing.pack(docs, prompt_col="prompt", max_tokens=64, max_segments=3, max_loss=40, window=32).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for seq in by.values():
        assert sum(r["length"] for r in seq) <= 64 and len(seq) <= 3 and sum(r["loss_tokens"] for r in seq) <= 40
    whole = {r["doc_id"]: (len(ids(FILES[0], r["prompt"])), len(ids(FILES[0], r["text"])) + 1) for r in docs.collect()}
    for k, (p, t) in whole.items():
        parts = [r for r in rows if r["doc_id"] == k]
        assert sum(r["length"] for r in parts) == p + t
        assert sum(r["loss_tokens"] for r in parts) == t
    with pytest.raises(Exception, match="may not be cut"):
        packing.pack(docs, max_tokens=8, cut=False).collect()


def test_dot_product_choice():
    # room for 10 ids and 2 pieces: the direction of the room prefers the long rests
    n, p = np.array([4, 6, 1, 1]), np.zeros(4, int)
    first = next(packing.fill(n, p, (10, 2, 10)))
    assert sorted(k for k, _, _ in first) == [0, 1]


def test_op1_query(spark):
    rows = Q.op1_pack(spark, "/root/testdata/sf0.001").collect()
    docs = C.table(spark, "/root/testdata/sf0.001", "documents").collect()
    want = {d["doc_id"]: np.array(ids(FILES[0], d["text"]) + [0], "<u4") for d in docs}
    assert sum(r["length"] for r in rows) == sum(map(len, want.values()))
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"]:r["start"] + r["length"]].tobytes())


def test_orc_round_trip_and_pruning(spark, tmp_path):
    docs = [(i * 7 % 500, f"word{i} " * (i % 30)) for i in range(500)] + [(None, "null id"), (5, "again"), (5, "again"), (6, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(5)
    path = str(tmp_path / "ids")
    orc_ids.write_ids(df, path, partitions=4, options={"orc.row.index.stride": "1000"})
    rows = orc_ids.read_ids(spark, path)
    got = sorted(((r["doc_id"], list(r["ids"])) for r in rows.collect()), key=str)
    assert got == sorted(((k, ids(FILES[1], t) + [2]) for k, t in docs), key=str)
    plan = orc_ids.read_ids(spark, path, F.col("doc_id") == 123)._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,123)" in plan
    assert orc_ids.read_ids(spark, path, F.col("doc_id") == 123).count() == 1
    out = orc_ids.with_start(orc_ids.digests(rows)).collect()
    order = sorted(out, key=lambda r: r["start"])
    at = 0
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in order]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    empty = str(tmp_path / "none")
    orc_ids.write_ids(df.limit(0), empty)
    read = spark.read.schema("doc_id long, part int, pos long, ids array<int>").orc(empty)
    assert orc_ids.with_start(orc_ids.digests(read)).count() == 0
    for name in ("part", "pos", "ids"):
        with pytest.raises(ValueError):
            orc_ids.write_ids(df.withColumnRenamed("doc_id", name), empty, id_col=name)


def test_start_is_the_place_in_the_files(spark, tmp_path):
    texts = ["b c d", "a", None, "", "zz y", "a", "q r s t u v", "1 2"]
    df = spark.createDataFrame([(k // 8 if k < 32 else 9, texts[k % 8]) for k in range(64)], "doc_id long, text string").repartition(6)
    path = tmp_path / "ids"
    orc_ids.write_ids(df, str(path), partitions=3)
    rows = orc_ids.read_ids(spark, str(path))
    at, want = 0, {}
    for r in sorted(rows.collect(), key=lambda r: (r["part"], r["pos"])):
        want.setdefault((r["doc_id"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())), []).append(at)
        at += len(r["ids"])
    got = {}
    for r in sorted(orc_ids.with_start(orc_ids.digests(rows)).collect(), key=lambda r: r["start"]):
        got.setdefault((r["doc_id"], r["ids_crc32"]), []).append(r["start"])
    assert got == want and sum(map(len, got.values())) == 64


def test_orc_files_hold_stripes_and_filters(spark, tmp_path):
    from pyarrow import orc

    df = spark.range(40000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    path = tmp_path / "ids"
    orc_ids.write_ids(df, str(path), partitions=1, options={"orc.stripe.size": "100000"})
    f = orc.ORCFile(next(p for p in path.iterdir() if p.suffix == ".orc"))
    assert f.nstripes > 1 and f.row_index_stride == 1000
    low = [f.read_stripe(k, ["doc_id"]).column(0).to_pylist() for k in range(f.nstripes)]
    assert all(a[-1] < b[0] for a, b in zip(low, low[1:]))      # ranges of stripes do not overlap


def test_op9_query(spark):
    rows = Q.op9_orc_ids(spark, "/root/testdata/sf0.001").collect()
    docs = sorted(C.table(spark, "/root/testdata/sf0.001", "documents").collect(), key=lambda d: d["doc_id"])
    at, got = 0, {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    for d in docs:
        w = np.array(ids(FILES[1], d["text"]) + [2], "<u4")
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(w), zlib.crc32(w.tobytes()))
        at += len(w)


EDIT = st.tuples(st.integers(-2, 200), st.integers(0, 60), st.text(alphabet="ab .\n'é,<|endoftx>", max_size=30))


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab cd.\n é'", max_size=400), st.lists(EDIT, max_size=5))
def test_tree_equals_whole_count(text, edits):
    enc = encoder(FILES[0])
    parts = counts.segments(text, 4) or [""]
    doc = counts.Document(enc, text, counts.heap(np.array([len(p) for p in parts])), counts.heap(counts.count_tokens(enc, parts)))
    want = text
    for start, removed, inserted in edits:
        a = min(max(0, start), len(want))
        want = want[:a] + inserted + want[min(len(want), a + removed):]
        counts.edit_all(enc, [doc], [[{"start": start, "removed": removed, "inserted": inserted}]])
        assert doc.text == want and int(doc.chars[1]) == len(want)
        assert doc.total == counts.brute_count(want)
        width = len(doc.tokens) // 2
        assert all(doc.tokens[k] == doc.tokens[2 * k] + doc.tokens[2 * k + 1] for k in range(1, width))


def test_counts_edge_rows_and_query(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "x y", "c"), (1, "x", "c"), (1, "x", "c")], "doc_id long, text string, width string")
    trees = counts.build(df)
    for r in trees.collect():
        assert r["n_tokens"] == counts.brute_count(r["text"]) == r["tree_tokens"][1]
    done = counts.apply_edits(trees.withColumn("edits", counts.derived_edits()))
    rows = done.collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        assert r["n_tokens"] == counts.brute_count(r["text"])
    same = counts.apply_edits(trees.withColumn("edits", F.lit(None).cast(counts.EDITS))).collect()
    assert all(r["n_before"] == r["n_tokens"] and r["chars_encoded"] == 0 for r in same)
    assert counts.apply_edits(counts.build(df.limit(0)).withColumn("edits", counts.derived_edits())).count() == 0


def test_op6_query_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in Q.op6_counts(spark, sf).collect()}
    docs = C.table(spark, sf, "documents").withColumn("edits", counts.derived_edits()).collect()
    assert len(got) == len(docs)
    for d in docs:
        t = d["text"] or ""
        for e in d["edits"]:
            a = min(e["start"], len(t))
            t = t[:a] + e["inserted"] + t[min(len(t), a + e["removed"]):]
        r = got[d["doc_id"]]
        assert (r["n_before"], r["n_tokens"], r["text_crc32"]) == (counts.brute_count(d["text"]), counts.brute_count(t), zlib.crc32(t.encode()))
