"""Properties: counts, splits, identities, skew-safe forms equal plain forms."""
import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL, SF_MID
from stancekit.functions import labels as L
from stancekit.operators import attribution as A
from stancekit.operators import metrics as M
from stancekit.operators import retrieval as R
from stancekit.operators import sampling as S
from stancekit.operators import windows as W
from stancekit.sources import fixtures as fx

KEY = ["speech_id", "sent_idx"]


def test_sentences_counts(spark):
    s = fx.sentences(spark, SF_MID)
    got = {r[0]: r[1] for r in s.groupBy("class_code").count().collect()}
    assert got == {0: 9881, 1: 3521, 2: 1402, 3: 694}


def test_upsample_count(spark):
    s = fx.sentences(spark, SF_SMALL)
    n, pos = s.count(), s.where("class_code <> 0").count()
    assert S.upsample_minority(s, 5).count() == n + 5 * pos
    w = S.upsample_weights(s, 5).agg(F.sum("copies")).first()[0]
    assert w == n + 5 * pos


def test_splits_disjoint_complete(spark):
    s = fx.sentences(spark, SF_SMALL).select(*KEY)
    sp = S.train_test_split(s, 0.2, KEY, seed=3, group="speech_id")
    assert sp.count() == s.count()
    per_speech = sp.groupBy("speech_id").agg(F.count_distinct("split").alias("k"))
    assert per_speech.where("k > 1").count() == 0
    ex = S.train_test_split_exact(s, 0.2, KEY, seed=3, bucket_bits=6)
    n = s.count()
    assert ex.count() == n
    assert ex.where("split = 'test'").count() == -(-2 * n // 10)
    # the exact split equals a plain global ranking by (hash, key)
    from stancekit.functions.hashing import portable_hash, sentence_key
    ref = s.withColumn("h", portable_hash(3, sentence_key())).orderBy("h", *KEY).limit(-(-2 * n // 10))
    assert ex.where("split = 'test'").select(*KEY).exceptAll(ref.select(*KEY)).count() == 0


def test_hot_roundtrip(spark):
    df = spark.createDataFrame([([0],), ([1, 2],), ([2],), ([],)], "ids array<int>")
    out = df.select("ids", L.hot_to_ids(L.multi_hot("ids")).alias("back")).collect()
    assert all(list(r["ids"]) == list(r["back"]) for r in out)


def test_micro_macro_identities(spark):
    s = fx.sentences(spark, SF_SMALL).where("split = 'test'")
    b = S.random_baseline(s, seed=1).select(L.multi_hot(L.label_ids("class_code")).alias("gold_vec"),
                                             L.multi_hot(L.label_ids("pred_code")).alias("pred_vec"))
    rep = {r["label"]: r for r in M.classification_report(b).collect()}
    macro = np.mean([rep[n]["f1"] for n in L.REPORT_NAMES])
    assert abs(macro - rep["macro avg"]["f1"]) < 1e-12
    # repartitioning does not change the report
    rep2 = {r["label"]: r["f1"] for r in M.classification_report(b.repartition(7)).collect()}
    assert all(abs(rep2[k] - rep[k]["f1"]) < 1e-12 for k in rep)


def test_halo_windows_equal_plain(spark):
    t = fx.sentences(spark, SF_SMALL).where("split = 'test'")
    small = W.prior_context(t, 5, block=4).select(*KEY, F.array_join("context", "|").alias("c"))
    w = Window.partitionBy("speech_id").orderBy("sent_idx").rowsBetween(-5, -1)
    plain = t.select(*KEY, F.array_join(F.collect_list("sentence").over(w), "|").alias("c"))
    assert small.exceptAll(plain).count() == 0 and plain.exceptAll(small).count() == 0
    pk = W.pack_window(t, block=3).select(*KEY, F.array_join("units", " ").alias("u"))
    pk2 = W.pack_window(t).select(*KEY, F.array_join("units", " ").alias("u"))
    assert pk.exceptAll(pk2).count() == 0
    r1 = W.speech_reset(t, block=2).select(*KEY, "is_start")
    assert r1.where("is_start = 1").count() == t.select("speech_id").distinct().count()


def test_dense_index_blocked(spark):
    t = S.word_band(fx.sentences(spark, SF_SMALL))
    a = W.dense_index(t, "speech_id", "sent_idx", block=3).select(*KEY, "row_idx")
    b = t.select(*KEY, (F.row_number().over(Window.partitionBy("speech_id").orderBy("sent_idx")) - 1).alias("row_idx"))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_global_index(spark):
    t = fx.sentences(spark, SF_SMALL).select(*KEY)
    g = W.global_index(t, KEY, partitions=5).orderBy("row_idx").collect()
    keys = sorted((r[0], r[1]) for r in g)
    assert [(r[0], r[1]) for r in g] == keys and [r["row_idx"] for r in g] == list(range(len(g)))


def test_knn_blocked_matches_brute_force(spark):
    v = fx.vectors(spark, SF_MID)
    q = v.where("role = 'query'").select(F.col("vec_id").alias("qid"), "embedding")
    c = v.where("role = 'corpus'").select(F.col("vec_id").alias("cid"), "embedding")
    got = {(r["qid"], r["rank"]): r["cid"] for r in R.knn_cosine(q, c, 5, block_bytes=4096).collect()}
    qs, cs = q.collect(), c.collect()
    cm = np.array([np.asarray(r[1], dtype=float) for r in cs])
    cm = cm / np.linalg.norm(cm, axis=1)[:, None]
    cid = np.array([r[0] for r in cs])
    for r in qs:
        x = np.asarray(r[1], dtype=float)
        sims = np.round(cm @ (x / np.linalg.norm(x)), 9)
        order = np.lexsort((cid, -sims))[:5]
        for rank, j in enumerate(order, 1):
            assert got[(r[0], rank)] == cid[j]


TOKENS = ["a", "-", "(", ")", "$", "%", '"', "'", "b", "cd"]


def _folded(spark, fn, rows):
    df = spark.createDataFrame([(i, t, [float(1 << k) for k in range(len(t))]) for i, t in enumerate(rows)],
                               "i int, t array<string>, s array<double>")
    return {r["i"]: [(x["token"], x["score"]) for x in r["m"]] for r in df.select("i", fn("t", "s").alias("m")).collect()}


def _runs(tokens, merged):
    """Lengths of the runs; scores are powers of two, so each says which tokens it holds."""
    out, at = [], 0
    for token, score in merged:
        n = 0
        while sum(1 << k for k in range(at, at + n)) < score:
            n += 1
        assert sum(1 << k for k in range(at, at + n)) == score and "".join(tokens[at:at + n]) == token
        out.append(tokens[at:at + n])
        at += n
    assert at == len(tokens)            # every token and score is kept, in order
    return out


def test_fold_properties(spark):
    rng = np.random.default_rng(3)
    rows = [[TOKENS[k] for k in rng.integers(0, len(TOKENS), rng.integers(0, 25))] for _ in range(300)]
    for i, merged in _folded(spark, A.merge_hyphens, rows).items():
        runs = _runs(rows[i], merged)
        assert all(len(r) == 1 or len(r) == 3 and r[1] == "-" for r in runs)
        for a, b, c in zip(runs, runs[1:], runs[2:]):      # no hyphen is left that could have joined single tokens
            assert not (len(a) == len(b) == 1 and b == ["-"])
    both = set(A.OPEN_SYMBOLS) & set(A.CLOSE_SYMBOLS)
    for i, merged in _folded(spark, A.merge_symbols, rows).items():
        runs = _runs(rows[i], merged)
        for r in runs:
            assert len(r) <= 3
            assert len(r) < 3 or r[0] in A.OPEN_SYMBOLS and r[2] in A.CLOSE_SYMBOLS
            assert len(r) != 2 or r[0] in A.OPEN_SYMBOLS or r[1] in A.CLOSE_SYMBOLS
        for r, nxt in zip(runs, runs[1:]):
            assert not (len(r) == 1 and r[0] in A.OPEN_SYMBOLS)                    # a free opening symbol takes its next token
            assert not (len(r) == 1 and nxt[0] in A.CLOSE_SYMBOLS and r[0] not in both)


def test_merges_are_linear(spark):
    import time
    took = []
    for n in (20000, 40000):
        rows = spark.createDataFrame([(["a", "(", "b", ")", "-"] * (n // 5), [0.5] * n)], "t array<string>, s array<double>")
        best = 1e9
        for _ in range(3):
            t0 = time.time()
            rows.select(F.size(A.merge_symbols("t", "s")), F.size(A.merge_hyphens("t", "s")), F.size(A.words_max("t", "s"))).collect()
            best = min(best, time.time() - t0)
        took.append(best)
    assert took[1] < 2.0 and took[1] < 4 * took[0]


def test_align_rows():
    from tests.align_brute import align_row
    got = align_row(["—", "—", "—"], [1.0, 1.0, 1.0], ["——", "—"], "sum")
    assert [(r["word_idx"], r["score"], r["aligned"]) for r in got] == [(0, 1.0, True), (1, 2.0, False)]
    assert align_row(["a", "b"], [1.0, 2.0], [], "sum")[0]["word_idx"] is None
    assert align_row([], [], ["a"]) == []


def test_align_words_equals_brute_force(spark):
    from tests.align_brute import align_row
    rng = np.random.default_rng(5)
    parts = ["ab", "—", "c.", "!", "7", "", "é", None]
    cases = [(["—", "—", "—"], [1.0, 1.0, 1.0], ["——", "—"]), (["a", "b"], [1.0, 2.0], []), ([], [], ["a"]), (None, None, None),
             (["a", "!"], [None, None], ["a!"]), (["a", "b", "c"], [1.0], ["a", "b"])]
    for _ in range(1500):
        p = [parts[k] for k in rng.integers(0, 8, rng.integers(0, 9))]
        scores = [None if v > 3.5 else float(v) for v in rng.integers(-8, 9, len(p)) / 2]
        cases.append((p, scores, [parts[k] for k in rng.integers(0, 8, rng.integers(0, 6))]))
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, p array<string>, s array<double>, w array<string>")
    for agg in ("max", "sum"):
        got = {r["k"]: [x.asDict() for x in r["a"]] for r in rows.select("k", A.align_words("p", "s", "w", agg).alias("a")).collect()}
        for k, (p, s, w) in enumerate(cases):
            want = align_row(p or [], s or [], w or [], agg)
            assert got[k] == want, (agg, p, s, w)
            if agg == "sum":                            # no score is lost, whatever the texts
                assert sum(r["score"] or 0.0 for r in got[k]) == sum(v or 0.0 for _, v in zip(p or [], s or []))


def test_align_words_takes_linear_time(spark):
    import time
    took = []
    for n in (20000, 40000):
        rows = spark.createDataFrame([(["ab", "!", "c", ""] * (n // 4), [0.5] * n, ["ab!", "c", ""] * (n // 4))],
                                     "p array<string>, s array<double>, w array<string>")
        best = 1e9
        for _ in range(3):
            t0 = time.time()
            rows.select(F.size(A.align_words("p", "s", "w"))).collect()
            best = min(best, time.time() - t0)
        took.append(best)
    assert took[1] < 3.0 and took[1] < 4 * took[0]


def _sides(spark, qid="qid", cid="cid"):
    v = fx.vectors(spark, SF_MID)
    q = v.where("role = 'query'").select(F.col("vec_id").alias(qid), "embedding")
    return q, v.where("role = 'corpus'").select(F.col("vec_id").alias(cid), "embedding")


def test_lsh_finds_k_for_every_query(spark):
    q, c = _sides(spark)
    near = R.knn_cosine_lsh(q, c, 8)
    exact = {(r["qid"], r["cid"]) for r in R.knn_cosine(q, c, 8).collect()}
    approx = {(r["qid"], r["cid"]) for r in near.collect()}
    assert len(approx) == len(exact) and len(exact & approx) / len(exact) >= 0.5
    assert R.knn_cosine_lsh(q, c.limit(3), 8).count() == 3 * q.count()      # fewer rows than k
    assert R.knn_cosine_lsh(q.limit(0), c, 8).count() == 0


def test_knn_with_string_and_wide_keys(spark):
    q, c = _sides(spark)
    plain = {(r["qid"], r["rank"]): r["cid"] for r in R.knn_cosine(q, c, 5).collect()}
    qs = q.withColumn("qid", F.format_string("q-%05d", "qid"))
    cs = c.withColumn("cid", F.format_string("c-%05d", "cid"))
    got = {(r["qid"], r["rank"]): r["cid"] for r in R.knn_cosine(qs, cs, 5, block_bytes=8192).collect()}
    assert got == {(f"q-{a:05d}", k): f"c-{b:05d}" for (a, k), b in plain.items()}
    wide = q.withColumn("qid", F.col("qid") + (1 << 60))
    assert {(r["qid"] - (1 << 60), r["rank"]): r["cid"] for r in R.knn_cosine(wide, c, 5).collect()} == plain
    for a, b in ((q.limit(0), c), (q, c.limit(0))):
        none = R.knn_cosine(a, b, 5)
        assert none.columns == ["qid", "cid", "rank", "sim"] and none.count() == 0


def test_knn_lexical_blocks_and_string_ids(spark):
    from stancekit.operators import features as FE
    s = fx.sentences(spark, SF_SMALL).withColumn("speech_id", F.concat(F.lit("speech "), F.col("speech_id")))
    tr, te = s.where("split = 'train'"), s.where("split = 'test'")
    vocab = FE.fit_vocabulary(tr, min_df=5)
    a, b = FE.tfidf_rows(te, vocab), FE.tfidf_rows(tr, vocab)
    one = sorted(map(tuple, R.knn_lexical(a, b, 3).collect()))
    many = sorted(map(tuple, R.knn_lexical(a, b, 3, block_bytes=20000).collect()))
    assert one == many and one and one[0][0].startswith("speech ")
    assert R.knn_lexical(a.limit(0), b, 3).count() == 0


def test_windows_with_gaps(spark):
    rows = [("s", p, f"t{p}") for p in range(0, 60, 3)] + [("t", 1000000, "x"), ("t", 2000000, "y")]
    df = spark.createDataFrame(rows, "speech_id string, sent_idx int, sentence string")
    sizes = []
    for block in (2, 9, 4096):
        got = {(r["speech_id"], r["sent_idx"]): list(r["context"]) for r in W.prior_context(df, 5, block=block).collect()}
        sizes.append(got)
        assert got[("s", 21)] == ["t6", "t9", "t12", "t15", "t18"] and got[("t", 2000000)] == ["x"]
        starts = W.speech_reset(df, block=block).where("is_start = 1").select(*KEY).collect()
        assert sorted(map(tuple, starts)) == [("s", 0), ("t", 1000000)]
        packed = {(r[0], r[1]): list(r[2]) for r in W.pack_window(df, block=block).select(*KEY, "units").collect()}
        sizes.append(packed)
    assert sizes[0] == sizes[2] == sizes[4] and sizes[1] == sizes[3] == sizes[5]


def test_kshot_short_class_raises(spark):
    import pytest
    tr = fx.sentences(spark, SF_SMALL).where("split = 'train'")
    with pytest.raises(ValueError):
        S.kshot_sample(tr, 64)
    assert S.kshot_sample(tr, 16).count() == 16
    assert 16 < S.kshot_sample(tr, 64, strict=False).count() < 64


def test_annotate_failures_kept(spark):
    from stancekit.operators import annotate as AN
    from stancekit.operators import prompts as P
    t = P.prompt_zero_shot(fx.sentences(spark, SF_SMALL).where("split = 'test'")).drop("messages")
    t = t.withColumn("prompt", F.concat("prompt", F.when(F.col("sent_idx") % 50 == 0, F.repeat(F.lit("long "), 20000)).otherwise("")))
    quiet = AN.annotate(t, lambda: AN.StubScorer(0.05))
    loud = AN.annotate(t, lambda: AN.StubScorer(0.05, raising=True))     # one exception must not end the job
    ok, bad = AN.split_failed(loud)
    assert ok.count() + bad.count() == t.count() and bad.count() > 0
    assert bad.where("model_response is not null").count() == 0
    assert sorted(map(str, loud.collect())) == sorted(map(str, quiet.collect()))
    fails = {(r[0], r[1]) for r in bad.select(*KEY).collect()}
    want = {(r[0], r[1]) for r in t.select(*KEY, "prompt").collect() if AN.StubScorer.draws(r["prompt"])[1] < 0.05}
    assert fails == want                                                 # by hash, whatever the length


def test_scratch_needs_a_shared_folder(spark):
    import pytest

    from stancekit import session
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://x", ""):
        with pytest.raises(RuntimeError):
            session.own_root(master)
    assert session.own_root("local[4]") and session.own_root("local")


def test_nothing_stays_behind(spark):
    import os

    from stancekit import session
    from stancekit.plans import catalog
    qs = catalog.QUERIES_LOADED()
    before = set(session._persisted(spark))
    with session.scratch_scope(spark):
        since = len(session._SCRATCH)
        for name in ("tfidf", "quarantine_failed", "knn_cosine"):
            qs[name](spark, SF_SMALL).count()
        made = [p.removeprefix("file:") for p in session._SCRATCH[since:]]
        assert made and all(os.path.exists(p) for p in made)
        assert set(session._persisted(spark)) <= before       # no frame is left persisted
    assert not any(os.path.exists(p) for p in made)


def test_exact_split_of_nothing(spark):
    s = fx.sentences(spark, SF_SMALL).select(*KEY)
    assert S.train_test_split_exact(s.limit(0), 0.2, KEY).count() == 0


def test_copies_as_weights_equal_physical_copies(spark):
    """Fitting with a copies weight agrees with fitting on duplicated rows."""
    from stancekit.operators import features as FE
    from stancekit.operators import linear as LN
    tr = fx.sentences(spark, SF_SMALL).where("split = 'train'")
    weighted = S.upsample_weights(tr)
    physical = S.upsample_minority(tr).withColumn("sent_idx", F.col("sent_idx") * 10 + F.col("copy_no"))
    vocab = FE.fit_vocabulary(weighted, weight_col="copies", min_df=5)
    vocab_p = FE.fit_vocabulary(physical, min_df=5)
    assert sorted(r[0] for r in vocab.select("term").collect()) == sorted(r[0] for r in vocab_p.select("term").collect())
    terms, idf = LN.collect_vocabulary(vocab)
    gold = L.multi_hot(L.label_ids(F.col("class_code")))
    vw = LN.tfidf_vectors(FE.with_grams(weighted).withColumn("gold_vec", gold), terms, idf)
    vp = LN.tfidf_vectors(FE.with_grams(physical).withColumn("gold_vec", gold), terms, idf)
    cw, _ = LN.train_linear_svm(vw, terms, weight_col="copies", max_iter=50, k=1)
    cp, _ = LN.train_linear_svm(vp, terms, max_iter=50, k=1)
    a = {r[0]: r[1] for r in cw.select("term", "weight").collect()}
    b = {r[0]: r[1] for r in cp.select("term", "weight").collect()}
    same_sign = sum((a[t] > 0) == (b[t] > 0) for t in a) / len(a)
    assert same_sign >= 0.95


def test_annotate_hands_out_slices(spark):
    """A scorer gets a bounded number of prompts at once, whatever the size of an Arrow batch; other columns stay."""
    from stancekit.operators import annotate as AN
    t = spark.range(5000, numPartitions=1).select("id", F.array("id").alias("kept"), F.col("id").cast("string").alias("prompt"))
    got = AN.annotate(t, lambda: lambda prompts: [str(len(prompts))] * len(prompts), opening="").collect()
    assert [r["kept"] for r in sorted(got)] == [[i] for i in range(5000)] and len(got) == 5000
    assert 0 < max(int(r["model_response"]) for r in got) <= 1024
