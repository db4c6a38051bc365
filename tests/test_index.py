"""The inverted index and the vocabulary's sketch against plain computation."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stancekit import session
from stancekit.operators import features as FE
from stancekit.operators import retrieval as R
from stancekit.operators import sampling as S
from stancekit.sources import fixtures as fx


def corpus(rng, n, terms, unit=True):
    rows = []
    for _ in range(n):
        t = rng.choice(terms, rng.integers(0, 9), replace=False, p=np.arange(1, terms + 1) / (terms * (terms + 1) / 2))
        w = rng.random(len(t)) + 0.05
        rows.append((t, w / np.linalg.norm(w) if unit and len(w) else w))
    return rows + rows[:n // 5]                        # equal rows tie


@pytest.mark.parametrize("unit", [True, False])
def test_search_keeps_the_k_best(unit):
    rng = np.random.default_rng(3)
    rows = corpus(rng, 4000, 40, unit)
    term = np.concatenate([t for t, _ in rows])
    value, where = np.concatenate([w for _, w in rows]), np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
    lists = {}
    for t in range(40):
        r, v = where[term == t], value[term == t]
        by = np.lexsort((r, -v))
        lists[t] = R.Postings(r[by], v[by])
    longest = max(float(np.linalg.norm(w)) if len(w) else 0.0 for _, w in rows)
    dense = np.zeros((len(rows), 41))
    dense[where, term] = value
    total = used = 0
    for t, w in corpus(rng, 60, 41, unit):
        q = np.zeros(41)
        q[t] = w
        want = np.round(dense[:, :40] @ q[:40], R.SIM_DIGITS)
        order = [i for i in np.lexsort((np.arange(len(want)), -want)) if want[i] > 0][:8]
        got, sims, shared, scored = R.search_postings(lists, longest, t.tolist(), w.tolist(), 8)
        assert got.tolist() == order and np.allclose(sims, want[order], atol=2e-9)
        total, used = total + shared, used + scored
    assert used < total


def test_search_counts_copies():
    """Rows may stand for copies and be numbered in another order than that of ties; a prepared index is left as it was."""
    rng = np.random.default_rng(11)
    rows = corpus(rng, 3000, 60)[:3000]
    term, value = np.concatenate([t for t, _ in rows]), np.concatenate([w for _, w in rows])
    where = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
    lists = {}
    for t in range(60):
        r, v = where[term == t], value[term == t]
        by = np.lexsort((r, -v))
        lists[t] = R.Postings(r[by], v[by])
    index = R.PostingLists(lists)
    index.copies, index.order = rng.integers(1, 9, len(index.sums)), rng.permutation(len(index.sums))
    dense = np.zeros((len(index.sums), 60))
    dense[where, term] = value
    total = used = 0
    for t, w in corpus(rng, 80, 60):
        want = np.round(dense[:, t] @ w, R.SIM_DIGITS) if len(t) else np.zeros(len(dense))
        order = [i for i in np.lexsort((index.order, -want)) if want[i] > 0]
        keep = [i for i in order[:8] if index.copies[[j for j in order if want[j] > want[i]]].sum() < 8]
        got, sims, shared, scored = R.search_postings(index, index.longest, t.tolist(), w.tolist(), 8)
        assert got.tolist() == keep and np.allclose(sims, want[keep], atol=2e-9)
        assert not index.sums.any() and not index.weights.any()
        total, used = total + shared, used + scored
    assert used < total


def test_equal_rows_are_searched_once(spark, monkeypatch):
    """Copies cost no more searches or postings, yet every row has all its neighbours."""
    text = lambda i: f"w{i % 7} w{i % 5} w{i % 3} w{i % 11}"
    make = lambda ids: spark.createDataFrame([(i, 0, text(i % 40)) for i in ids], "speech_id long, sent_idx int, sentence string")
    vocab = spark.createDataFrame([(f"w{i}", 1.0 + i / 7) for i in range(11)], "term string, idf double")
    q, c = (FE.tfidf_rows(make(ids), vocab) for ids in (range(1000, 1400), range(800)))
    asked = R.lexical_search(q, c)[0].where("_row >= 0").select("_q").distinct().count()
    assert asked <= 40                                  # 400 rows, 40 texts
    got = sorted(map(tuple, R.knn_lexical(q, c).collect()))
    flat = lambda x: [(r["speech_id"], dict(zip(r["idx"], r["weight"]))) for r in x.collect()]
    corpus_rows = flat(c)
    want = []
    for i, w in flat(q):
        near = sorted((-round(sum(w[t] * v.get(t, 0.0) for t in w), 9), j) for j, v in corpus_rows)[:8]
        want += [(i, 0, j, 0, n, -s) for n, (s, j) in enumerate(near, 1) if s < 0]
    assert [x[:5] for x in got] == [x[:5] for x in sorted(want)]
    assert np.allclose([x[5] for x in got], [x[5] for x in sorted(want)], atol=2e-9)
    work = R.lexical_work(q, c).first()
    plain = sum(len(w.keys() & v.keys()) for _, w in flat(q) for _, v in corpus_rows)
    assert work["shared"] == plain and work["scored"] * 100 < plain


def test_sketch_loses_no_term(spark, monkeypatch):
    train = S.upsample_weights(fx.sentences(spark, SF_SMALL).where("split = 'train'"))
    plain = FE.vocabulary(FE.term_counts(train, extra=["copies"]), FE.document_total(train, "copies"), weight_col="copies")
    want = sorted(map(tuple, plain.select("term", "df", "ctf").collect()))
    for buckets in (1 << 22, 512):                      # with few buckets nothing is pruned, nothing is lost
        monkeypatch.setattr(FE, "BUCKETS", buckets)
        assert sorted(map(tuple, FE.fit_vocabulary(train, weight_col="copies").select("term", "df", "ctf").collect())) == want


def test_vocabulary_counts_few_buckets(spark, monkeypatch):
    """Where every bucket reaches ``min_df``, only the largest are counted term by term, unless they may miss a term."""
    train = S.upsample_weights(fx.sentences(spark, SF_SMALL).where("split = 'train'"))
    plain = FE.vocabulary(FE.term_counts(train, extra=["copies"]), FE.document_total(train, "copies"), 1, 0.5, 40, "copies")
    want = sorted(map(tuple, plain.select("term", "df", "ctf").collect()))
    vocabulary, counted = FE.vocabulary, []

    def counting(terms, *a):
        counted.append(terms.select("term").distinct().count())
        return vocabulary(terms, *a)

    monkeypatch.setattr(FE, "vocabulary", counting)
    for buckets, wide in ((1 << 16, 4), (1 << 10, 1)):    # the second has to count again
        monkeypatch.setattr(FE, "BUCKETS", buckets)
        monkeypatch.setattr(FE, "WIDE", wide)
        got = FE.fit_vocabulary(train, weight_col="copies", min_df=1, max_features=40)
        assert sorted(map(tuple, got.select("term", "df", "ctf").collect())) == want
    assert counted[0] < FE.term_counts(train).select("term").distinct().count() / 10
    assert len(counted) > 2


def test_sketch_prunes(spark):
    rows = spark.createDataFrame([(i, 0, f"common words and rare{i} thing{i}") for i in range(50)], "speech_id long, sent_idx int, sentence string")
    able = FE.plausible(FE.with_grams(rows, "sentence", "_grams"), None, 20)
    assert able.count() == 6                            # common, words, and, their two bigrams and the trigram
    assert FE.fit_vocabulary(rows, max_df=1.0).count() == 6


def test_large_vocabulary_plans_and_runs(spark):
    vocab = spark.range(300_000).select(F.concat(F.lit("term"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("term"), F.lit(1.0).alias("idf"))
    rows = spark.createDataFrame([(1, 0, "term0000007 term0000007 term0299999 x")], "speech_id long, sent_idx int, sentence string")
    assert sorted((r["term"], r["tf"]) for r in FE.tfidf(rows, vocab).collect()) == [("term0000007", 2), ("term0299999", 1)]


def test_spread_deals_small_inputs_only(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    assert 0 < session.input_bytes(docs) < session.ROW_GROUP
    assert "Repartition" in session.spread(docs, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(session, "ROW_GROUP", 1)
    assert session.spread(docs, "doc_id") is docs
