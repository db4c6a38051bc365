"""Plan shapes that the design for scale relies on."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from stancekit.operators import attribution as A
from stancekit.operators import features as FE
from stancekit.operators import retrieval as R
from stancekit.operators import sampling as S
from stancekit.operators import windows as W
from stancekit.plans import catalog
from stancekit.sources import fixtures as fx


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_pushes_split(spark):
    p = _plan(fx.sentences(spark, SF_SMALL).where("split = 'test'").select("speech_id", "sentence"))
    scan = [x for x in p.split("\n") if "FileScan parquet" in x and "text" in x][0]
    assert "lang" not in scan and "n_chars" not in scan          # only doc_id, text read
    assert "DataFilters" in scan and "md5" in scan                # split predicate at the scan


def test_report_single_small_shuffle(spark):
    p = _plan(catalog.QUERIES_LOADED()["classification_report"](spark, SF_SMALL))
    ex = [x for x in p.split("\n") if "Exchange" in x and "Broadcast" not in x]
    assert len(ex) == 1 and "SinglePartition" in ex[0]
    assert "partial_sum" in p


def test_per_class_sample_is_limited_before_shuffle(spark):
    tr = fx.sentences(spark, SF_SMALL).where("split = 'train'")
    p = _plan(S.kshot_sample(tr, 16))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_context_window_is_blocked(spark):
    t = fx.sentences(spark, SF_SMALL).where("split = 'test'")
    p = _plan(W.prior_context(t, 5))
    assert "hashpartitioning(speech_id" in p and "_blk" in p


def test_tfidf_is_map_only(spark):
    rows = spark.createDataFrame([(1, 0, "a text of some words", 1)], "speech_id long, sent_idx int, sentence string, copies int")
    vocab = spark.createDataFrame([("text", 1.5), ("some words", 2.0)], "term string, idf double")
    assert "Exchange" not in _plan(FE.tfidf(rows, vocab))
    assert "Exchange" not in _plan(FE.term_counts(rows))
    terms = FE.vocabulary(FE.term_counts(rows), F.lit(1.0), 1)
    below = _plan(terms.select("term"))
    assert below.count("Exchange hashpartitioning") == 1 and "hashpartitioning(term" in below   # the term aggregate's own


def test_merges_of_arrays_need_no_exchange(spark):
    x = fx.bpe_arrays(spark, SF_SMALL, "sentence").select("toks", "scores", F.split("sentence", " ", -1).alias("words"))
    base = _plan(x).count("Exchange")
    for c in (A.words_max("toks", "scores"), A.words_sum("toks", "scores"), A.merge_hyphens("toks", "scores"),
              A.merge_symbols("toks", "scores"), A.align_words("toks", "scores", "words")):
        plan = _plan(x.select(c.alias("m")))
        assert plan.count("Exchange") == base and "Python" not in plan and "Pandas" not in plan


def test_knn_has_no_pairwise_join(spark):
    v = fx.vectors(spark, SF_SMALL)
    q = v.where("role = 'query'").select(F.col("vec_id").alias("qid"), "embedding")
    c = v.where("role = 'corpus'").select(F.col("vec_id").alias("cid"), "embedding")
    p = _plan(R.knn_cosine(q, c, 8))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "FlatMapCoGroups" in p


def test_vector_facts_read_stored_values(spark):
    """No dense array a row, which would be as long as the vocabulary."""
    p = catalog.QUERIES_LOADED()["tfidf_vectors"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert ".values AS _v" in p
