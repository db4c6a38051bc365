"""Catalog: retrieval operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from stancekit.operators import features as FE
from stancekit.operators import retrieval as R
from stancekit.plans.catalog import register
from stancekit.plans.q_features import _test, train_vocabulary
from stancekit.plans.sqlfrag import cte, with_ctes
from stancekit.sources import fixtures as fx

KEY = ["speech_id", "sent_idx"]

cte("knn_vec", ["vectors"], """
SELECT qid, cid, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS rank
FROM (
  SELECT q.vec_id AS qid, c.vec_id AS cid,
         round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])
               / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))
                  * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 9) AS sim
  FROM (SELECT * FROM vectors WHERE role = 'query') q, (SELECT * FROM vectors WHERE role = 'corpus') c
)""")

cte("knn_lex", ["test_tfidf", "train_tfidf"], """
SELECT qs AS q_speech_id, qi AS q_sent_idx, cs AS c_speech_id, ci AS c_sent_idx, sim,
       row_number() OVER (PARTITION BY qs, qi ORDER BY sim DESC, cs, ci) AS rank
FROM (
  SELECT q.speech_id AS qs, q.sent_idx AS qi, c.speech_id AS cs, c.sent_idx AS ci, round(SUM(q.weight * c.weight), 9) AS sim
  FROM test_tfidf q JOIN train_tfidf c ON q.term = c.term
  GROUP BY q.speech_id, q.sent_idx, c.speech_id, c.sent_idx
) WHERE sim > 0""")


def _vec_sides(spark, sf):
    v = fx.vectors(spark, sf)
    q = v.where(F.col("role") == "query").select(F.col("vec_id").alias("qid"), "embedding")
    c = v.where(F.col("role") == "corpus").select(F.col("vec_id").alias("cid"), "embedding")
    return q, c


_KNN_VEC_SQL = "SELECT qid, cid, rank::BIGINT AS rank, round(sim, 6) AS sim FROM knn_vec WHERE rank <= {k}"


@register("knn_cosine", with_ctes(["knn_vec"], _KNN_VEC_SQL.format(k=8)))
def q_knn_cosine(spark, sf):
    """8 nearest corpus vectors by cosine for every query vector (exact)."""
    q, c = _vec_sides(spark, sf)
    return R.knn_cosine(q, c, 8)


@register("knn_cosine_blocked", with_ctes(["knn_vec"], _KNN_VEC_SQL.format(k=8)))
def q_knn_cosine_blocked(spark, sf):
    """Same answer with both sides cut into many blocks."""
    q, c = _vec_sides(spark, sf)
    return R.knn_cosine(q, c, 8, block_bytes=16 << 10)


@register("retrieval_rank", with_ctes(["knn_vec"], _KNN_VEC_SQL.format(k=3)))
def q_retrieval_rank(spark, sf):
    """Rank within each query, keep 3."""
    q, c = _vec_sides(spark, sf)
    return R.knn_cosine(q, c, 3)


LSH_RECALL = 0.9   # stated floor


@register("knn_cosine_lsh", with_ctes(["vectors"], """
SELECT vec_id AS qid, least(8, (SELECT COUNT(*) FROM vectors WHERE role = 'corpus'))::BIGINT AS n_found, 1::BIGINT AS recall_ok, 1::BIGINT AS half_skipped
FROM vectors WHERE role = 'query'"""))
def q_knn_cosine_lsh(spark, sf):
    """Approximate neighbours: rows per query, whether the recall over all queries against the exact
    search reaches the stated floor, and whether the index met fewer than half of all pairs."""
    q, c = _vec_sides(spark, sf)
    work: list[float] = []
    near = R.knn_cosine_lsh(q, c, 8, work=work)
    exact = R.knn_cosine(q, c, 8).select("qid", "cid", F.lit(1).alias("hit"))
    j = near.join(exact, ["qid", "cid"], "left").groupBy("qid").agg(F.count(F.lit(1)).alias("n_found"), F.count("hit").alias("hits"))
    recall = j.agg((F.sum("hits") / F.sum("n_found")).alias("r")).scalar()
    return j.select("qid", "n_found", (recall >= LSH_RECALL).cast("int").alias("recall_ok"), F.lit(int(max(work, default=0.0) < 0.5)).alias("half_skipped"))


def lexical_knn(spark, sf, k=8):
    vocab = train_vocabulary(spark, sf)
    train = fx.sentences(spark, sf).where(F.col("split") == "train")
    return R.knn_lexical(FE.tfidf_rows(_test(spark, sf), vocab), FE.tfidf_rows(train, vocab), k)


@register("knn_lexical", with_ctes(["knn_lex"], """
SELECT q_speech_id, q_sent_idx, c_speech_id, c_sent_idx, rank::BIGINT AS rank, round(sim, 6) AS sim FROM knn_lex WHERE rank <= 8"""))
def q_knn_lexical(spark, sf):
    """8 most similar train sentences (tf-idf cosine) for every test sentence."""
    return lexical_knn(spark, sf)


@register("knn_lexical_work", with_ctes(["test_tfidf", "train_tfidf"], """
SELECT COUNT(*)::BIGINT AS shared, 1::BIGINT AS half_skipped FROM test_tfidf q JOIN train_tfidf c ON q.term = c.term"""))
def q_knn_lexical_work(spark, sf):
    """Postings that the test sentences share with the train sentences, and whether the search scores fewer than half."""
    vocab = train_vocabulary(spark, sf)
    train = fx.sentences(spark, sf).where(F.col("split") == "train")
    work = R.lexical_work(FE.tfidf_rows(_test(spark, sf), vocab), FE.tfidf_rows(train, vocab))
    return work.select("shared", (F.col("scored") * 2 < F.col("shared")).cast("int").alias("half_skipped"))


@register("exclude_train_leak", with_ctes(["knn_lex", "sentences"], """
SELECT COUNT(DISTINCT (k.q_speech_id, k.q_sent_idx))::BIGINT AS n_queries, COUNT(*)::BIGINT AS n_pairs,
       COUNT(*) FILTER (WHERE s.split <> 'train')::BIGINT AS n_leaked
FROM (SELECT * FROM knn_lex WHERE rank <= 8) k
JOIN sentences s ON s.speech_id = k.c_speech_id AND s.sent_idx = k.c_sent_idx"""))
def q_exclude_train_leak(spark, sf):
    """Retrieval reads train only: leaked pairs must be 0."""
    k = lexical_knn(spark, sf)
    s = fx.sentences(spark, sf).select(F.col("speech_id").alias("c_speech_id"), F.col("sent_idx").alias("c_sent_idx"), "split")
    j = k.join(s, ["c_speech_id", "c_sent_idx"])
    return j.agg(F.count_distinct("q_speech_id", "q_sent_idx").alias("n_queries"), F.count(F.lit(1)).alias("n_pairs"),
                 F.count_if(F.col("split") != "train").alias("n_leaked"))


_RET_SQL = """
SELECT q_speech_id AS speech_id, q_sent_idx AS sent_idx,
       string_agg(CAST(rank AS VARCHAR) || '. "' || s.sentence || '" - Category (' || ['a', 'b', 'c', 'd'][s.class_code + 1] || ')', chr(10) ORDER BY rank) AS retrieved,
       COUNT(*)::BIGINT AS n_retrieved
FROM (SELECT * FROM knn_lex WHERE rank <= 8) k JOIN train_rows s ON s.speech_id = k.c_speech_id AND s.sent_idx = k.c_sent_idx
GROUP BY q_speech_id, q_sent_idx"""
cte("retrieved", ["knn_lex", "train_rows"], _RET_SQL)


def retrieved(spark, sf):
    k = lexical_knn(spark, sf)
    tr = fx.sentences(spark, sf).where(F.col("split") == "train")
    r = R.retrieved_docs(k, tr, ["q_speech_id", "q_sent_idx"], ["c_speech_id", "c_sent_idx"])
    return r.withColumnRenamed("q_speech_id", "speech_id").withColumnRenamed("q_sent_idx", "sent_idx")


@register("retrieved_docs", with_ctes(["retrieved"], "SELECT * FROM retrieved"))
def q_retrieved_docs(spark, sf):
    """Numbered '"sentence" - Category (x)' lines per test sentence."""
    return retrieved(spark, sf)
