"""Catalog: lexical features and the linear model."""
from __future__ import annotations

from pyspark.sql import functions as F

from stancekit.functions import labels as L
from stancekit.functions.text import ngrams, tokenize
from stancekit.operators import features as FE
from stancekit.operators import linear as LN
from stancekit.operators import sampling as S
from stancekit.plans.catalog import register
from stancekit.plans.sqlfrag import U, cte, lit, with_ctes
from stancekit.session import materialize, spread
from stancekit.sources import fixtures as fx
from stancekit.functions.text import TOKEN_PATTERN

KEY = ["speech_id", "sent_idx"]


def _train_w(spark, sf):
    return S.upsample_weights(fx.sentences(spark, sf).where(F.col("split") == "train").drop("split"))


def _test(spark, sf):
    return fx.sentences(spark, sf).where(F.col("split") == "test").drop("split")


def train_vocabulary(spark, sf):
    """Vocabulary of the upsampled train split."""
    return FE.fit_vocabulary(_train_w(spark, sf), weight_col="copies")


def train_tfidf(spark, sf, vocab):
    return FE.tfidf(_train_w(spark, sf), vocab)


def test_tfidf(spark, sf, vocab):
    return FE.tfidf(_test(spark, sf), vocab)


# ---------------------------------------------------------------- SQL side
def sql_tokens(s: str) -> str:
    return f"regexp_extract_all(lower({s}), {lit(TOKEN_PATTERN)}, 1)"


def sql_ngrams(t: str, lo: int = 1, hi: int = 3) -> str:
    parts = [f"list_transform(range(0, len({t}) - {n - 1}), lambda i: array_to_string(list_slice({t}, i + 1, i + {n}), ' '))"
             for n in range(lo, hi + 1)]
    return f"flatten([{', '.join(parts)}])"


cte("train_w", ["train_rows"], "SELECT *, CASE WHEN class_code <> 0 THEN 6 ELSE 1 END AS copies FROM train_rows")
cte("train_terms", ["train_w"], f"""
SELECT speech_id, sent_idx, copies, term, COUNT(*)::BIGINT AS tf
FROM (SELECT speech_id, sent_idx, copies, unnest({sql_ngrams('t')}) AS term
      FROM (SELECT speech_id, sent_idx, copies, {sql_tokens('sentence')} AS t FROM train_w))
GROUP BY speech_id, sent_idx, copies, term""")
cte("vocab", ["train_terms", "train_w"], """
SELECT term, df, ctf, ln((1 + n) / (1 + df)) + 1 AS idf
FROM (SELECT term, SUM(copies)::BIGINT AS df, SUM(tf * copies)::BIGINT AS ctf FROM train_terms GROUP BY term),
     (SELECT SUM(copies)::DOUBLE AS n FROM train_w)
WHERE df >= 20 AND df <= 0.5 * n
ORDER BY ctf DESC, term LIMIT 10000""")
cte("train_tfidf", ["train_terms", "vocab"], """
SELECT speech_id, sent_idx, term, tf, w / sqrt(SUM(w * w) OVER (PARTITION BY speech_id, sent_idx)) AS weight
FROM (SELECT t.speech_id, t.sent_idx, t.term, t.tf, t.tf * v.idf AS w FROM train_terms t JOIN vocab v ON t.term = v.term)""")
cte("test_terms", ["test_rows"], f"""
SELECT speech_id, sent_idx, term, COUNT(*)::BIGINT AS tf
FROM (SELECT speech_id, sent_idx, unnest({sql_ngrams('t')}) AS term
      FROM (SELECT speech_id, sent_idx, {sql_tokens('sentence')} AS t FROM test_rows))
GROUP BY speech_id, sent_idx, term""")
cte("all_terms", ["sentences"], f"""
SELECT speech_id, sent_idx, term, COUNT(*)::BIGINT AS tf
FROM (SELECT speech_id, sent_idx, unnest({sql_ngrams('t')}) AS term
      FROM (SELECT speech_id, sent_idx, {sql_tokens('sentence')} AS t FROM sentences))
GROUP BY speech_id, sent_idx, term""")
cte("test_tfidf", ["test_terms", "vocab"], """
SELECT speech_id, sent_idx, term, tf, w / sqrt(SUM(w * w) OVER (PARTITION BY speech_id, sent_idx)) AS weight
FROM (SELECT t.speech_id, t.sent_idx, t.term, t.tf, t.tf * v.idf AS w FROM test_terms t JOIN vocab v ON t.term = v.term)""")
cte("coef", ["vocab"], f"""
SELECT term, label, {U('201 + label', 'term')} - 0.5 AS weight
FROM (SELECT term, unnest([0, 1, 2]) AS label FROM vocab)""")
cte("test_margins", ["test_rows", "test_tfidf", "coef"], f"""
SELECT speech_id, sent_idx, label, SUM(c) + {fx.COEF_BIAS} AS margin
FROM (
  SELECT t.speech_id, t.sent_idx, c.label, t.weight * c.weight AS c FROM test_tfidf t JOIN coef c ON t.term = c.term
  UNION ALL
  SELECT speech_id, sent_idx, unnest([0, 1, 2]) AS label, 0.0 AS c FROM test_rows
) GROUP BY speech_id, sent_idx, label""")


# ---------------------------------------------------------------- queries
@register("tokenize", with_ctes(["sentences"], f"""
SELECT speech_id, sent_idx, array_to_string({sql_tokens('sentence')}, ' ') AS tokens FROM sentences"""))
def q_tokenize(spark, sf):
    return fx.sentences(spark, sf).select(*KEY, F.array_join(tokenize(F.col("sentence")), " ").alias("tokens"))


@register("ngrams", with_ctes(["sentences"], f"""
SELECT speech_id, sent_idx, len(g)::BIGINT AS n_grams, array_to_string(g, '|') AS grams
FROM (SELECT speech_id, sent_idx, {sql_ngrams('t')} AS g FROM (SELECT speech_id, sent_idx, {sql_tokens('sentence')} AS t FROM sentences))"""))
def q_ngrams(spark, sf):
    g = ngrams(tokenize(F.col("sentence")), 1, 3)
    return fx.sentences(spark, sf).select(*KEY, F.size(g).alias("n_grams"), F.array_join(g, "|").alias("grams"))


@register("term_counts", with_ctes(["all_terms"], "SELECT speech_id, sent_idx, term, tf FROM all_terms"))
def q_term_counts(spark, sf):
    """1-3-gram frequency per row, counted inside each row."""
    return FE.term_counts(fx.sentences(spark, sf))


@register("vocabulary", with_ctes(["vocab"], "SELECT term, df, ctf FROM vocab"))
def q_vocabulary(spark, sf):
    """20 <= df <= 0.5 n over the upsampled train split, top 10,000 by count."""
    vocab = train_vocabulary(spark, sf)
    return vocab.select("term", "df", "ctf")


@register("idf", with_ctes(["vocab"], "SELECT term, round(idf, 6) AS idf FROM vocab"))
def q_idf(spark, sf):
    vocab = train_vocabulary(spark, sf)
    return vocab.select("term", "idf")


@register("tfidf", with_ctes(["train_tfidf"], "SELECT speech_id, sent_idx, term, tf, round(weight, 6) AS weight FROM train_tfidf"))
def q_tfidf(spark, sf):
    """Train rows (copies share one row) as L2-normalised tf-idf."""
    return train_tfidf(spark, sf, train_vocabulary(spark, sf))


@register("tfidf_transform", with_ctes(["test_tfidf"], "SELECT speech_id, sent_idx, term, tf, round(weight, 6) AS weight FROM test_tfidf"))
def q_tfidf_transform(spark, sf):
    """Test rows with the train vocabulary and idf."""
    vocab = train_vocabulary(spark, sf)
    return test_tfidf(spark, sf, vocab)


@register("tfidf_vectors", with_ctes(["test_rows", "test_tfidf"], """
SELECT r.speech_id, r.sent_idx, COALESCE(n.nnz, 0)::BIGINT AS nnz, round(COALESCE(n.norm, 0.0), 6) AS norm,
       round(COALESCE(n.total, 0.0), 6) AS total
FROM test_rows r LEFT JOIN (
  SELECT speech_id, sent_idx, COUNT(*) AS nnz, sqrt(SUM(weight * weight)) AS norm, SUM(weight) AS total
  FROM test_tfidf GROUP BY speech_id, sent_idx) n
ON r.speech_id = n.speech_id AND r.sent_idx = n.sent_idx"""))
def q_tfidf_vectors(spark, sf):
    """Vector form (spark.ml) of the test tf-idf: non-zeros, norm and sum per row."""
    vocab = train_vocabulary(spark, sf)
    terms, idf = LN.collect_vocabulary(vocab)
    t = FE.with_grams(_test(spark, sf))
    v = LN.tfidf_vectors(t, terms, idf)
    # the stored values alone: as a dense array a row would be as long as the vocabulary
    v = v.select(*KEY, F.unwrap_udt("features")["values"].alias("_v"))
    arr = F.col("_v")
    return v.select(*KEY,
                    F.size(F.filter(arr, lambda x: x != 0)).alias("nnz"),
                    F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x * x)).alias("norm"),
                    F.aggregate(arr, F.lit(0.0), lambda a, x: a + x).alias("total"))


SVM_GAP = 0.02   # largest duality gap of a fit, as a share of its objective


def fit_baseline(spark, sf, max_iter: int = 50, report: list | None = None):
    """Train three linear SVMs on the upsampled train split; score test."""
    vocab = train_vocabulary(spark, sf)
    terms, idf = LN.collect_vocabulary(vocab)
    train = FE.with_grams(spread(_train_w(spark, sf), *KEY)).withColumn("gold_vec", L.multi_hot(L.label_ids(F.col("class_code"))))
    # the fit reads the vectors once an iteration: written once, in their sparse form
    vecs = materialize(LN.tfidf_vectors(train, terms, idf).select("features", "gold_vec", "copies"), "svm-vectors")
    coef, bias = LN.train_linear_svm(vecs, terms, weight_col="copies", max_iter=max_iter, gap=SVM_GAP, report=report)
    return vocab, coef, bias


@register("train_linear_svm", with_ctes(["train_w"], """
SELECT label::BIGINT AS label, COUNT(*)::BIGINT AS n_rows, SUM(copies)::BIGINT AS n_copies,
       SUM(CASE WHEN (label = 0 AND class_code = 0) OR (label = 1 AND class_code IN (1, 3)) OR (label = 2 AND class_code IN (2, 3)) THEN copies ELSE 0 END)::BIGINT AS n_positive,
       1::BIGINT AS below_zero_model, 1::BIGINT AS gap_ok
FROM (SELECT *, unnest([0, 1, 2]) AS label FROM train_w) GROUP BY label"""))
def q_train_linear_svm(spark, sf):
    """Facts of each label's fit over the training rows: sizes, whether its objective lies below that of
    the zero model, and whether it is within the stated gap of the dual bound, so of the optimum."""
    report: list = []
    vocab, coef, bias = fit_baseline(spark, sf, report=report)
    train = _train_w(spark, sf)
    m = LN.score_linear(train_tfidf(spark, sf, vocab), train.select(*KEY), coef, bias)
    gold = train.select(*KEY, F.col("copies").cast("long").alias("copies"), F.posexplode(L.multi_hot(L.label_ids(F.col("class_code")))).alias("label", "y"))
    j = m.join(gold, [*KEY, "label"])
    sign = F.when(F.col("y") == 1, 1.0).otherwise(-1.0)
    # the constant is a weight like the others in the fit
    norm = coef.select("label", "weight").unionByName(bias.select("label", F.col("bias").alias("weight"))).groupBy("label").agg(F.sum(F.col("weight") * F.col("weight")).alias("w2"))
    dual = F.element_at(F.array(*[F.lit(d) for _, d in report]), F.col("label") + 1)
    objective = F.col("w2") / 2 + F.col("hinge")
    g = j.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("copies").alias("n_copies"), F.sum(F.col("y") * F.col("copies")).alias("n_positive"),
        F.sum(F.greatest(1 - sign * F.col("margin"), F.lit(0.0)) * F.col("copies")).alias("hinge"))
    g = g.join(F.broadcast(norm), "label")          # one row per label
    # objective 1/2 |w|^2 + C sum of losses with C = 1; the zero model loses 1 a copy
    return g.select("label", "n_rows", "n_copies", "n_positive",
                    (objective < F.col("n_copies")).cast("int").alias("below_zero_model"),
                    ((objective - dual <= SVM_GAP * objective + 1e-6) & (objective >= dual - 1e-6)).cast("int").alias("gap_ok"))


@register("linear_baseline_report")
def q_linear_baseline_report(spark, sf):
    """Report of the fitted linear baseline on the test split."""
    from stancekit.operators import metrics as M
    vocab, coef, bias = fit_baseline(spark, sf)
    t = _test(spark, sf)
    p = LN.predictions(LN.score_linear(test_tfidf(spark, sf, vocab), t.select(*KEY), coef, bias))
    g = t.select(*KEY, L.multi_hot(L.label_ids(F.col("class_code"))).alias("gold_vec"))
    return M.classification_report(g.join(p, KEY))


@register("score_linear", with_ctes(["test_margins"], """
SELECT speech_id, sent_idx, label::BIGINT AS label, round(margin, 6) AS margin, CAST(margin > 0 AS INT)::BIGINT AS pred
FROM test_margins"""))
def q_score_linear(spark, sf):
    """Fixed weights (hash) over the train vocabulary: margin per test row and label."""
    vocab = train_vocabulary(spark, sf)
    coef, bias = fx.coef(spark, vocab)
    t = _test(spark, sf)
    return LN.score_linear(test_tfidf(spark, sf, vocab), t.select(*KEY), coef, bias)


@register("top_terms", with_ctes(["coef"], """
SELECT label::BIGINT AS label, direction, rank::BIGINT AS rank, term, round(weight, 6) AS weight FROM (
  SELECT label, 'positive' AS direction, row_number() OVER (PARTITION BY label ORDER BY weight DESC, term) AS rank, term, weight FROM coef
  UNION ALL
  SELECT label, 'negative' AS direction, row_number() OVER (PARTITION BY label ORDER BY weight ASC, term) AS rank, term, weight FROM coef
) WHERE rank <= 10"""))
def q_top_terms(spark, sf):
    coef, _ = fx.coef(spark, train_vocabulary(spark, sf))
    return LN.top_terms(coef, 10)
