"""Catalog: attribution of predictions to terms, tokens and words."""
from __future__ import annotations

from pyspark.sql import functions as F

from stancekit.functions import labels as L
from stancekit.operators import attribution as A
from stancekit.operators import features as FE
from stancekit.operators import linear as LN
from stancekit.plans import q_features  # noqa: F401  (registers feature CTEs)
from stancekit.plans.catalog import register
from stancekit.plans.q_features import _test, train_vocabulary
from stancekit.plans.sqlfrag import KEY_SQL, U, cte, lit, with_ctes
from stancekit.session import materialize
from stancekit.sources import fixtures as fx

KEY = ["speech_id", "sent_idx"]


def linear_explained(spark, sf):
    """(test rows with class code and tf-idf, weights, margins, explained classes) under the fixed weights."""
    vocab = train_vocabulary(spark, sf)
    coef, bias = fx.coef(spark, vocab)
    # read by the margins, the relevance and whatever asks for gold codes: the documents are cut once
    tt = materialize(FE.tfidf_rows(_test(spark, sf), vocab, [*KEY, "class_code"]).select(*KEY, "class_code", "terms", "weight"), "test-tfidf")
    # read by the explained classes and by whatever asks for their margins: computed once
    m = materialize(LN.score_linear(tt, tt.select(*KEY), coef, bias), "margins")
    explained = m.where(F.col("pred") == 1).select(*KEY, F.col("label").alias("class_id"), F.col("margin").alias("logit"))
    return tt, coef, m, explained


cte("explained", ["test_margins"], "SELECT speech_id, sent_idx, label AS class_id FROM test_margins WHERE margin > 0")
cte("rel_linear", ["test_tfidf", "explained", "coef"], """
SELECT t.speech_id, t.sent_idx, e.class_id, t.term, t.weight * c.weight AS relevance
FROM test_tfidf t JOIN explained e ON t.speech_id = e.speech_id AND t.sent_idx = e.sent_idx
JOIN coef c ON c.term = t.term AND c.label = e.class_id""")
cte("conserv", ["explained", "test_margins", "rel_linear"], """
SELECT e.speech_id, e.sent_idx, e.class_id, m.margin AS logit, COALESCE(s.sr, 0.0) AS sum_relevance, m.margin - COALESCE(s.sr, 0.0) AS gap
FROM explained e JOIN test_margins m ON m.speech_id = e.speech_id AND m.sent_idx = e.sent_idx AND m.label = e.class_id
LEFT JOIN (SELECT speech_id, sent_idx, class_id, SUM(relevance) AS sr FROM rel_linear GROUP BY ALL) s
ON s.speech_id = e.speech_id AND s.sent_idx = e.sent_idx AND s.class_id = e.class_id""")


@register("relevance_linear", with_ctes(["rel_linear"], """
SELECT speech_id, sent_idx, class_id::BIGINT AS class_id, term, round(relevance, 6) AS relevance FROM rel_linear"""))
def q_relevance_linear(spark, sf):
    """weight x tf-idf per (test row, predicted class, term)."""
    tt, coef, _, ex = linear_explained(spark, sf)
    return A.relevance_linear(tt, coef, ex)


@register("conservation", with_ctes(["conserv"], """
SELECT speech_id, sent_idx, class_id::BIGINT AS class_id, round(logit, 6) AS logit, round(sum_relevance, 6) AS sum_relevance,
       round(gap, 6) AS gap FROM conserv"""))
def q_conservation(spark, sf):
    """Summed relevance against the logit; the gap is the bias."""
    tt, coef, m, ex = linear_explained(spark, sf)
    c = A.conservation(A.relevance_linear(tt, coef, ex), ex)
    return c.select(*KEY, "class_id", "logit", "sum_relevance", "gap")


@register("conservation_summary", with_ctes(["conserv"], f"""
SELECT COUNT(*)::BIGINT AS n, round(max(abs(gap - {fx.COEF_BIAS})), 6) AS max_gap_error, round(corr(sum_relevance, logit), 6) AS corr FROM conserv"""))
def q_conservation_summary(spark, sf):
    tt, coef, m, ex = linear_explained(spark, sf)
    return A.conservation_summary(A.conservation(A.relevance_linear(tt, coef, ex), ex), fx.COEF_BIAS)


_TKEY = f"({KEY_SQL} || '-' || CAST(pos AS VARCHAR))"
_G = "[" + ", ".join(f"{U(str(401 + j), _TKEY)} - 0.5" for j in range(4)) + "]"
_X = "[" + ", ".join(f"{U(str(411 + j), _TKEY)} - 0.5" for j in range(4)) + "]"


@register("relevance_grad_input", with_ctes(["bpe_tokens"], f"""
SELECT speech_id, sent_idx, pos, token, round(list_sum(list_transform(list_zip(g, x), lambda p: p[1] * p[2])), 6) AS relevance
FROM (SELECT *, {_G} AS g, {_X} AS x FROM bpe_tokens)"""))
def q_relevance_grad_input(spark, sf):
    """Gradient x input summed over dimensions, per token."""
    t = fx.grad_tokens(spark, sf)
    return t.select(*KEY, "pos", "token", A.relevance_grad_input("grad", "input").alias("relevance"))


@register("relevance_grad_l1", with_ctes(["bpe_tokens"], f"""
SELECT speech_id, sent_idx, pos, token, round(list_sum(list_transform(g, lambda v: abs(v))), 6) AS relevance
FROM (SELECT *, {_G} AS g FROM bpe_tokens)"""))
def q_relevance_grad_l1(spark, sf):
    t = fx.grad_tokens(spark, sf)
    return t.select(*KEY, "pos", "token", A.relevance_grad_l1("grad").alias("relevance"))


@register("select_logit", with_ctes(["logits"], """
SELECT speech_id, sent_idx, (i - 1)::BIGINT AS class_id, round(logits[i], 6) AS logit
FROM (SELECT *, unnest(generate_series(1, 3)) AS i FROM logits) WHERE logits[i] > 0"""))
def q_select_logit(spark, sf):
    """The explained class's logit for every explained (row, class)."""
    lg = fx.logits(spark, sf)
    ex = lg.select(*KEY, "logits", F.explode(L.explained_classes(L.threshold_logits(F.col("logits")))).alias("class_id"))
    return ex.select(*KEY, "class_id", A.select_logit("logits", "class_id").alias("logit"))


@register("margin_to_runner_up", with_ctes(["logits"], """
SELECT speech_id, sent_idx, (list_position(logits, list_max(logits)) - 1)::BIGINT AS argmax,
       round(list_sort(logits, 'DESC')[1] - list_sort(logits, 'DESC')[2], 6) AS margin FROM logits"""))
def q_margin_to_runner_up(spark, sf):
    lg = fx.logits(spark, sf)
    return lg.select(*KEY, A.argmax("logits").alias("argmax"), A.margin_to_runner_up("logits").alias("margin"))


cte("merged_max", ["bpe_tokens"], """
SELECT speech_id, sent_idx, word_idx,
       CASE WHEN min(pos) = 0 OR min(pos) = max(last) THEN string_agg(token, '' ORDER BY pos)
            ELSE replace(string_agg(token, '' ORDER BY pos), 'Ġ', '') END AS word,
       max(score) AS score
FROM (SELECT *, SUM(CAST(pos <= 1 OR pos = last OR starts_with(token, 'Ġ') AS INT))
                  OVER (PARTITION BY speech_id, sent_idx ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS word_idx
      FROM (SELECT *, max(pos) OVER (PARTITION BY speech_id, sent_idx) AS last FROM bpe_tokens))
GROUP BY speech_id, sent_idx, word_idx""")


@register("merge_words_max", with_ctes(["merged_max"], """
SELECT speech_id, sent_idx, word_idx::BIGINT AS word_idx, word, round(score, 6) AS score FROM merged_max"""))
def q_merge_words_max(spark, sf):
    """'Ġ'-marked pieces of the test sentences back to words, max score."""
    return A.merged_rows(fx.bpe_arrays(spark, sf), A.words_max("toks", "scores"))


@register("merge_words_sum", with_ctes(["wordpiece_tokens"], """
SELECT speech_id, sent_idx, word_idx::BIGINT AS word_idx, string_agg(piece, '' ORDER BY pos) AS word, round(SUM(score), 6) AS score
FROM (SELECT *, SUM(CAST(pos = 0 OR NOT (starts_with(token, '##') OR starts_with(token, '_')) AS INT))
                  OVER (PARTITION BY speech_id, sent_idx ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS word_idx,
             CASE WHEN starts_with(token, '##') THEN substring(token, 3) WHEN starts_with(token, '_') THEN substring(token, 2) ELSE token END AS piece
      FROM wordpiece_tokens)
GROUP BY speech_id, sent_idx, word_idx"""))
def q_merge_words_sum(spark, sf):
    """'##' continuation pieces back to words, summed score."""
    return A.merged_rows(fx.wordpiece_arrays(spark, sf), A.words_sum("toks", "scores"))


def _fold_sql(span: str) -> str:
    """DuckDB oracle for a left-to-right fold: a recursive walk of cursors.

    ``span`` sees the cursor row ``c`` (token at i), ``n1``/``n2`` (tokens at
    i+1, i+2), the cursor ``w.i`` and the token count ``c.n``.
    """
    look = ("JOIN t c ON c.speech_id = w.speech_id AND c.sent_idx = w.sent_idx AND c.pos = w.i "
            "LEFT JOIN t n1 ON n1.speech_id = w.speech_id AND n1.sent_idx = w.sent_idx AND n1.pos = w.i + 1 "
            "LEFT JOIN t n2 ON n2.speech_id = w.speech_id AND n2.sent_idx = w.sent_idx AND n2.pos = w.i + 2")
    base = with_ctes(["symbol_tokens"], "SELECT 1")
    base = "WITH RECURSIVE " + base[len("WITH "):base.rfind("\nSELECT 1")]
    return base + f""",
t AS (
  SELECT speech_id, sent_idx, pos, token, score, COUNT(*) OVER (PARTITION BY speech_id, sent_idx) AS n FROM symbol_tokens),
walk(speech_id, sent_idx, i, word_idx) AS (
  SELECT DISTINCT speech_id, sent_idx, 0::BIGINT, 0::BIGINT FROM t
  UNION ALL
  SELECT w.speech_id, w.sent_idx, w.i + ({span}), w.word_idx + 1 FROM walk w {look}
),
spans AS (SELECT w.speech_id, w.sent_idx, w.i, w.word_idx, ({span}) AS span FROM walk w {look})
SELECT s.speech_id, s.sent_idx, s.word_idx::BIGINT AS word_idx, string_agg(t.token, '' ORDER BY t.pos) AS token,
       round(SUM(t.score), 6) AS score
FROM spans s JOIN t ON t.speech_id = s.speech_id AND t.sent_idx = s.sent_idx AND t.pos >= s.i AND t.pos < s.i + s.span
GROUP BY s.speech_id, s.sent_idx, s.word_idx"""


_HYPHEN_SPAN = "CASE WHEN n1.token = '-' AND w.i + 2 < c.n THEN 3 ELSE 1 END"
_OPENS = ", ".join(lit(x) for x in A.OPEN_SYMBOLS)
_CLOSES = ", ".join(lit(x) for x in A.CLOSE_SYMBOLS)
_A = f"(w.i <= c.n - 2 AND c.token IN ({_OPENS}))"
_SYMBOL_SPAN = (f"1 + CAST({_A} AS INT) + CAST(w.i <= c.n - 2 AND w.i + CAST({_A} AS INT) < c.n - 1 AND "
                f"COALESCE(CASE WHEN {_A} THEN n2.token ELSE n1.token END IN ({_CLOSES}), false) AS INT)")


def _fold_rows(spark, sf, fn):
    return A.merged_rows(fx.symbol_arrays(spark, sf), fn("toks", "scores"), word="token")


@register("merge_hyphens", _fold_sql(_HYPHEN_SPAN))
def q_merge_hyphens(spark, sf):
    """'x - y' token triples of the test sentences merged (left-to-right fold)."""
    return _fold_rows(spark, sf, A.merge_hyphens)


@register("merge_symbols", _fold_sql(_SYMBOL_SPAN))
def q_merge_symbols(spark, sf):
    """Brackets, currency, quotes and percent glued to their neighbours."""
    return _fold_rows(spark, sf, A.merge_symbols)


def _sql_split(family: str) -> str:
    two = ", ".join(lit(x) for x in A.SPLIT_TWO_CHARS[family])
    last = ", ".join(lit(x) for x in A.SPLIT_LAST_CHAR[family])
    return f"""CASE WHEN token IN ({two}) THEN [substring(token, 1, 1), substring(token, 2)]
        WHEN token IN ({last}) THEN [substring(token, 1, length(token) - 1), substring(token, length(token), 1)]
        WHEN token = 'cannot' THEN ['can', 'not'] ELSE [token] END"""


@register("split_contractions", with_ctes(["bpe_tokens"], f"""
SELECT speech_id, sent_idx, pos, (sub - 1)::BIGINT AS sub, parts[sub] AS token, round(CASE WHEN sub = 1 THEN score ELSE 0.0 END, 6) AS score
FROM (SELECT *, generate_subscripts(parts, 1) AS sub FROM (SELECT *, {_sql_split('gpt2')} AS parts FROM bpe_tokens))"""))
def q_split_contractions(spark, sf):
    """gpt2-family rules over the test pieces; later parts score 0."""
    return A.split_contraction_rows(fx.bpe_tokens(spark, sf), "gpt2")


@register("normalize_relevance", with_ctes(["merged_max"], """
SELECT speech_id, sent_idx, word_idx::BIGINT AS word_idx,
       round(COALESCE(score / NULLIF(max(abs(score)) OVER (PARTITION BY speech_id, sent_idx), 0), 0.0), 6) AS norm_score
FROM merged_max"""))
def q_normalize_relevance(spark, sf):
    """Merged word scores divided by the sentence's largest absolute score."""
    m = A.merged_rows(fx.bpe_arrays(spark, sf), A.words_max("toks", "scores"))
    return A.normalize_relevance(m, KEY).select(*KEY, "word_idx", "norm_score")


@register("word_relevance_summary", with_ctes(["rel_linear"], """
SELECT class_id::BIGINT AS class_id, term, round(total, 6) AS total, round(mean, 6) AS mean, n::BIGINT AS n, rank::BIGINT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY total DESC, term) AS rank
  FROM (SELECT class_id, term, SUM(relevance) AS total, AVG(relevance) AS mean, COUNT(*) AS n FROM rel_linear GROUP BY class_id, term))
WHERE rank <= 20"""))
def q_word_relevance_summary(spark, sf):
    """Per class the 20 terms with the largest total relevance."""
    tt, coef, _, ex = linear_explained(spark, sf)
    return A.word_relevance_summary(A.relevance_linear(tt, coef, ex), "term", "class_id", "relevance", 20)


def _pieces_words(spark, sf):
    """Pieces without the two wrapping tokens and without marks, and the words, as arrays."""
    x = fx.bpe_arrays(spark, sf, "sentence")
    inner = lambda c: F.slice(c, 2, F.size(c) - 2)
    return x.select(*KEY, F.transform(inner("toks"), lambda t: F.replace(t, F.lit("Ġ"), F.lit(""))).alias("toks"),
                    inner("scores").alias("scores"), F.split("sentence", " ", -1).alias("words"))


cte("pw_pieces", ["bpe_tokens"], """
SELECT speech_id, sent_idx, pos, replace(token, 'Ġ', '') AS piece, score
FROM (SELECT *, max(pos) OVER (PARTITION BY speech_id, sent_idx) AS last FROM bpe_tokens) WHERE pos > 0 AND pos < last""")
cte("pw_words", ["test_rows"], """
SELECT speech_id, sent_idx, unnest(string_split(sentence, ' ')) AS word, generate_subscripts(string_split(sentence, ' '), 1) - 1 AS word_idx
FROM test_rows""")
cte("aligned_words", ["pw_pieces", "pw_words"], """
WITH p AS (
  SELECT *, SUM(length(n)) OVER (PARTITION BY speech_id, sent_idx ORDER BY pos ROWS UNBOUNDED PRECEDING) - length(n) AS s
  FROM (SELECT *, regexp_replace(piece, '[^a-zA-Z0-9.]', '', 'g') AS n FROM pw_pieces)),
w AS (
  SELECT *, SUM(length(n)) OVER (PARTITION BY speech_id, sent_idx ORDER BY word_idx ROWS UNBOUNDED PRECEDING) - length(n) AS s
  FROM (SELECT *, regexp_replace(word, '[^a-zA-Z0-9.]', '', 'g') AS n FROM pw_words)),
pe AS (SELECT *, row_number() OVER (PARTITION BY speech_id, sent_idx, s ORDER BY pos) AS k FROM p WHERE length(n) = 0),
we AS (SELECT *, row_number() OVER (PARTITION BY speech_id, sent_idx, s ORDER BY word_idx) AS k FROM w WHERE length(n) = 0),
matched AS (SELECT pe.speech_id, pe.sent_idx, pe.pos, we.word_idx FROM pe JOIN we
            ON pe.speech_id = we.speech_id AND pe.sent_idx = we.sent_idx AND pe.s = we.s AND pe.k = we.k),
ev AS (
  SELECT speech_id, sent_idx, CASE WHEN length(n) > 0 THEN s ELSE greatest(s - 1, 0) END AS o, 1 AS kind, pos, NULL::BIGINT AS wi
  FROM p WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.speech_id = p.speech_id AND m.sent_idx = p.sent_idx AND m.pos = p.pos)
  UNION ALL
  SELECT speech_id, sent_idx, s AS o, 0 AS kind, NULL AS pos, word_idx AS wi FROM w WHERE length(n) > 0),
placed AS (
  SELECT speech_id, sent_idx, pos, last_value(wi IGNORE NULLS) OVER (PARTITION BY speech_id, sent_idx ORDER BY o, kind, pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS word_idx, kind FROM ev),
lost AS (
  SELECT pl.speech_id, pl.sent_idx, pl.pos, COALESCE(max(we.word_idx), min(w.word_idx)) AS word_idx
  FROM placed pl JOIN p ON p.speech_id = pl.speech_id AND p.sent_idx = pl.sent_idx AND p.pos = pl.pos
  JOIN w ON w.speech_id = pl.speech_id AND w.sent_idx = pl.sent_idx
  LEFT JOIN we ON we.speech_id = pl.speech_id AND we.sent_idx = pl.sent_idx AND we.s = p.s
  WHERE pl.kind = 1 AND pl.word_idx IS NULL GROUP BY pl.speech_id, pl.sent_idx, pl.pos),
assign AS (SELECT speech_id, sent_idx, pos, word_idx, 0 AS is_lost FROM placed WHERE kind = 1 AND word_idx IS NOT NULL
           UNION ALL SELECT speech_id, sent_idx, pos, word_idx, 0 FROM matched
           UNION ALL SELECT speech_id, sent_idx, pos, word_idx, 1 FROM lost)
SELECT a.speech_id, a.sent_idx, a.word_idx, string_agg(pp.piece, '' ORDER BY pp.pos) AS text, max(pp.score) AS score, sum(pp.score) AS total, max(a.is_lost) AS is_lost
FROM assign a JOIN pw_pieces pp ON pp.speech_id = a.speech_id AND pp.sent_idx = a.sent_idx AND pp.pos = a.pos
GROUP BY a.speech_id, a.sent_idx, a.word_idx""")


def _aligned_sql(score: str) -> str:
    return with_ctes(["aligned_words", "pw_words"], f"""
SELECT a.speech_id, a.sent_idx, a.word_idx::BIGINT AS word_idx, w.word, a.text, round(a.{score}, 6) AS score,
       CAST(a.is_lost = 0 AND regexp_replace(a.text, '[^a-zA-Z0-9.]', '', 'g') = regexp_replace(w.word, '[^a-zA-Z0-9.]', '', 'g') AS INT)::BIGINT AS aligned
FROM aligned_words a JOIN pw_words w ON w.speech_id = a.speech_id AND w.sent_idx = a.sent_idx AND w.word_idx = a.word_idx""")


@register("align_to_words", _aligned_sql("score"))
def q_align_to_words(spark, sf):
    """BPE pieces of the test sentences mapped back onto their space-split words (max)."""
    return A.aligned_rows(_pieces_words(spark, sf), "max")


@register("align_to_words_sum", _aligned_sql("total"))
def q_align_to_words_sum(spark, sf):
    """The same with summed scores."""
    return A.aligned_rows(_pieces_words(spark, sf), "sum")
