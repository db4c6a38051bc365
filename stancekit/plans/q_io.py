"""Catalog: sources and sinks (round trips through the checkpoint folder),
model scoring, file alignment."""
from __future__ import annotations

from pyspark.sql import functions as F

from stancekit.functions import labels as L
from stancekit.functions.answers import parse_answer
from stancekit.functions.hashing import sentence_key, unit_hash
from stancekit.functions.text import tsv_text
from stancekit.operators import align as AL
from stancekit.operators import annotate as AN
from stancekit.operators import metrics as M
from stancekit.operators import prompts as P
from stancekit.operators import windows as W
from stancekit.plans import q_attribution, q_prompts  # noqa: F401  (register CTEs)
from stancekit.plans.catalog import register
from stancekit.plans.q_core import _SCORE_LINE, _report_sql, baseline_scored
from stancekit.plans.sqlfrag import KEY_SQL, U, cte, label_ids, lit, multi_hot, with_ctes
from stancekit.plans import sqlfrag as sqlf
from stancekit.session import scratch_path
from stancekit.sources import fixtures as fx
from stancekit.sources import io as IO

KEY = ["speech_id", "sent_idx"]
PRED_RUN = "StubLM-1B_k_0_seed_13"


def _test(spark, sf):
    return fx.sentences(spark, sf).where(F.col("split") == "test").drop("split")


# ------------------------------------------------------------- corpus and JSONL
@register("write_corpus_load_split", with_ctes(["train_rows"], "SELECT speech_id, sent_idx, class_code FROM train_rows"))
def q_write_corpus_load_split(spark, sf):
    """Corpus written partitioned by split, the train split read back (pruned)."""
    path = scratch_path(spark, "corpus")
    IO.write_corpus(fx.sentences(spark, sf), path)
    return IO.load_split(spark, path, "train").select(*KEY, "class_code")


@register("read_responses", with_ctes(["responses"], """
SELECT run_tag, speech_id, sent_idx, class_code, model_response FROM responses"""))
def q_read_responses(spark, sf):
    """Answers written as JSON lines per run, read back with a fixed schema."""
    path = scratch_path(spark, "responses")
    IO.write_responses(fx.responses(spark, sf), path)
    r = IO.read_responses(spark, path)
    return r.select("run_tag", F.col("speech_id").cast("long"), "sent_idx", "class_code", "model_response")


@register("write_responses", with_ctes(["responses"], """
SELECT run_tag, COUNT(*)::BIGINT AS n_rows, COUNT(model_response)::BIGINT AS n_answers FROM responses GROUP BY run_tag"""))
def q_write_responses(spark, sf):
    """Rows and non-null answers per run folder after the write."""
    path = scratch_path(spark, "responses")
    IO.write_responses(fx.responses(spark, sf), path)
    r = IO.read_responses(spark, path)
    return r.groupBy("run_tag").agg(F.count(F.lit(1)).alias("n_rows"), F.count("model_response").alias("n_answers"))


# ------------------------------------------------------------- position TSV files
def _letter_code():
    return F.array_position(F.array(*[F.lit(x) for x in L.LETTERS]), parse_answer(F.col("model_response"))) - 1


def gold_rows(spark, sf):
    """Test rows with a global line index in key order (raw text)."""
    t = _test(spark, sf)
    return W.global_index(t, KEY, out="idx").select("idx", F.col("sentence").alias("text"), *KEY, "class_code")


def prediction_file(spark, sf):
    """One run's answers as a position TSV (round trip) -> (idx, run_tag, source, text, code)."""
    r = fx.responses(spark, sf).where(F.col("run_tag") == PRED_RUN)
    r = W.global_index(r, KEY, out="idx")
    code = F.when(_letter_code() >= 0, _letter_code()).otherwise(F.lit(4))
    path = scratch_path(spark, "pred_tsv")
    IO.write_position_tsv(r.select("idx", "run_tag", F.lit("stub").alias("source"), F.col("sentence").alias("text"),
                                   code.alias("code")), path)
    return IO.read_position_tsv(spark, path)


def relabel_file(spark, sf):
    """Second gold set: 10% of codes moved by hash, written and read back."""
    g = gold_rows(spark, sf)
    code = F.when(unit_hash(17, sentence_key()) < 0.1, (F.col("class_code") + 1) % 4).otherwise(F.col("class_code"))
    path = scratch_path(spark, "relabel_tsv")
    IO.write_position_tsv(g.select("idx", F.lit("relabel").alias("run_tag"), F.lit("annotator").alias("source"),
                                   "text", code.alias("code")), path)
    return IO.read_relabel_tsv(spark, path)


_PL = sqlf.parse_letter("model_response")
_PK = sqlf.parse_keyword("model_response")
cte("gold_idx", ["test_rows"], """
SELECT (row_number() OVER (ORDER BY speech_id, sent_idx) - 1) AS idx, sentence AS text, speech_id, sent_idx, class_code FROM test_rows""")
cte("pred_file", ["responses"], f"""
SELECT (row_number() OVER (ORDER BY speech_id, sent_idx) - 1) AS idx, regexp_replace(sentence, '[\\t\\r\\n]', ' ', 'g') AS text,
       COALESCE(list_position(['a', 'b', 'c', 'd'], COALESCE({_PL}, {_PK})) - 1, 4) AS code
FROM responses WHERE run_tag = {lit(PRED_RUN)}""")
cte("relabel", ["gold_idx"], f"""
SELECT idx, regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') AS text,
       CASE WHEN {U('17', KEY_SQL)} < 0.1 THEN (class_code + 1) % 4 ELSE class_code END AS code
FROM gold_idx""")


@register("read_position_tsv", with_ctes(["pred_file"], "SELECT idx::BIGINT AS idx, text, code::BIGINT AS code FROM pred_file"))
def q_read_position_tsv(spark, sf):
    """Position TSV round trip: text from column 3, code from column 4."""
    return prediction_file(spark, sf).select("idx", "text", "code")


@register("read_relabel_tsv", with_ctes(["relabel"], f"""
SELECT idx::BIGINT AS idx, text, array_to_string({multi_hot(label_ids('code'))}, ',') AS gold_vec FROM relabel"""))
def q_read_relabel_tsv(spark, sf):
    r = relabel_file(spark, sf)
    return r.select("idx", "text", F.array_join(F.transform("gold_vec", lambda x: x.cast("string")), ",").alias("gold_vec"))


@register("align_predictions", with_ctes(["pred_file", "gold_idx"], f"""
SELECT p.idx::BIGINT AS idx, p.code::BIGINT AS pred_code, g.class_code::BIGINT AS gold_code
FROM pred_file p JOIN gold_idx g ON p.idx = g.idx AND p.text = g.text"""))
def q_align_predictions(spark, sf):
    """Prediction line i with gold row i where the texts are equal."""
    a = AL.align_predictions(prediction_file(spark, sf), gold_rows(spark, sf))
    return a.select("idx", F.col("code").alias("pred_code"), F.col("class_code").alias("gold_code"))


@register("align_mismatch", with_ctes(["pred_file", "gold_idx"], """
SELECT p.idx::BIGINT AS idx, p.text FROM pred_file p ANTI JOIN gold_idx g ON p.idx = g.idx AND p.text = g.text"""))
def q_align_mismatch(spark, sf):
    """Lines dropped because the file text differs (line breaks flattened)."""
    return AL.align_mismatch(prediction_file(spark, sf), gold_rows(spark, sf)).select("idx", "text")


_RELABEL_SRC = (f"(SELECT p.idx, {multi_hot(label_ids('p.code', True))} AS pred_vec, {multi_hot(label_ids('r.code'))} AS gold_vec "
                f"FROM pred_file p JOIN relabel r ON p.idx = r.idx) z")


@register("relabel_report", _report_sql(_RELABEL_SRC, ("pred_file", "relabel")))
def q_relabel_report(spark, sf):
    """Predictions scored against the second gold set (joined on the line index)."""
    p = prediction_file(spark, sf).select("idx", L.multi_hot(L.label_ids(F.col("code"), fold4=True)).alias("pred_vec"))
    g = relabel_file(spark, sf).select("idx", "gold_vec")
    return M.classification_report(p.join(g, "idx"))


# ------------------------------------------------------------- list TSV files
cte("list_preds", ["logits"], f"""
SELECT (row_number() OVER (ORDER BY speech_id, sent_idx) - 1) AS idx,
       list_filter(list_transform(list_transform(logits, lambda x: CAST(x > 0 AS INT)), lambda x, i: CASE WHEN x = 1 THEN i - 1 END), lambda x: x IS NOT NULL) AS pred_ids,
       {label_ids('class_code')} AS gold_ids
FROM logits""")


@register("read_list_predictions", with_ctes(["list_preds"], """
SELECT idx::BIGINT AS idx, array_to_string(pred_ids, ',') AS pred_ids, array_to_string(gold_ids, ',') AS gold_ids FROM list_preds"""))
def q_read_list_predictions(spark, sf):
    """Thresholded stub logits written as '[1, 2]' list TSV, parsed back."""
    lg = fx.logits(spark, sf)
    lg = W.global_index(lg, KEY, out="idx").select(
        "idx", L.hot_to_ids(L.threshold_logits(F.col("logits"))).alias("pred_ids"), L.label_ids(F.col("class_code")).alias("gold_ids"))
    path = scratch_path(spark, "list_tsv")
    IO.write_list_predictions(lg, path)
    r = IO.read_list_predictions(spark, path)
    j = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return r.select("idx", j("pred_ids").alias("pred_ids"), j("gold_ids").alias("gold_ids"))


@register("write_list_predictions", with_ctes(["list_preds"], """
SELECT idx::BIGINT AS idx, '[' || array_to_string(pred_ids, ', ') || ']' AS predictions FROM list_preds"""))
def q_write_list_predictions(spark, sf):
    """The literal text written in the predictions column."""
    lg = fx.logits(spark, sf)
    lg = W.global_index(lg, KEY, out="idx").select(
        "idx", L.hot_to_ids(L.threshold_logits(F.col("logits"))).alias("pred_ids"), L.label_ids(F.col("class_code")).alias("gold_ids"))
    path = scratch_path(spark, "list_tsv")
    IO.write_list_predictions(lg, path)
    return spark.read.schema(IO.LIST_SCHEMA).options(**IO.TSV).csv(path).select("idx", "predictions")


_PARAS = """
SELECT (row_number() OVER (ORDER BY speech_id, paragraph) - 1) AS idx, speech_id, paragraph, preds, golds FROM (
  SELECT speech_id, sent_idx // 5 AS paragraph, list(pred_ids ORDER BY sent_idx) AS preds, list(gold_ids ORDER BY sent_idx) AS golds
  FROM list_sent GROUP BY speech_id, sent_idx // 5)"""
cte("list_sent", ["logits"], f"""
SELECT speech_id, sent_idx,
       list_filter(list_transform(list_transform(logits, lambda x: CAST(x > 0 AS INT)), lambda x, i: CASE WHEN x = 1 THEN i - 1 END), lambda x: x IS NOT NULL) AS pred_ids,
       {label_ids('class_code')} AS gold_ids
FROM logits""")
cte("list_paras", ["list_sent"], _PARAS)
_NEST = "'[' || array_to_string(list_transform({c}, lambda x: '[' || array_to_string(x, ', ') || ']'), ', ') || ']'"


def _paragraph_lists(spark, sf):
    """(idx, pred_ids, gold_ids): nested id lists per paragraph of 5 sentences."""
    lg = fx.logits(spark, sf).withColumn("pg", F.struct(
        L.hot_to_ids(L.threshold_logits(F.col("logits"))).alias("p"), L.label_ids(F.col("class_code")).alias("g")))
    p = W.global_index(fx.paragraphs(lg, "pg"), ["speech_id", "paragraph"], out="idx")
    return p.select("idx", F.transform("values", lambda x: x["p"]).alias("pred_ids"), F.transform("values", lambda x: x["g"]).alias("gold_ids"))


@register("write_list_predictions_nested", with_ctes(["list_paras"], f"""
SELECT idx::BIGINT AS idx, {_NEST.format(c='preds')} AS predictions, {_NEST.format(c='golds')} AS labels FROM list_paras"""))
def q_write_list_predictions_nested(spark, sf):
    """One list of id lists per paragraph; written, parsed and rendered again."""
    path = scratch_path(spark, "nested_tsv")
    IO.write_list_predictions(_paragraph_lists(spark, sf), path)
    r = IO.read_list_predictions(spark, path, nested=True)
    return r.select("idx", IO.list_literal("pred_ids", 2).alias("predictions"), IO.list_literal("gold_ids", 2).alias("labels"))


@register("write_list_predictions_binary", with_ctes(["list_paras"], """
SELECT idx::BIGINT AS idx, '[' || array_to_string(list_transform(preds, lambda x: CAST(len(list_filter(x, lambda i: i <> 0)) > 0 AS INT)), ', ') || ']' AS predictions,
       '[' || array_to_string(list_transform(golds, lambda x: CAST(len(list_filter(x, lambda i: i <> 0)) > 0 AS INT)), ', ') || ']' AS labels FROM list_paras"""))
def q_write_list_predictions_binary(spark, sf):
    """One 0/1 per sentence of a paragraph: any class but 0."""
    some = lambda c: F.transform(c, lambda x: F.exists(x, lambda i: i != 0).cast("int"))
    path = scratch_path(spark, "binary_tsv")
    IO.write_list_predictions(_paragraph_lists(spark, sf).select("idx", some("pred_ids").alias("pred_ids"), some("gold_ids").alias("gold_ids")), path)
    return spark.read.schema(IO.LIST_SCHEMA).options(**IO.TSV).csv(path)


@register("read_position_tsv_lines", with_ctes(["pred_file"], "SELECT idx::BIGINT AS idx, text, code::BIGINT AS code FROM pred_file"))
def q_read_position_tsv_lines(spark, sf):
    """The line counted by the reader: column 0 holds no number."""
    r = W.global_index(fx.responses(spark, sf).where(F.col("run_tag") == PRED_RUN), KEY, out="idx")
    code = F.when(_letter_code() >= 0, _letter_code()).otherwise(F.lit(4))
    path = scratch_path(spark, "line_tsv")
    rows = r.orderBy("idx").select(F.concat(F.lit("row-"), F.col("idx").cast("string")).alias("name"), "run_tag", F.lit("stub").alias("source"),
                                   tsv_text(F.col("sentence")).alias("text"), code.cast("int").alias("code"))
    rows.write.options(**IO.TSV_WRITE).csv(path)
    return IO.read_position_tsv(spark, path, index="line").select("idx", "text", "code")


@register("write_metrics", f"""
SELECT 'test' AS split, (SELECT COUNT(*) FROM ({with_ctes(['test_rows'], 'SELECT * FROM test_rows')}))::BIGINT AS n_samples, r.*
FROM (\n{_report_sql()}\n) r""")
def q_write_metrics(spark, sf):
    """Baseline report with its split and sample count, written as JSON and read back."""
    path = scratch_path(spark, "metrics")
    counts = M.sample_counts(fx.sentences(spark, sf))
    IO.write_metrics(M.classification_report(baseline_scored(spark, sf)), path, "test", counts)
    return IO.read_metrics(spark, path, splits=True)


@register("write_relevance", with_ctes(["rel_linear", "explained", "test_margins", "test_rows"], """
SELECT e.speech_id, e.sent_idx, e.class_id::BIGINT AS class_id, COALESCE(t.tokens, '') AS tokens, COALESCE(t.scores, '') AS scores,
       m.pred_vec, r.class_code::BIGINT AS gold, m.logits
FROM explained e
LEFT JOIN (SELECT speech_id, sent_idx, class_id, string_agg(term, '|' ORDER BY term) AS tokens,
                  string_agg(CAST(CAST(round(relevance * 10000) AS BIGINT) AS VARCHAR), '|' ORDER BY term) AS scores
           FROM rel_linear GROUP BY ALL) t ON t.speech_id = e.speech_id AND t.sent_idx = e.sent_idx AND t.class_id = e.class_id
JOIN (SELECT speech_id, sent_idx, string_agg(CAST(CAST(margin > 0 AS INT) AS VARCHAR), ',' ORDER BY label) AS pred_vec,
             string_agg(CAST(CAST(round(margin * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY label) AS logits
      FROM test_margins GROUP BY ALL) m ON m.speech_id = e.speech_id AND m.sent_idx = e.sent_idx
JOIN test_rows r ON r.speech_id = e.speech_id AND r.sent_idx = e.sent_idx"""))
def q_write_relevance(spark, sf):
    """Per (test row, explained class) tokens, scores, prediction, gold and logits, as Parquet
    partitioned by class, read back (scores and logits in ten-thousandths)."""
    from stancekit.operators import attribution as A
    from stancekit.operators import linear as LN

    tt, coef, m, ex = q_attribution.linear_explained(spark, sf)
    side = LN.predictions(m).join(tt.select(*KEY, F.col("class_code").alias("gold")), KEY)
    path = scratch_path(spark, "relevance")
    IO.write_relevance(IO.relevance_rows(A.relevance_linear(tt, coef, ex, by_row=True), ex.drop("logit").join(side, KEY)), path)
    r = spark.read.parquet(path)
    ten = lambda c: F.transform(c, lambda x: F.round(x * 10000).cast("long").cast("string"))
    return r.select(*KEY, F.col("class_id").cast("long"), F.array_join("tokens", "|").alias("tokens"), F.array_join(ten("scores"), "|").alias("scores"),
                    F.array_join(F.transform("pred_vec", lambda x: x.cast("string")), ",").alias("pred_vec"), "gold",
                    F.array_join(ten("logits"), ",").alias("logits"))


# ------------------------------------------------------------- scoring rows
FAIL_SHARE = 0.02
_ZS = q_prompts.s_zero("sentence")
_SHORT_NAMES = "[" + ", ".join(lit(x.split(") ", 1)[1].split(" ")[0]) for x in L.FULL_LABELS) + "]"
cte("annotated", ["test_rows"], f"""
SELECT speech_id, sent_idx, class_code, p,
       CASE WHEN fail < {FAIL_SHARE} THEN NULL
            ELSE {lit(AN.ANSWER_OPENING)} || ['a', 'b', 'c', 'd'][code + 1] || ') ' || {_SHORT_NAMES}[code + 1] END AS model_response,
       CASE WHEN fail < {FAIL_SHARE} THEN 'ValueError: generation failed' END AS error
FROM (SELECT *, CASE WHEN u < 0.92 THEN 0 WHEN u < 0.96 THEN 1 WHEN u < 0.98 THEN 2 ELSE 3 END AS code
      FROM (SELECT *, ('0x' || substr(md5(p), 1, 8))::BIGINT / 4294967296.0 AS u, ('0x' || substr(md5(p), 9, 8))::BIGINT / 4294967296.0 AS fail
            FROM (SELECT speech_id, sent_idx, class_code, {_ZS} AS p FROM test_rows)))""")


def annotated(spark, sf, raising: bool = False):
    p = P.prompt_zero_shot(_test(spark, sf)).drop("messages")
    return AN.annotate(p, lambda: AN.StubScorer(FAIL_SHARE, raising), "prompt", max_units=2)


@register("annotate", with_ctes(["annotated"], "SELECT speech_id, sent_idx, model_response, error FROM annotated"))
def q_annotate(spark, sf):
    """Zero-shot prompts of the test split scored by the stub model per partition."""
    return annotated(spark, sf).select(*KEY, "model_response", "error")


@register("quarantine_failed", with_ctes(["annotated"], "SELECT speech_id, sent_idx, error FROM annotated WHERE error IS NOT NULL"))
def q_quarantine_failed(spark, sf):
    """Rows whose scoring failed, kept aside with the error; the scorer raises for its whole batch."""
    _, bad = AN.split_failed(annotated(spark, sf, raising=True))
    return bad.select(*KEY, "error")


_AUDIT_SRC = (f"(SELECT {multi_hot(label_ids('class_code'))} AS gold_vec, "
              f"{sqlf.letter_vector(f'COALESCE({_PL}, {_PK})')} AS pred_vec FROM annotated) a")


@register("audit_report", _report_sql(_AUDIT_SRC, ("annotated",)))
def q_audit_report(spark, sf):
    """End to end: prompt -> score -> parse -> report (failed rows count as empty)."""
    a = annotated(spark, sf)
    s = a.select(L.multi_hot(L.label_ids(F.col("class_code"))).alias("gold_vec"),
                 L.letter_vector(parse_answer(F.col("model_response"))).alias("pred_vec"))
    return M.classification_report(s)


@register("stream_score_line", _SCORE_LINE)
def q_stream_score_line(spark, sf):
    """Answers written as files, scored by a streaming aggregation (availableNow)."""
    from stancekit.streaming.scores import stream_score_line
    path = scratch_path(spark, "answers")
    IO.write_responses(fx.responses(spark, sf), path)
    return stream_score_line(spark, path)
