"""Catalog: sources, filters, labels, sampling, answers, metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from stancekit.functions import labels as L
from stancekit.functions.answers import parse_answer, parse_keyword, parse_letter
from stancekit.functions.text import truncate_words, word_count
from stancekit.operators import metrics as M
from stancekit.operators import sampling as S
from stancekit.plans.catalog import register
from stancekit.plans import sqlfrag as sqlf
from stancekit.plans.sqlfrag import H, KEY_SQL, U, label_ids, letter_vector, multi_hot, ratio, with_ctes
from stancekit.sources import fixtures as fx

KEY = ["speech_id", "sent_idx"]
BASELINE_SEED = 0


def _test(spark, sf):
    return fx.sentences(spark, sf).where(F.col("split") == "test").drop("split")


def _train(spark, sf):
    return fx.sentences(spark, sf).where(F.col("split") == "train").drop("split")


def baseline_scored(spark, sf):
    """Test rows with gold and class-share-baseline prediction vectors."""
    b = S.random_baseline(_test(spark, sf), seed=BASELINE_SEED)
    return b.select(*KEY, "class_code", "pred_code",
                    L.multi_hot(L.label_ids(F.col("class_code"))).alias("gold_vec"),
                    L.multi_hot(L.label_ids(F.col("pred_code"))).alias("pred_vec"))


# ---- SQL: the same scoring on the DuckDB side ----
_W = S.CLASS_SHARES
_BASE_U = U(str(BASELINE_SEED), KEY_SQL)
_BASE_CODE = (f"(CASE WHEN {_BASE_U} < {_W[0]} THEN 0 WHEN {_BASE_U} < {_W[0] + _W[1]} THEN 1 "
              f"WHEN {_BASE_U} < {_W[0] + _W[1] + _W[2]} THEN 2 ELSE 3 END)")


def sql_report(src: str, gold: str, pred: str, names=L.REPORT_NAMES, by: str | None = None) -> str:
    """DuckDB classification report over a FROM clause with two vector columns."""
    g = f"{by}, " if by else ""
    sums = ", ".join(
        f"SUM(COALESCE({gold}[{j + 1}], 0) * COALESCE({pred}[{j + 1}], 0))::BIGINT AS tp{j}, "
        f"SUM(COALESCE({pred}[{j + 1}], 0))::BIGINT AS pp{j}, SUM(COALESCE({gold}[{j + 1}], 0))::BIGINT AS ts{j}"
        for j in range(3))
    inter = " + ".join(f"COALESCE({gold}[{j + 1}], 0) * COALESCE({pred}[{j + 1}], 0)" for j in range(3))
    n_p = " + ".join(f"COALESCE({pred}[{j + 1}], 0)" for j in range(3))
    n_t = " + ".join(f"COALESCE({gold}[{j + 1}], 0)" for j in range(3))
    per = [(ratio(f"tp{j}", f"pp{j}"), ratio(f"tp{j}", f"ts{j}"), ratio(f"2 * tp{j}", f"pp{j} + ts{j}"), f"ts{j}")
           for j in range(3)]
    tp, pp, ts = "(tp0 + tp1 + tp2)", "(pp0 + pp1 + pp2)", "(ts0 + ts1 + ts2)"
    rows = [(j, names[j], *per[j]) for j in range(3)]
    rows.append((3, "micro avg", ratio(tp, pp), ratio(tp, ts), ratio(f"2 * {tp}", f"{pp} + {ts}"), ts))
    rows.append((4, "macro avg", *[f"(({per[0][i]}) + ({per[1][i]}) + ({per[2][i]})) / 3" for i in range(3)], ts))
    rows.append((5, "weighted avg", *[ratio(" + ".join(f"({per[j][i]}) * ts{j}" for j in range(3)), ts) for i in range(3)], ts))
    rows.append((6, "samples avg", ratio("s_p", "n_rows"), ratio("s_r", "n_rows"), ratio("s_f", "n_rows"), ts))
    selects = " UNION ALL ".join(
        f"SELECT {g}{i}::BIGINT AS row_no, '{name}' AS label, round({p}, 6) AS precision, round({r}, 6) AS recall, "
        f"round({f}, 6) AS f1, ({s})::BIGINT AS support FROM sums"
        for i, name, p, r, f, s in rows)
    group = f" GROUP BY {by}" if by else ""
    return (f"sums AS (SELECT {g}{sums}, SUM({ratio(inter, n_p)}) AS s_p, SUM({ratio(inter, n_t)}) AS s_r, "
            f"SUM({ratio(f'2 * ({inter})', f'{n_p} + {n_t}')}) AS s_f, COUNT(*) AS n_rows FROM {src}{group})\n"
            + selects)


_BASE_SRC = (f"(SELECT speech_id, sent_idx, {multi_hot(label_ids('class_code'))} AS gold_vec, "
             f"{multi_hot(label_ids(_BASE_CODE))} AS pred_vec FROM test_rows) b")


def _report_sql(src=_BASE_SRC, ctes=("test_rows",), gold="gold_vec", pred="pred_vec", by=None):
    body = sql_report(src, gold, pred, by=by)
    full = with_ctes(list(ctes), "SELECT 1")
    head = full[: full.rfind("\nSELECT 1")]
    return head + ",\n" + body


@register("classification_report", _report_sql())
def q_classification_report(spark, sf):
    """Class-share baseline on the test split: the full multi-label report."""
    return M.classification_report(baseline_scored(spark, sf))


def _ints(c):
    """array<int> -> 'a,b,c' string."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _sql_ints(c):
    return f"array_to_string({c}, ',')"


# ---------------------------------------------------------------- 2.1 sources
@register("load_split", with_ctes(["test_rows"], "SELECT speech_id, sent_idx, sentence, class_code FROM test_rows"))
def q_load_split(spark, sf):
    """The test split of the labelled corpus."""
    return _test(spark, sf)


@register("run_tag", with_ctes(["responses"], "SELECT run_tag, COUNT(*)::BIGINT AS n_rows FROM responses GROUP BY run_tag"))
def q_run_tag(spark, sf):
    """Run names of the stub answers, rows per run."""
    return fx.responses(spark, sf).groupBy("run_tag").agg(F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------ 2.2 filters and limits
@register("filter_positive", with_ctes(["sentences"], "SELECT speech_id, sent_idx, class_code FROM sentences WHERE class_code <> 0"))
def q_filter_positive(spark, sf):
    from stancekit.operators.encoding import filter_positive
    return filter_positive(fx.sentences(spark, sf)).select(*KEY, "class_code")


@register("filter_word_band", with_ctes(["sentences"], """
SELECT speech_id, sent_idx, class_code, len(string_split(sentence, ' '))::BIGINT AS n_words
FROM sentences WHERE len(string_split(sentence, ' ')) BETWEEN 9 AND 31"""))
def q_filter_word_band(spark, sf):
    """Strictly 8 < words < 32."""
    s = S.word_band(fx.sentences(spark, sf), 9, 31)
    return s.select(*KEY, "class_code", word_count(F.col("sentence")).alias("n_words"))


@register("truncate_words", with_ctes(["train_rows"], """
SELECT speech_id, sent_idx,
       CASE WHEN len(string_split(sentence, ' ')) > 48
            THEN array_to_string(list_slice(string_split(sentence, ' '), 1, 48), ' ') ELSE sentence END AS sentence
FROM train_rows"""))
def q_truncate_words(spark, sf):
    """First 48 space-split words of long sentences."""
    return _train(spark, sf).select(*KEY, truncate_words(F.col("sentence"), 48).alias("sentence"))


@register("limit_samples", with_ctes(["train_rows"], """
SELECT speech_id, sent_idx, class_code FROM train_rows ORDER BY speech_id, sent_idx LIMIT 500"""))
def q_limit_samples(spark, sf):
    """First min(500, n) train rows in key order (the limit is the feature)."""
    return S.limit_samples(_train(spark, sf), 500).select(*KEY, "class_code")


@register("head_sample", with_ctes(["train_rows"], """
SELECT speech_id, sent_idx, sentence FROM train_rows ORDER BY speech_id, sent_idx LIMIT 10"""))
def q_head_sample(spark, sf):
    return S.head_sample(_train(spark, sf), 10).select(*KEY, "sentence")


@register("drop_columns", with_ctes(["train_rows"], "SELECT speech_id, sent_idx FROM train_rows"))
def q_drop_columns(spark, sf):
    """Raw text and label dropped before training (Catalyst prunes the scan)."""
    return _train(spark, sf).drop("sentence", "class_code")


# ----------------------------------------------------------- 2.3 label encoding
@register("label_ids", with_ctes(["sentences"], f"""
SELECT speech_id, sent_idx, {_sql_ints(label_ids('class_code'))} AS ids FROM sentences"""))
def q_label_ids(spark, sf):
    return fx.sentences(spark, sf).select(*KEY, _ints(L.label_ids(F.col("class_code"))).alias("ids"))


_FUSED_SQL = (f"(CASE WHEN v[1] = 1 AND v[2] = 0 AND v[3] = 0 THEN 0 WHEN v[1] = 0 AND v[2] = 1 AND v[3] = 0 THEN 1 "
              f"WHEN v[1] = 0 AND v[2] = 0 AND v[3] = 1 THEN 2 WHEN v[1] = 0 AND v[2] = 1 AND v[3] = 1 THEN 3 "
              f"WHEN v[1] = 1 THEN 4 ELSE 5 END)")
_THRESH_SQL = "list_transform(logits, lambda x: CAST(x > 0 AS INT))"


def _fused(spark, sf):
    lg = fx.logits(spark, sf)
    v = L.threshold_logits(F.col("logits"))
    return lg.select(*KEY, "class_code", "logits", v.alias("pred_vec"), L.fuse_code(v).alias("fused"))


@register("label_ids_folded", with_ctes(["logits"], f"""
SELECT speech_id, sent_idx, fused::BIGINT AS fused, {_sql_ints(label_ids('fused', True))} AS ids
FROM (SELECT speech_id, sent_idx, {_FUSED_SQL} AS fused FROM (SELECT *, {_THRESH_SQL} AS v FROM logits))"""))
def q_label_ids_folded(spark, sf):
    """Fused prediction codes 0..5: 3 and 4 become [1, 2], 5 has none (null)."""
    f = _fused(spark, sf)
    return f.select(*KEY, "fused", _ints(L.label_ids(F.col("fused"), fold4=True)).alias("ids"))


@register("multi_hot", with_ctes(["sentences"], f"""
SELECT speech_id, sent_idx, {_sql_ints(multi_hot(label_ids('class_code')))} AS vec FROM sentences"""))
def q_multi_hot(spark, sf):
    return fx.sentences(spark, sf).select(*KEY, _ints(L.multi_hot(L.label_ids(F.col("class_code")))).alias("vec"))


@register("gold_vector", with_ctes(["test_rows"], f"""
SELECT speech_id, sent_idx, {_sql_ints(multi_hot(label_ids('class_code')))} AS gold_vec FROM test_rows"""))
def q_gold_vector(spark, sf):
    return _test(spark, sf).select(*KEY, _ints(L.multi_hot(L.label_ids(F.col("class_code")))).alias("gold_vec"))


@register("binarize_fit", with_ctes(["train_rows", "test_rows"], f"""
SELECT speech_id, sent_idx,
       array_to_string(list_transform(cls, lambda c: CAST(list_contains({label_ids('class_code')}, c) AS INT)), ',') AS vec
FROM test_rows, (SELECT list_sort(list(DISTINCT c)) AS cls FROM (SELECT unnest({label_ids('class_code')}) AS c FROM train_rows))"""))
def q_binarize_fit(spark, sf):
    """Learn the class set on train, encode test with it."""
    from stancekit.operators.encoding import binarize, fit_classes
    train = _train(spark, sf).select(L.label_ids(F.col("class_code")).alias("ids"))
    classes = fit_classes(train)
    t = binarize(_test(spark, sf).withColumn("ids", L.label_ids(F.col("class_code"))), classes)
    return t.select(*KEY, _ints(F.col("vec")).alias("vec"))


@register("hot_to_ids", with_ctes(["logits"], f"""
SELECT speech_id, sent_idx,
       array_to_string(list_filter(list_transform({_THRESH_SQL}, lambda x, i: CASE WHEN x = 1 THEN i - 1 END), lambda x: x IS NOT NULL), ',') AS ids
FROM logits"""))
def q_hot_to_ids(spark, sf):
    """Thresholded prediction vectors back to id lists."""
    lg = fx.logits(spark, sf)
    return lg.select(*KEY, _ints(L.hot_to_ids(L.threshold_logits(F.col("logits")))).alias("ids"))


PARA = 8


@register("hot_to_ids_nested", with_ctes(["logits"], f"""
SELECT speech_id, para::BIGINT AS para,
       array_to_string(list_transform(list(v ORDER BY sent_idx),
         lambda vv: array_to_string(list_filter(list_transform(vv, lambda x, i: CASE WHEN x = 1 THEN i - 1 END), lambda x: x IS NOT NULL), ',')), '|') AS ids
FROM (SELECT speech_id, sent_idx, sent_idx // {PARA} AS para, {_THRESH_SQL} AS v FROM logits)
GROUP BY speech_id, para"""))
def q_hot_to_ids_nested(spark, sf):
    """Per paragraph (8 consecutive sentences): vectors -> id lists."""
    lg = fx.logits(spark, sf).select(*KEY, (F.col("sent_idx") / PARA).cast("int").alias("para"),
                                     L.threshold_logits(F.col("logits")).alias("v"))
    par = lg.groupBy("speech_id", "para").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "v"))), lambda s: s["v"]).alias("vv"))
    return par.select("speech_id", "para", F.array_join(
        F.transform(L.hot_to_ids_nested(F.col("vv")), lambda x: _ints(x)), "|").alias("ids"))


@register("fuse_code", with_ctes(["logits"], f"""
SELECT speech_id, sent_idx, array_to_string(v, ',') AS pred_vec, {_FUSED_SQL}::BIGINT AS fused
FROM (SELECT *, {_THRESH_SQL} AS v FROM logits)"""))
def q_fuse_code(spark, sf):
    f = _fused(spark, sf)
    return f.select(*KEY, _ints(F.col("pred_vec")).alias("pred_vec"), "fused")


@register("explode_explained", with_ctes(["logits"], f"""
SELECT speech_id, sent_idx, fused::BIGINT AS fused, (i - 1)::BIGINT AS class_id
FROM (SELECT *, {_FUSED_SQL} AS fused, unnest(generate_series(1, 3)) AS i FROM (SELECT *, {_THRESH_SQL} AS v FROM logits))
WHERE v[i] = 1"""))
def q_explode_explained(spark, sf):
    """One row per (test row, class to explain); code 5 rows vanish."""
    from stancekit.operators.encoding import explode_explained
    return explode_explained(_fused(spark, sf)).select(*KEY, "fused", "class_id")


@register("filter_explainable", with_ctes(["logits"], f"""
SELECT speech_id, sent_idx, fused::BIGINT AS fused
FROM (SELECT *, {_FUSED_SQL} AS fused FROM (SELECT *, {_THRESH_SQL} AS v FROM logits)) WHERE fused <> 5"""))
def q_filter_explainable(spark, sf):
    """Rows whose prediction has at least one class to explain."""
    return _fused(spark, sf).where(F.size(L.explained_classes(F.col("pred_vec"))) > 0).select(*KEY, "fused")


@register("letter_label", with_ctes(["sentences"], f"""
SELECT speech_id, sent_idx, {sqlf.letter('class_code')} AS letter, {sqlf.full_label('class_code')} AS full_label FROM sentences"""))
def q_letter_label(spark, sf):
    t = fx.sentences(spark, sf)
    return t.select(*KEY, L.letter(F.col("class_code")).alias("letter"), L.full_label(F.col("class_code")).alias("full_label"))


@register("binary_gold", with_ctes(["sentences"], """
SELECT speech_id, sent_idx, CAST(class_code <> 0 AS INT)::BIGINT AS gold FROM sentences"""))
def q_binary_gold(spark, sf):
    return fx.sentences(spark, sf).select(*KEY, L.binary_gold(F.col("class_code")).alias("gold"))


@register("binary_gold_nested", with_ctes(["sentences"], """
SELECT speech_id, (sent_idx // 5)::BIGINT AS paragraph, array_to_string(list(CAST(class_code <> 0 AS INT) ORDER BY sent_idx), ',') AS gold
FROM sentences GROUP BY speech_id, sent_idx // 5"""))
def q_binary_gold_nested(spark, sf):
    """Per paragraph of 5 sentences the 0/1 gold of each sentence."""
    p = fx.paragraphs(fx.sentences(spark, sf), "class_code")
    return p.select("speech_id", "paragraph", _ints(L.binary_gold_nested(F.col("values"))).alias("gold"))


@register("threshold_logits", with_ctes(["logits"], f"""
SELECT speech_id, sent_idx, array_to_string({_THRESH_SQL}, ',') AS pred_vec FROM logits"""))
def q_threshold_logits(spark, sf):
    return fx.logits(spark, sf).select(*KEY, _ints(L.threshold_logits(F.col("logits"))).alias("pred_vec"))


# ------------------------------------------------------------------ 2.4 sampling
@register("upsample_minority", with_ctes(["train_rows"], """
SELECT speech_id, sent_idx, class_code, unnest(range(0, CASE WHEN class_code <> 0 THEN 6 ELSE 1 END))::BIGINT AS copy_no
FROM train_rows"""))
def q_upsample_minority(spark, sf):
    """Train rows plus 5 more copies of every positive row."""
    return S.upsample_minority(_train(spark, sf), 5).select(*KEY, "class_code", "copy_no")


@register("concat_datasets", with_ctes(["train_rows", "test_rows"], """
SELECT speech_id, sent_idx, 'train' AS part FROM train_rows UNION ALL SELECT speech_id, sent_idx, 'test' AS part FROM test_rows"""))
def q_concat_datasets(spark, sf):
    a = _train(spark, sf).select(*KEY, F.lit("train").alias("part"))
    b = _test(spark, sf).select(*KEY, F.lit("test").alias("part"))
    return S.concat_datasets(a, b)


@register("train_test_split", with_ctes(["sentences"], f"""
SELECT speech_id, sent_idx, CASE WHEN {U('7', 'speech_id')} < 0.2 THEN 'test' ELSE 'train' END AS split2 FROM sentences"""))
def q_train_test_split(spark, sf):
    """Second 80/20 split by speech (no leakage), seed 7."""
    s = fx.sentences(spark, sf).select(*KEY)
    return S.train_test_split(s, 0.2, KEY, seed=7, group="speech_id", out="split2")


@register("train_test_split_exact", with_ctes(["sentences"], f"""
SELECT speech_id, sent_idx,
       CASE WHEN row_number() OVER (ORDER BY {H('7', KEY_SQL)}, speech_id, sent_idx) <= ceil(0.2 * COUNT(*) OVER ()) THEN 'test' ELSE 'train' END AS split2
FROM sentences"""))
def q_train_test_split_exact(spark, sf):
    """Exactly ceil(0.2 n) rows to test, first by (hash, key)."""
    s = fx.sentences(spark, sf).select(*KEY)
    return S.train_test_split_exact(s, 0.2, KEY, seed=7, out="split2")


@register("seeded_shuffle", with_ctes(["train_rows"], f"""
SELECT speech_id, sent_idx, {H('42', KEY_SQL)} AS shuffle_hash FROM train_rows"""))
def q_seeded_shuffle(spark, sf):
    return S.seeded_shuffle(_train(spark, sf).select(*KEY), 42)


KSHOT = 16


@register("kshot_sample", with_ctes(["train_rows"], f"""
SELECT speech_id, sent_idx, class_code, {H("'mix42'", KEY_SQL)} AS mix_hash
FROM (SELECT *, row_number() OVER (PARTITION BY class_code ORDER BY {H('42', KEY_SQL)}, speech_id, sent_idx) AS rn
      FROM train_rows WHERE len(string_split(sentence, ' ')) BETWEEN 9 AND 31)
WHERE rn <= {KSHOT // 4}"""))
def q_kshot_sample(spark, sf):
    """16 shots: 4 per class from the train word band, by seeded hash."""
    return S.kshot_sample(_train(spark, sf), KSHOT, seed=42).select(*KEY, "class_code", "mix_hash")


@register("random_baseline", with_ctes(["test_rows"], f"""
SELECT speech_id, sent_idx, {_BASE_CODE}::BIGINT AS pred_code FROM test_rows"""))
def q_random_baseline(spark, sf):
    return S.random_baseline(_test(spark, sf), seed=BASELINE_SEED).select(*KEY, "pred_code")


@register("log_sample", with_ctes(["train_rows"], f"""
SELECT speech_id, sent_idx, {H('42', KEY_SQL)} AS sample_hash FROM train_rows ORDER BY sample_hash, speech_id, sent_idx LIMIT 3"""))
def q_log_sample(spark, sf):
    return S.log_sample(_train(spark, sf).select(*KEY), 3, 42)


@register("class_distribution", with_ctes(["sentences"], """
SELECT class_code::BIGINT AS class_code, COUNT(*)::BIGINT AS n, round(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share
FROM sentences GROUP BY class_code"""))
def q_class_distribution(spark, sf):
    return S.class_distribution(fx.sentences(spark, sf))


# ------------------------------------------------------------------ 2.8 answers
def scored_responses(spark, sf):
    r = fx.responses(spark, sf)
    lt = parse_answer(F.col("model_response"))
    return r.select("run_tag", *KEY, "class_code", "model_response", lt.alias("pred_letter"),
                    L.multi_hot(L.label_ids(F.col("class_code"))).alias("gold_vec"),
                    L.letter_vector(lt).alias("pred_vec"))


_RESP_SCORED = (f"(SELECT run_tag, speech_id, sent_idx, class_code, "
                f"{multi_hot(label_ids('class_code'))} AS gold_vec, "
                f"{letter_vector(f'COALESCE({sqlf.parse_letter('model_response')}, {sqlf.parse_keyword('model_response')})')} AS pred_vec, "
                f"COALESCE({sqlf.parse_letter('model_response')}, {sqlf.parse_keyword('model_response')}) AS pred_letter "
                f"FROM responses) r")


@register("answer_prefix", with_ctes(["test_rows"], f"""
SELECT speech_id, sent_idx, {sqlf.lit(sqlf.ANSWER_OPENING)} || {sqlf.letter('class_code')} || ')' AS answer FROM test_rows"""))
def q_answer_prefix(spark, sf):
    """Gold answer in stored form: fixed opening + generated letter."""
    from stancekit.functions.answers import answer_prefix
    t = _test(spark, sf)
    return t.select(*KEY, answer_prefix(F.concat(L.letter(F.col("class_code")), F.lit(")"))).alias("answer"))


@register("parse_letter", with_ctes(["responses"], f"""
SELECT run_tag, speech_id, sent_idx, {sqlf.parse_letter('model_response')} AS letter FROM responses"""))
def q_parse_letter(spark, sf):
    r = fx.responses(spark, sf)
    return r.select("run_tag", *KEY, parse_letter(F.col("model_response")).alias("letter"))


@register("parse_keyword", with_ctes(["responses"], f"""
SELECT run_tag, speech_id, sent_idx, {sqlf.parse_keyword('model_response')} AS letter FROM responses
WHERE {sqlf.parse_letter('model_response')} IS NULL"""))
def q_parse_keyword(spark, sf):
    """Second stage for answers without a letter."""
    r = fx.responses(spark, sf).where(parse_letter(F.col("model_response")).isNull())
    return r.select("run_tag", *KEY, parse_keyword(F.col("model_response")).alias("letter"))


@register("letter_vector", with_ctes(["responses"], f"SELECT run_tag, speech_id, sent_idx, array_to_string(pred_vec, ',') AS pred_vec FROM {_RESP_SCORED}"))
def q_letter_vector(spark, sf):
    return scored_responses(spark, sf).select("run_tag", *KEY, _ints(F.col("pred_vec")).alias("pred_vec"))


_NAME = f"CASE (sent_idx + speech_id) % 4 WHEN 0 THEN {sqlf.letter('class_code')} WHEN 1 THEN {sqlf.full_label('class_code')} WHEN 2 THEN upper(substring({sqlf.full_label('class_code')}, 5)) ELSE 'none of these' END"


@register("letter_vector_names", with_ctes(["sentences"], f"""
SELECT speech_id, sent_idx, name, CASE WHEN (sent_idx + speech_id) % 4 = 3 THEN NULL ELSE array_to_string({multi_hot(label_ids('class_code'))}, ',') END AS vec
FROM (SELECT *, {_NAME} AS name FROM sentences)"""))
def q_letter_vector_names(spark, sf):
    """Letters, full labels and bare class names to vectors; anything else is null."""
    which, code = (F.col("sent_idx") + F.col("speech_id")) % 4, F.col("class_code")
    name = (F.when(which == 0, L.letter(code)).when(which == 1, L.full_label(code))
            .when(which == 2, F.upper(F.substring(L.full_label(code), 5, 1 << 20))).otherwise("none of these"))
    s = fx.sentences(spark, sf).withColumn("name", name)
    return s.select(*KEY, "name", _ints(L.letter_vector(F.col("name"))).alias("vec"))


@register("unparsed_report", with_ctes(["responses"], f"""
SELECT run_tag, COUNT(*) FILTER (WHERE pred_letter IS NULL)::BIGINT AS n_unparsed, COUNT(*)::BIGINT AS n_rows
FROM {_RESP_SCORED} GROUP BY run_tag"""))
def q_unparsed_report(spark, sf):
    return M.unparsed_report(scored_responses(spark, sf))


# --------------------------------------------------------------- 2.9 evaluation
def _resp_report(by=None):
    return _report_sql(_RESP_SCORED, ("responses",), by=by)


def _filter_report(sql: str, labels: list[str]) -> str:
    cond = " OR ".join(f"label = '{x}'" for x in labels)
    return f"SELECT * FROM (\n{sql}\n) WHERE {cond}"


_RESP_REPORT = _resp_report()


@register("metrics_per_label", _filter_report(_RESP_REPORT, L.REPORT_NAMES))
def q_metrics_per_label(spark, sf):
    """Stub answers of all runs pooled: P/R/F1/support per label."""
    return M.metrics_per_label(scored_responses(spark, sf))


@register("metrics_micro", _filter_report(_RESP_REPORT, ["micro avg"]))
def q_metrics_micro(spark, sf):
    return M.metrics_micro(scored_responses(spark, sf))


@register("metrics_macro", _filter_report(_RESP_REPORT, ["macro avg"]))
def q_metrics_macro(spark, sf):
    return M.metrics_macro(scored_responses(spark, sf))


@register("metrics_weighted", _filter_report(_RESP_REPORT, ["weighted avg"]))
def q_metrics_weighted(spark, sf):
    return M.metrics_weighted(scored_responses(spark, sf))


@register("metrics_samples", _filter_report(_RESP_REPORT, ["samples avg"]))
def q_metrics_samples(spark, sf):
    return M.metrics_samples(scored_responses(spark, sf))


@register("classification_report_by_run", _resp_report("run_tag"))
def q_classification_report_by_run(spark, sf):
    """Full report per run of stub answers."""
    return M.classification_report(scored_responses(spark, sf), by=("run_tag",))


def _score_line_sql(digits: int = 6) -> str:
    f1 = [ratio(f"2 * tp{j}", f"pp{j} + ts{j}") for j in range(3)]
    sums = ", ".join(
        f"SUM(COALESCE(gold_vec[{j + 1}], 0) * COALESCE(pred_vec[{j + 1}], 0)) AS tp{j}, "
        f"SUM(COALESCE(pred_vec[{j + 1}], 0)) AS pp{j}, SUM(COALESCE(gold_vec[{j + 1}], 0)) AS ts{j}" for j in range(3))
    return (f"SELECT run_tag, {', '.join(f'round({f}, 6) AS f1_{j}' for j, f in enumerate(f1))}, "
            f"round((({f1[0]}) + ({f1[1]}) + ({f1[2]})) / 3, {digits}) AS macro_f1, n_rows "
            f"FROM (SELECT run_tag, {sums}, COUNT(*)::BIGINT AS n_rows FROM {_RESP_SCORED} GROUP BY run_tag)")


_SCORE_LINE = with_ctes(["responses"], _score_line_sql())


@register("score_line", _SCORE_LINE)
def q_score_line(spark, sf):
    return M.score_line(scored_responses(spark, sf))


@register("compare_runs", with_ctes(["responses"], f"""
SELECT arg_max(run_tag, (macro_f1, run_tag)) AS best_run, round(max(macro_f1), 6) AS best_macro_f1, COUNT(*)::BIGINT AS n_runs
FROM ({_score_line_sql(15)})"""))
def q_compare_runs(spark, sf):
    """Best of the stub runs by macro F1."""
    return M.compare_runs(M.score_line(scored_responses(spark, sf)).withColumn("macro_f1", F.round("macro_f1", 15)))


_LOGIT_SRC = (f"(SELECT speech_id, sent_idx, {multi_hot(label_ids('class_code'))} AS gold_vec, {_THRESH_SQL} AS pred_vec "
              f"FROM logits) z")


@register("eval_summary", f"""
SELECT max(CASE WHEN label = 'micro avg' THEN f1 END) AS micro_f1, max(CASE WHEN label = 'macro avg' THEN f1 END) AS macro_f1
FROM (\n{_report_sql(_LOGIT_SRC, ('logits',))}\n)""")
def q_eval_summary(spark, sf):
    """Micro and macro F1 of the stub logits against gold."""
    lg = fx.logits(spark, sf).withColumn("gold_vec", L.multi_hot(L.label_ids(F.col("class_code"))))
    return M.eval_summary(lg)


@register("sample_counts", with_ctes(["sentences"], "SELECT split, COUNT(*)::BIGINT AS n_samples FROM sentences GROUP BY split"))
def q_sample_counts(spark, sf):
    return M.sample_counts(fx.sentences(spark, sf))
