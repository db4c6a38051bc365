"""Multi-label precision / recall / F1 with micro, macro, weighted, samples.

One aggregation pass: per label the sums of t*p, p and t, plus the per-row
(samples) ratios. These are partial aggregates (map-side combine), so the
shuffle carries one small row per task and group, whatever the skew. All
report rows are arithmetic on that one row (or one row per group).
0/0 is 0, as in the usual report.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.functions.labels import N_LABELS, REPORT_NAMES, threshold_logits


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _vec(col: str, j: int) -> Column:
    return F.coalesce(F.get(F.col(col), j), F.lit(0)).cast("long")


def label_sums(df: DataFrame, gold: str = "gold_vec", pred: str = "pred_vec", by=(),
               k: int = N_LABELS) -> DataFrame:
    """One row per ``by`` group: tp_j, pp_j, ts_j and the samples sums.

    A null prediction vector counts as all zeros (an unparsed answer).
    """
    aggs = []
    for j in range(k):
        t, p = _vec(gold, j), _vec(pred, j)
        aggs += [F.sum(t * p).alias(f"tp{j}"), F.sum(p).alias(f"pp{j}"), F.sum(t).alias(f"ts{j}")]
    inter = sum((_vec(gold, j) * _vec(pred, j) for j in range(k)), F.lit(0))
    n_p = sum((_vec(pred, j) for j in range(k)), F.lit(0))
    n_t = sum((_vec(gold, j) for j in range(k)), F.lit(0))
    aggs += [
        F.sum(_ratio(inter, n_p)).alias("s_p"),
        F.sum(_ratio(inter, n_t)).alias("s_r"),
        F.sum(_ratio(2 * inter, n_p + n_t)).alias("s_f"),
        F.count(F.lit(1)).alias("n_rows"),
    ]
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(*aggs)


def _per_label(j: int):
    tp, pp, ts = F.col(f"tp{j}"), F.col(f"pp{j}"), F.col(f"ts{j}")
    return _ratio(tp, pp), _ratio(tp, ts), _ratio(2 * tp, pp + ts), ts


def report_from_sums(sums: DataFrame, names=REPORT_NAMES, by=(), k: int = N_LABELS) -> DataFrame:
    """Stack per-label, micro, macro, weighted and samples rows."""
    per = [_per_label(j) for j in range(k)]
    tp = sum((F.col(f"tp{j}") for j in range(k)), F.lit(0))
    pp = sum((F.col(f"pp{j}") for j in range(k)), F.lit(0))
    ts = sum((F.col(f"ts{j}") for j in range(k)), F.lit(0))
    rows = []
    for j, (p, r, f, s) in enumerate(per):
        rows.append((j, names[j], p, r, f, s))
    rows.append((k, "micro avg", _ratio(tp, pp), _ratio(tp, ts), _ratio(2 * tp, pp + ts), ts))
    rows.append((k + 1, "macro avg",
                 sum((x[0] for x in per), F.lit(0.0)) / k,
                 sum((x[1] for x in per), F.lit(0.0)) / k,
                 sum((x[2] for x in per), F.lit(0.0)) / k, ts))
    rows.append((k + 2, "weighted avg",
                 _ratio(sum((x[0] * x[3] for x in per), F.lit(0.0)), ts),
                 _ratio(sum((x[1] * x[3] for x in per), F.lit(0.0)), ts),
                 _ratio(sum((x[2] * x[3] for x in per), F.lit(0.0)), ts), ts))
    n = F.col("n_rows")
    rows.append((k + 3, "samples avg", _ratio(F.col("s_p"), n), _ratio(F.col("s_r"), n),
                 _ratio(F.col("s_f"), n), ts))
    structs = [
        F.struct(F.lit(i).alias("row_no"), F.lit(name).alias("label"), p.alias("precision"),
                 r.alias("recall"), f.alias("f1"), s.cast("long").alias("support"))
        for i, name, p, r, f, s in rows
    ]
    return sums.select(*by, F.inline(F.array(*structs)))


def classification_report(df: DataFrame, names=REPORT_NAMES, gold: str = "gold_vec",
                          pred: str = "pred_vec", by=()) -> DataFrame:
    """(by..., row_no, label, precision, recall, f1, support)."""
    return report_from_sums(label_sums(df, gold, pred, by), names, by)


def metrics_per_label(df: DataFrame, gold="gold_vec", pred="pred_vec", names=REPORT_NAMES) -> DataFrame:
    return classification_report(df, names, gold, pred).where(F.col("row_no") < N_LABELS)


def _one(df, gold, pred, name):
    return classification_report(df, REPORT_NAMES, gold, pred).where(F.col("label") == name)


def metrics_micro(df: DataFrame, gold="gold_vec", pred="pred_vec") -> DataFrame:
    return _one(df, gold, pred, "micro avg")


def metrics_macro(df: DataFrame, gold="gold_vec", pred="pred_vec") -> DataFrame:
    return _one(df, gold, pred, "macro avg")


def metrics_weighted(df: DataFrame, gold="gold_vec", pred="pred_vec") -> DataFrame:
    return _one(df, gold, pred, "weighted avg")


def metrics_samples(df: DataFrame, gold="gold_vec", pred="pred_vec") -> DataFrame:
    return _one(df, gold, pred, "samples avg")


def score_line(df: DataFrame, by: str = "run_tag", gold="gold_vec", pred="pred_vec",
               k: int = N_LABELS) -> DataFrame:
    """One row per run: F1 of each label and macro F1."""
    return score_line_from_sums(label_sums(df, gold, pred, (by,), k), by, k)


def score_line_from_sums(sums: DataFrame, by: str = "run_tag", k: int = N_LABELS) -> DataFrame:
    """Score line from the per-group sums (e.g. a streaming aggregate)."""
    f1s = [_per_label(j)[2] for j in range(k)]
    return sums.select(by, *[f.alias(f"f1_{j}") for j, f in enumerate(f1s)],
                       (sum(f1s, F.lit(0.0)) / k).alias("macro_f1"), F.col("n_rows"))


def compare_runs(scores: DataFrame, by: str = "run_tag") -> DataFrame:
    """Best run by macro F1 (ties go to the larger tag)."""
    return scores.agg(
        F.max_by(F.col(by), F.struct("macro_f1", by)).alias("best_run"),
        F.max("macro_f1").alias("best_macro_f1"),
        F.count(F.lit(1)).alias("n_runs"),
    )


def eval_summary(df: DataFrame, logits: str = "logits", gold: str = "gold_vec") -> DataFrame:
    """Micro and macro F1 of thresholded logits."""
    scored = df.withColumn("_pred", threshold_logits(F.col(logits)))
    rep = classification_report(scored, REPORT_NAMES, gold, "_pred")
    return rep.agg(
        F.max(F.when(F.col("label") == "micro avg", F.col("f1"))).alias("micro_f1"),
        F.max(F.when(F.col("label") == "macro avg", F.col("f1"))).alias("macro_f1"),
    )


def sample_counts(df: DataFrame, by: str = "split") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_samples"))


def unparsed_report(df: DataFrame, parsed: str = "pred_letter", by: str = "run_tag") -> DataFrame:
    """Answers that gave no label, per run."""
    return df.groupBy(by).agg(
        F.count_if(F.col(parsed).isNull()).alias("n_unparsed"),
        F.count(F.lit(1)).alias("n_rows"),
    )
