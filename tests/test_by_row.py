"""Vocabulary, margins and relevance by slices and whole rows, against the forms of one term a row."""
import pytest
from pyspark.sql import functions as F

from stancekit.operators import attribution as A
from stancekit.operators import features as FE
from stancekit.operators import linear as LN
from stancekit.plans import q_attribution
from stancekit.sources import io as IO

from conftest import SF_SMALL

ROW = "speech_id long, sent_idx int, sentence string"


def test_vocabulary_adds_up_in_slices(spark, monkeypatch):
    """Equal terms of many rows reach the term aggregate once a slice, not once a row; a slice's bounds lose nothing."""
    texts = ["one two one two three", "two three four", "", "Ünïcode one", None]
    rows = spark.createDataFrame([(i, 0, texts[i % 5], 1 + i % 3) for i in range(600)], ROW + ", copies long")
    plain = FE.vocabulary(FE.term_counts(rows, extra=["copies"]), FE.document_total(rows, "copies"), weight_col="copies")
    want = sorted(map(tuple, plain.select("term", "df", "ctf").collect()))
    vocabulary, sizes = FE.vocabulary, []

    def counting(terms, *a):
        sizes.append(terms.count())
        return vocabulary(terms, *a)

    monkeypatch.setattr(FE, "vocabulary", counting)
    got = FE.fit_vocabulary(rows, weight_col="copies")
    assert sorted(map(tuple, got.select("term", "df", "ctf").collect())) == want and len(want) > 10
    parts = spark.sparkContext.defaultParallelism
    assert sizes[0] <= 2 * parts * len(want) < FE.term_counts(rows).count()
    monkeypatch.setattr(FE, "SLICE_TOKENS", 4)
    got = FE.bucket_terms(rows.select(FE.tokenize("sentence").alias("_t"), "copies").coalesce(1),
                          spark.range(FE.BUCKETS).select(F.col("id").cast("int").alias("_bucket")), "copies", "_t", 1, 3)
    sums = got.groupBy("term").agg(F.sum("_w").alias("df"), F.sum(F.col("tf") * F.col("_w")).alias("ctf"))
    every = FE.vocabulary(FE.term_counts(rows, extra=["copies"]), F.lit(1e9), 1, 1.0, 100, "copies").select("term", "df", "ctf")
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, every.collect()))


@pytest.fixture
def example(spark):
    # equal keys, a row without terms, one with null arrays, terms without a weight, a class without any
    rows = spark.createDataFrame([(1, 0, ["a", "b"], [0.6, 0.8]), (1, 0, ["a", "z"], [0.5, 0.1]), (2, 0, [], []), (3, 0, None, None), (4, 1, ["b", "c"], [1.0, 2.0])],
                                 "speech_id long, sent_idx int, terms array<string>, weight array<double>")
    long = rows.select("speech_id", "sent_idx", F.explode(F.arrays_zip("terms", "weight")).alias("e")).select("speech_id", "sent_idx", "e.terms", "e.weight").withColumnRenamed("terms", "term")
    coef = spark.createDataFrame([("a", 0, 1.0), ("b", 0, -2.0), ("a", 1, 0.5), ("c", 1, 3.0), ("b", 2, 1.0)], "term string, label int, weight double")
    bias = spark.createDataFrame([(j, 0.1) for j in range(3)], "label int, bias double")
    return rows, long, coef, bias


def _rounded(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else [round(y, 9) if isinstance(y, float) else y for y in x] if isinstance(x, list) else x for x in r) for r in df.collect()), key=str)


def test_scores_and_relevance_by_row(spark, example):
    rows, long, coef, bias = example
    m = LN.score_linear(long, rows, coef, bias)
    assert _rounded(LN.score_linear(rows, rows, coef, bias)) == _rounded(m)
    ex = m.select("speech_id", "sent_idx", F.col("label").alias("class_id")).unionByName(spark.createDataFrame([(4, 1, 7), (1, 0, -1)], "speech_id long, sent_idx int, class_id int"))
    want = A.relevance_linear(long, coef, ex)
    assert _rounded(A.relevance_linear(rows, coef, ex)) == _rounded(want) and want.count() == 9
    side = ex.select("*", F.lit(0).alias("pred_vec"), F.lit(0).alias("gold"), F.lit(0).alias("logits"))
    assert _rounded(IO.relevance_rows(A.relevance_linear(rows, coef, ex, by_row=True), side)) == _rounded(IO.relevance_rows(want, side))


def test_two_weights_of_a_term_raise(spark, example):
    rows, _, coef, bias = example
    with pytest.raises(ValueError):
        LN.score_linear(rows, rows, coef.unionByName(coef), bias)


def test_explained_rows_are_cut_once(spark):
    """The test rows' tf-idf is read back, not made again by every plan that uses it; rows meet their classes whole."""
    tt, coef, _, ex = q_attribution.linear_explained(spark, SF_SMALL)
    plan = A.relevance_linear(tt, coef, ex)._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF(" not in plan and plan.index("Generate") < plan.index("Join")
