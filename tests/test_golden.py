"""Golden rows (FIXTURES.md section 3)."""
import pytest
from pyspark.sql import functions as F

from stancekit.functions import labels as L
from stancekit.functions.answers import parse_answer, parse_letter
from stancekit.operators import attribution as A
from stancekit.operators import metrics as M


def _tokens(spark, toks, scores):
    data = [(0, 0, i, t, float(s)) for i, (t, s) in enumerate(zip(toks, scores))]
    return spark.createDataFrame(data, "speech_id long, sent_idx int, pos int, token string, score double")


def _merged(df):
    return [(r["word"], round(r["score"], 6)) for r in df.orderBy("word_idx").collect()]


def test_fuse_code_and_explained(spark):
    cases = {(1, 0, 0): (0, [0]), (0, 1, 0): (1, [1]), (0, 0, 1): (2, [2]), (0, 1, 1): (3, [1, 2]),
             (1, 1, 0): (4, [0, 1]), (1, 0, 1): (4, [0, 2]), (1, 1, 1): (4, [0, 1, 2]), (0, 0, 0): (5, [])}
    df = spark.createDataFrame([(list(k),) for k in cases], "v array<int>")
    out = df.select("v", L.fuse_code("v").alias("c"), L.explained_classes("v").alias("e")).collect()
    for r in out:
        assert (r["c"], list(r["e"])) == cases[tuple(r["v"])]


def test_merge_words_max(spark):
    df = _tokens(spark, "<s> Ma ke ĠAmerica ĠGr eat </s>".split(), [.1, .2, .9, .3, -.5, -.2, 0])
    assert _merged(A.merge_words_max(df)) == [("<s>", .1), ("Make", .9), ("America", .3), ("Great", -.2), ("</s>", 0.0)]


def test_merge_words_sum(spark):
    df = _tokens(spark, ["peaceful", "##ly", "today"], [.5, .6, .7])
    assert _merged(A.merge_words_sum(df)) == [("peacefully", 1.1), ("today", .7)]


def _fold(spark, fn, toks, scores):
    df = spark.createDataFrame([(toks, [float(x) for x in scores])], "t array<string>, s array<double>")
    out = df.select(F.inline(fn(F.col("t"), F.col("s")))).collect()
    return [(r["token"], round(r["score"], 6)) for r in out]


def test_merge_hyphens(spark):
    got = _fold(spark, A.merge_hyphens, ["this", "co", "-", "exists", "peaceful", "##ly", "today"],
                [.1, .2, .3, .4, .5, .6, .7])
    assert got == [("this", .1), ("co-exists", .9), ("peaceful", .5), ("##ly", .6), ("today", .7)]


@pytest.mark.parametrize("toks,scores,want", [
    ("Check this ( February , 1985 )".split(), [.1, .2, .3, .4, .5, .6, .7],
     [("Check", .1), ("this", .2), ("(February", .7), (",", .5), ("1985)", 1.3)]),
    ("Check this ( 1985 )".split(), [.1, .2, .3, .4, .5], [("Check", .1), ("this", .2), ("(1985)", 1.2)]),
    ("Check this ( ) okay".split(), [.1, .2, .3, .4, .5], [("Check", .1), ("this", .2), ("()", .7), ("okay", .5)]),
    ("It costs $ 200 .".split(), [.1, .2, .3, .4, .5], [("It", .1), ("costs", .2), ("$200", .7), (".", .5)]),
])
def test_merge_symbols(spark, toks, scores, want):
    assert _fold(spark, A.merge_symbols, toks, scores) == want


def test_answer_parsing(spark):
    df = spark.createDataFrame([("I would say it is as (b) x or (a)",), ("label it as (d) Both",), ("label it as (x",)], "r string")
    got = [r[0] for r in df.select(parse_letter("r")).collect()]
    assert got == ["a", "d", None]
    # second stage: class names, 'both' first
    df2 = spark.createDataFrame([("both people and elitism",), ("No populism here",), ("nothing",)], "r string")
    assert [r[0] for r in df2.select(parse_answer("r")).collect()] == ["d", "a", None]


def test_report_golden(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 2)], "g int, p int")
    df = df.select(L.multi_hot(L.label_ids("g")).alias("gold_vec"), L.multi_hot(L.label_ids("p")).alias("pred_vec"))
    rep = {r["label"]: (round(r["precision"], 6), round(r["recall"], 6), round(r["f1"], 6), r["support"])
           for r in M.classification_report(df).collect()}
    assert rep["None"] == (1.0, 1.0, 1.0, 1)
    assert rep["Elite"] == (0.5, 0.5, 0.5, 2)
    assert rep["People"] == (1.0, 0.5, 0.666667, 2)
    assert rep["micro avg"] == (0.75, 0.6, 0.666667, 5)
    assert rep["macro avg"] == (0.833333, 0.666667, 0.722222, 5)
    assert rep["weighted avg"] == (0.8, 0.6, 0.666667, 5)
    assert rep["samples avg"] == (0.75, 0.625, 0.666667, 5)


def test_position_tsv_quote(spark, tmp_path):
    from stancekit.sources import io as IO
    p = tmp_path / "pred.tsv"
    p.write_text("idx\trun\tsrc\ttext\tcode\n0\tx\ty\t\"He said hi\t3\n")
    r = IO.read_position_tsv(spark, str(p)).collect()
    assert (r[0]["text"], r[0]["code"]) == ('"He said hi', 3)


def test_list_tsv(spark, tmp_path):
    from stancekit.sources import io as IO
    p = tmp_path / "list.tsv"
    p.write_text("index\tpredictions\tlabels\n0\t[1, 2]\t[0]\n1\t[]\t[2]\n")
    r = IO.read_list_predictions(spark, str(p)).orderBy("idx").collect()
    assert [(list(x["pred_ids"]), list(x["gold_ids"])) for x in r] == [([1, 2], [0]), ([], [2])]


def test_hot_to_ids_nested(spark):
    df = spark.createDataFrame([([[1, 0, 0], [0, 1, 1], [0, 0, 0]],)], "vv array<array<int>>")
    assert [list(x) for x in df.select(L.hot_to_ids_nested("vv")).first()[0]] == [[0], [1, 2], []]


def test_split_contractions(spark):
    df = spark.createDataFrame([(0, 0, 0, "),", .4), (0, 0, 1, "cannot", .2), (0, 0, 2, "ĠDon", .3), (0, 0, 3, "x", .1)],
                               "speech_id long, sent_idx int, pos int, token string, score double")
    out = A.split_contraction_rows(df, "gpt2").orderBy("pos", "sub").collect()
    assert [(r["token"], r["score"]) for r in out] == [(")", .4), (",", 0.0), ("can", .2), ("not", 0.0),
                                                       ("ĠDo", .3), ("n", 0.0), ("x", .1)]
    t5 = spark.createDataFrame([("▁(12)",), ("▁$45",), ("▁7,",)], "t string")
    got = [[p["token"] for p in r[0]] for r in t5.select(A.split_contractions("t", "t5")).collect()]
    assert got == [["▁(", "12", ")"], ["▁$", "45"], ["▁7", ","]]


@pytest.mark.parametrize("agg,scores", [("max", [.4, .3, .7, -.1]), ("sum", [.6, .3, .4, -.1])])
def test_align_to_words(spark, agg, scores):
    """Pieces cut inside words, a hyphen that the words keep, a mark without letters."""
    pieces = spark.createDataFrame([(0, 0, i, p, s) for i, (p, s) in enumerate(zip(
        ["peace", "fully", "to", "co", "-", "exist", "!"], [.4, .2, .3, .7, -.5, .2, -.1]))],
        "speech_id long, sent_idx int, pos int, piece string, score double")
    words = spark.createDataFrame([(0, 0, i, w) for i, w in enumerate(["peacefully", "to", "co-exist", "!"])],
                                  "speech_id long, sent_idx int, word_idx int, word string")
    got = A.align_to_words(pieces, words, agg).orderBy("word_idx").collect()
    assert [(r["word"], r["text"], round(r["score"], 6), r["aligned"]) for r in got] == [
        ("peacefully", "peacefully", scores[0], True), ("to", "to", scores[1], True),
        ("co-exist", "co-exist", scores[2], True), ("!", "!", scores[3], True)]


def test_run_tag_parts(spark):
    from stancekit.sources.runs import run_tag
    df = spark.range(1).select(run_tag("org/Model-7B", lora=True, dist=True, prior=True, rag=True, k=8, seed=3), run_tag("Model", prior=True))
    assert tuple(df.first()) == ("Model-7B_lora_dist_use_prior_rag_k_8_seed_3", "Model_use_prior_k_0_seed_42")


def test_corrupt_responses(spark, tmp_path):
    from stancekit.sources import io as IO
    d = tmp_path / "run_tag=x"
    d.mkdir()
    (d / "a.json").write_text('{"speech_id": "s-1", "sent_idx": 0, "class_code": 1, "model_response": "(a)"}\n{broken\n{"speech_id": 7, "sent_idx": 1, "class_code": 2, "model_response": null}\n')
    rows = IO.read_responses(spark, str(tmp_path)).cache().collect()
    assert sorted((r["speech_id"], r["_corrupt_record"]) for r in rows if r["speech_id"]) == [("7", None), ("s-1", None)]
    assert [r["_corrupt_record"] for r in rows if r["speech_id"] is None] == ["{broken"]


def test_line_index(spark, tmp_path):
    from stancekit.sources import io as IO
    for name, part in (("a.tsv", range(0, 700)), ("b.tsv", range(700, 1000))):
        (tmp_path / name).write_text("name\trun\tsrc\ttext\tcode\n" + "".join(f"row\tx\ty\t\"text {i}\t{i % 4}\n" for i in part))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "128")
    try:
        rows = IO.read_position_tsv(spark, str(tmp_path), index="line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r["idx"], r["text"], r["code"]) for r in rows) == [(i, f'"text {i}', i % 4) for i in range(1000)]


def test_letter_vector_names(spark):
    df = spark.createDataFrame([("a",), ("(b)",), ("(C) People-centrism",), ("both people-centrism and anti-elitism ",), ("x",), (None,)], "s string")
    got = [r[0] if r[0] is None else list(r[0]) for r in df.select(L.letter_vector("s")).collect()]
    assert got == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 1, 1], None, None]
