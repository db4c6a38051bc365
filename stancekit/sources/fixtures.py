"""Views over the supplied test tables in the shape the toolkit expects.

``sentences`` is the labelled corpus: documents joined to labels, cut into
sentences. The other views derive from it (or from ``conversations`` /
``embeddings``) with the portable hash, so DuckDB can rebuild each one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancekit.functions.answers import answer_prefix
from stancekit.functions.hashing import sentence_key, unit_hash
from stancekit.functions.labels import FULL_LABELS, letter
from stancekit.functions.text import split_sentences, words
from stancekit.session import data_path

KEY = ["speech_id", "sent_idx"]
# --- fixed values of the fixtures ---
SPLIT_SEED = 42
TEST_SHARE = 0.2
RESPONSE_MODEL = "stub-org/StubLM-1B"
RESPONSE_RUNS = [(13, False), (42, True), (77, False)]  # (seed, distribution note)
RESPONSE_AGREE = 0.6       # share of answers copying the gold code
RESPONSE_NO_LETTER = 0.02  # answers with a class name but no letter
RESPONSE_UNSURE = 0.005    # answers with neither
RESPONSE_FAILED = 0.002    # failed generations (null answer)
COEF_BIAS = 0.1
SYMBOL_TOKEN = r"""[-()$€"'%]|[^-()$€"'%\s]+"""
# --- end of fixed values ---

PLAIN_NAMES = [x.split(") ", 1)[1] for x in FULL_LABELS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(data_path(sf_dir, name))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(speech_id, sent_idx, sentence, class_code, split).

    class_code = (1 - quality) + 2 * toxic; the split is by speech.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labs = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(labs, "doc_id")
    out = j.select(
        F.col("doc_id").alias("speech_id"),
        F.posexplode(split_sentences(F.col("text"))).alias("sent_idx", "sentence"),
        ((1 - F.col("quality")) + 2 * F.col("toxic")).cast("int").alias("class_code"),
    )
    return out.withColumn(
        "split",
        F.when(unit_hash(SPLIT_SEED, F.col("speech_id")) < TEST_SHARE, "test").otherwise("train"),
    )


def paragraphs(rows: DataFrame, value: str, size: int = 5) -> DataFrame:
    """(speech_id, paragraph, values): runs of ``size`` sentences with one value each, in order."""
    g = rows.groupBy("speech_id", F.floor(F.col("sent_idx") / size).alias("paragraph")).agg(
        F.array_sort(F.collect_list(F.struct("sent_idx", F.col(value).alias("v")))).alias("_v"))
    return g.select("speech_id", "paragraph", F.transform("_v", lambda x: x["v"]).alias("values"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a second sentence source."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("speech_id"),
        F.col("turn").cast("int").alias("sent_idx"),
        F.col("text").alias("sentence"),
        "role",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a class code and a query/corpus role."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        "embedding",
        (F.col("label") % 4).cast("int").alias("class_code"),
        F.when(F.col("vec_id") % 10 == 0, "query").otherwise("corpus").alias("role"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stub model answers for the test rows, three runs.

    (run_tag, speech_id, sent_idx, sentence, class_code, model_response)
    """
    from stancekit.sources.runs import run_tag

    s = sentences(spark, sf_dir).where(F.col("split") == "test").drop("split")
    runs = F.array(*[F.struct(F.lit(seed).alias("seed"), F.lit(d).alias("dist")) for seed, d in RESPONSE_RUNS])
    r = s.select("*", F.explode(runs).alias("run"))
    rkey = F.concat(sentence_key(), F.lit(":"), F.col("run.seed").cast("string"))
    u_draw = unit_hash(7, rkey)
    draw = (F.when(u_draw < 0.92, 0).when(u_draw < 0.96, 1).when(u_draw < 0.98, 2).otherwise(3))
    pcode = F.when(unit_hash(5, rkey) < RESPONSE_AGREE, F.col("class_code")).otherwise(draw)
    names = F.array(*[F.lit(x) for x in PLAIN_NAMES])
    v = unit_hash(11, rkey)
    generated = (
        F.when(v < RESPONSE_UNSURE, F.lit("unsure"))
        .when(v < RESPONSE_NO_LETTER, F.lower(F.get(names, pcode)))
        .otherwise(F.concat(letter(pcode), F.lit(") "), F.get(names, pcode)))
    )
    resp = F.when(unit_hash(13, rkey) < RESPONSE_FAILED, F.lit(None).cast("string")).otherwise(answer_prefix(generated))
    return r.select(
        run_tag(RESPONSE_MODEL, dist=F.col("run.dist"), k=0, seed=F.col("run.seed")).alias("run_tag"),
        *KEY, "sentence", "class_code",
        resp.alias("model_response"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stub logits per test row: u(101..103, key) - 0.5."""
    s = sentences(spark, sf_dir).where(F.col("split") == "test")
    k = sentence_key()
    arr = F.array(*[unit_hash(101 + j, k) - F.lit(0.5) for j in range(3)])
    return s.select(*KEY, "sentence", "class_code", arr.alias("logits"))


def _token_array_rows(s: DataFrame, toks, seed: int, *keep: str) -> DataFrame:
    """(keys..., toks, scores): one row per sentence."""
    scores = F.transform("toks", lambda _, i: unit_hash(seed, F.concat(sentence_key(), F.lit("-"), i.cast("string"))) - F.lit(0.5))
    return s.select(*KEY, *keep, toks.alias("toks")).withColumn("scores", scores)


def _token_rows(arrays: DataFrame) -> DataFrame:
    """(keys..., pos, token, score): one row per token."""
    x = arrays.select(*KEY, F.posexplode(F.arrays_zip("toks", "scores")).alias("pos", "_t"))
    return x.select(*KEY, "pos", F.col("_t.toks").alias("token"), F.col("_t.scores").alias("score"))


def bpe_arrays(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Byte-pair style pieces of the test sentences, one row per sentence.

    Each space-split word is cut into its first 5 characters and the rest;
    word starts but the first carry 'Ġ'; wrapped in '<s>' ... '</s>'.
    """
    s = sentences(spark, sf_dir).where(F.col("split") == "test")
    w = words(F.col("sentence"))
    pieces = F.flatten(F.transform(w, lambda x, i: F.when(
        F.length(x) > 5,
        F.array(F.concat(F.when(i > 0, F.lit("Ġ")).otherwise(F.lit("")), F.substring(x, 1, 5)), F.substring(x, 6, 1 << 30)),
    ).otherwise(F.array(F.concat(F.when(i > 0, F.lit("Ġ")).otherwise(F.lit("")), x)))))
    return _token_array_rows(s, F.concat(F.array(F.lit("<s>")), pieces, F.array(F.lit("</s>"))), 301, *keep)


def bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bpe_arrays`` with one row per piece."""
    return _token_rows(bpe_arrays(spark, sf_dir))


def wordpiece_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece style: the rest of a long word is a '##' continuation."""
    s = sentences(spark, sf_dir).where(F.col("split") == "test")
    w = words(F.col("sentence"))
    pieces = F.flatten(F.transform(w, lambda x: F.when(
        F.length(x) > 5, F.array(F.substring(x, 1, 5), F.concat(F.lit("##"), F.substring(x, 6, 1 << 30))),
    ).otherwise(F.array(x))))
    return _token_array_rows(s, pieces, 302)


def symbol_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols ( ) $ € " ' % - as tokens of their own, other runs between."""
    s = sentences(spark, sf_dir).where(F.col("split") == "test")
    return _token_array_rows(s, F.regexp_extract_all(F.col("sentence"), F.lit(SYMBOL_TOKEN), 0), 303)


def grad_tokens(spark: SparkSession, sf_dir: str, dim: int = 4) -> DataFrame:
    """BPE pieces with stub gradient and input vectors of ``dim`` values."""
    t = bpe_tokens(spark, sf_dir)
    tkey = F.concat(sentence_key(), F.lit("-"), F.col("pos").cast("string"))
    g = F.array(*[unit_hash(401 + j, tkey) - F.lit(0.5) for j in range(dim)])
    x = F.array(*[unit_hash(411 + j, tkey) - F.lit(0.5) for j in range(dim)])
    return t.select(*KEY, "pos", "token", g.alias("grad"), x.alias("input"))


def coef(spark: SparkSession, vocab: DataFrame):
    """Fixed linear weights over a vocabulary: u(201 + label, term) - 0.5.

    Returns (coef(term, label, weight), bias(label, bias)).
    """
    c = vocab.select("term", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("label"))
    c = c.withColumn("weight", unit_hash(F.lit(201) + F.col("label"), F.col("term")) - F.lit(0.5))
    bias = spark.range(3).select(F.col("id").cast("int").alias("label"), F.lit(COEF_BIAS).alias("bias"))
    return c, bias
