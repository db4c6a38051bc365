"""File formats: corpus by split, JSONL answers, TSV prediction files, reports.

Paths may be any Hadoop-compatible location; in a cluster use the shared
folder named by ``spark.checkpoint.dir`` (see ``session.scratch_path``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stancekit.functions import labels as L
from stancekit.functions.text import tsv_text

RESPONSE_SCHEMA = ("speech_id string, sent_idx int, sentence string, class_code int, "
                   "model_response string, _corrupt_record string")
POSITION_SCHEMA = "idx long, run_tag string, source string, text string, code int"
LIST_SCHEMA = "idx long, predictions string, labels string"
TSV = {"sep": "\t", "header": True, "quote": "", "escape": ""}
TSV_WRITE = {**TSV, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_corpus(df: DataFrame, path: str) -> None:
    """Corpus partitioned on disk by ``split`` (so reads of one split prune)."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One named split; the predicate prunes the other split's folders."""
    return spark.read.parquet(path).where(F.col("split") == split)


def write_responses(df: DataFrame, path: str) -> None:
    """Input columns plus the answer as JSON lines, one folder per run."""
    df.write.mode("overwrite").partitionBy("run_tag").json(path)


def read_responses(spark: SparkSession, path: str, schema: str = RESPONSE_SCHEMA) -> DataFrame:
    """JSON lines with a fixed schema; malformed lines land in ``_corrupt_record``."""
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def write_position_tsv(df: DataFrame, path: str, idx: str = "idx", run: str = "run_tag",
                       source: str = "source", text: str = "text", code: str = "code") -> None:
    """Headed TSV: index, run, source, text (tabs/line breaks as spaces), code."""
    out = df.select(F.col(idx).cast("long").alias("idx"), F.col(run).alias("run_tag"), F.col(source).alias("source"),
                    tsv_text(F.col(text)).alias("text"), F.col(code).cast("int").alias("code"))
    out.write.mode("overwrite").options(**TSV_WRITE).csv(path)


def read_position_tsv(spark: SparkSession, path: str, index: str = "column") -> DataFrame:
    """Text from column 3, label from column 4 (0-based); quoting off, so a
    leading '\"' stays part of the text.

    ``index='column'`` takes the line index from column 0; ``'line'`` counts the lines
    below the header, in the order of the files' names, whatever column 0 holds.
    """
    if index == "column":
        return spark.read.schema(POSITION_SCHEMA).options(**TSV).csv(path)
    if index != "line":
        raise ValueError("index is 'column' or 'line'")
    lines = numbered_lines(spark, path).where(F.col("line") > 0)
    row = F.from_csv("value", POSITION_SCHEMA.replace("idx long", "first string"), {"sep": "\t", "quote": "", "escape": ""})
    x = lines.select("file", "line", row.alias("r"))
    per_file = x.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    # one row per file
    base = per_file.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return x.join(F.broadcast(base), "file").select(
        (F.col("base") + F.col("line") - 1).alias("idx"), "r.run_tag", "r.source", "r.text", "r.code")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) with ``line`` from 0 in each file.

    Each reader task stamps its lines; the starts of the file splits (a table of
    one row per split) turn the stamps into line numbers, so no file passes through one task.
    """
    from stancekit.session import materialize

    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                     F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("stamp"))
    t = materialize(t, "lines")
    splits = t.groupBy("file", "split").agg(F.min("stamp").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return t.join(starts, ["file", "split"]).select("file", (F.col("start") + F.col("stamp") - F.col("first")).alias("line"), "value")


def read_relabel_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Second gold source: code 3 becomes [1, 2]; adds ``gold_vec``."""
    r = read_position_tsv(spark, path)
    return r.withColumn("gold_ids", L.label_ids(F.col("code"))).withColumn("gold_vec", L.multi_hot(F.col("gold_ids")))


def list_literal(ids, depth: int = 1) -> F.Column:
    """array<int> -> '[1, 2]'; ``depth=2``: array<array<int>> -> '[[1, 2], [0]]'."""
    item = (lambda x: x.cast("string")) if depth == 1 else (lambda x: list_literal(x, depth - 1))
    col = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(F.lit("["), F.array_join(F.transform(col, item), ", "), F.lit("]"))


def _depth(df: DataFrame, name: str) -> int:
    return df.schema[name].dataType.simpleString().count("array<")


def write_list_predictions(df: DataFrame, path: str, idx: str = "idx", pred: str = "pred_ids",
                           gold: str = "gold_ids") -> None:
    """Header 'index, predictions, labels'; lists written as literals: id lists,
    one 0/1 per paragraph, or a list of id lists per paragraph."""
    out = df.select(F.col(idx).cast("long").alias("index"), list_literal(pred, _depth(df, pred)).alias("predictions"),
                    list_literal(gold, _depth(df, gold)).alias("labels"))
    out.write.mode("overwrite").options(**TSV_WRITE).csv(path)


def read_list_predictions(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """Parse '[1, 2]' (``nested``: '[[1, 2], [0]]') literals with from_json ('[]' gives an empty list)."""
    kind = "array<array<int>>" if nested else "array<int>"
    r = spark.read.schema(LIST_SCHEMA).options(**TSV).csv(path)
    return r.select("idx", F.from_json("predictions", kind).alias("pred_ids"), F.from_json("labels", kind).alias("gold_ids"))


METRICS_SCHEMA = "split string, n_samples long, row_no long, label string, precision double, recall double, f1 double, support long"


def write_metrics(report: DataFrame, path: str, split: str | None = None, counts: DataFrame | None = None) -> None:
    """The report rows as JSON; with ``split`` and ``counts`` (split, n_samples) every row names
    the evaluated split and its number of samples."""
    if split is not None:
        report = report.withColumn("split", F.lit(split))
        if counts is not None:
            report = report.join(F.broadcast(counts.where(F.col("split") == split)), "split", "left")   # one row
    report.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str, splits: bool = False) -> DataFrame:
    r = spark.read.schema(METRICS_SCHEMA).json(path)
    return r if splits else r.drop("split", "n_samples")


def write_relevance(df: DataFrame, path: str, by: str = "class_id") -> None:
    """Relevance rows as Parquet, one folder per explained class."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def relevance_rows(tokens: DataFrame, explained: DataFrame, keys=("speech_id", "sent_idx"), word: str = "term",
                   score: str = "relevance") -> DataFrame:
    """One row per (row, explained class): tokens and scores as aligned arrays (by word), with the
    prediction, gold code and logits that ``explained`` (keys..., class_id, pred_vec, gold, logits) carries.
    ``tokens`` has a word a row, or (``terms`` and ``score``) aligned arrays of them: then only whole rows are grouped.
    A class without any known token has empty arrays. A row's tokens are bounded by its text."""
    keys = list(keys)
    entry = lambda t, s: F.struct(t.alias("t"), s.alias("s"))
    if "terms" in tokens.columns:
        entries = F.flatten(F.collect_list(F.zip_with("terms", score, entry)))
    else:
        entries = F.collect_list(entry(F.col(word), F.col(score)))
    g = tokens.groupBy(*keys, "class_id").agg(F.sort_array(entries).alias("_e"))
    empty = F.array().cast(g.schema["_e"].dataType)
    j = explained.join(g, [*keys, "class_id"], "left").withColumn("_e", F.coalesce("_e", empty))
    return j.select(*keys, "class_id", F.transform("_e", lambda e: e["t"]).alias("tokens"),
                    F.transform("_e", lambda e: e["s"]).alias("scores"), "pred_vec", "gold", "logits")
