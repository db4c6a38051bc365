"""Scoring that survives a broken run, and scoring in batches of like length.

A long audit is cut into commits by a hash of the row key. Each commit is one parallel job that writes a
folder of its own below ``path``; the folder counts once its ``_SUCCESS`` mark is there, which is
the last thing the writer does. A restarted run reads the marked folders, leaves out the rows they hold and scores the
rest, so no row is scored twice and at most one commit's work is lost.

Within a task prompts are sorted by length over a window of rows and cut into batches, so a model
pads little; answers go back to their rows. Windows bound what a task holds.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancekit.functions.answers import ANSWER_OPENING
from stancekit.operators.annotate import scored

WINDOW = 4096      # rows sorted by length at once
MARK = "_SUCCESS"


def by_length(prompts: list, batch_size: int) -> Iterator[list[int]]:
    """Positions in batches of at most ``batch_size``, by length (ties: in order; null is shortest)."""
    order = sorted(range(len(prompts)), key=lambda i: len(prompts[i] or ""))
    for lo in range(0, len(order), batch_size):
        yield order[lo:lo + batch_size]


def annotate_batched(df: DataFrame, scorer_factory: Callable, prompt: str = "prompt", batch_size: int = 32,
                     max_units: int = 2, opening: str = ANSWER_OPENING, window: int = WINDOW, **kwargs) -> DataFrame:
    """``annotate`` in batches of ``batch_size`` prompts of like length; ``kwargs`` go to the factory,
    which is called once a task. Adds ``model_response`` and ``error``; rows keep their order.

    A batch that raises is asked again row by row. Null prompts are given to the scorer as None.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("model_response", T.StringType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory(**kwargs)
        for frame in frames:
            for lo in range(0, len(frame), window):
                part = frame.iloc[lo:lo + window]
                prompts = [p if isinstance(p, str) else None for p in part[prompt].tolist()]
                answers: list = [None] * len(prompts)
                for places in by_length(prompts, batch_size):
                    for i, a in zip(places, scored(scorer, [prompts[i] for i in places])):
                        answers[i] = a
                bad = [isinstance(a, Exception) for a in answers]
                yield part.assign(
                    model_response=pd.Series([None if b else opening + " ".join(str(a).split(" ")[:max_units]) for a, b in zip(answers, bad)], dtype="object", index=part.index),
                    error=pd.Series([f"{type(a).__name__}: {a}" if b else None for a, b in zip(answers, bad)], dtype="object", index=part.index))

    return df.mapInPandas(run, schema)


def committed(spark, path: str) -> list[str]:
    """The folders below ``path`` whose write came to its end."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    out = []
    for status in fs.listStatus(root):
        folder = status.getPath()
        if status.isDirectory() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, MARK)):
            out.append(folder.toString())
    return sorted(out)


def answers(spark, path: str, schema: T.StructType) -> DataFrame:
    """All committed answers (none: an empty table of the schema)."""
    folders = committed(spark, path)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def annotate_resumable(df: DataFrame, scorer_factory: Callable, path: str, keys=("speech_id", "sent_idx"), commits: int = 16,
                       most: int | None = None, retry_failed: bool = False, **options) -> DataFrame:
    """Scores what ``path`` does not hold yet, commit by commit, and returns the answers of all rows of ``df``.

    ``keys`` name a row; rows that share a key are scored, committed and left out together, rows with a null key are
    refused. ``commits`` is how often a full run stops to make its answers durable; ``most`` ends this call after so many commits (the
    rest stays open, and only answered rows are returned). ``retry_failed``: rows that hold an error are open again, and
    their last answer replaces it. ``options`` are those of ``annotate_batched``. The schema of ``df`` must not change between calls.
    """
    spark, keys = df.sparkSession, list(keys)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields] + [
        T.StructField("model_response", T.StringType()), T.StructField("error", T.StringType())])
    if not df.where(" or ".join(f"`{k}` is null" for k in keys)).isEmpty():
        raise ValueError("a row without its key cannot be found again")

    def known() -> DataFrame:
        held = answers(spark, path, schema)
        return held if not retry_failed else held.where("error is null")

    bucket = F.pmod(F.xxhash64(*keys), F.lit(commits))
    done = 0
    for k in range(commits):
        if most is not None and done >= most:
            break
        todo = df.where(bucket == k).join(known().where(bucket == k).select(*keys).distinct(), keys, "left_anti")
        if todo.isEmpty():
            continue
        annotate_batched(todo, scorer_factory, **options).write.parquet(f"{path.rstrip('/')}/commit-{k:05d}-{uuid.uuid4().hex[:12]}")
        done += 1
    held = answers(spark, path, schema)
    good = held.where("error is null")
    bad = held.where("error is not null").join(good.select(*keys).distinct(), keys, "left_anti")
    if retry_failed:
        bad = bad.dropDuplicates(keys)
    return good.unionByName(bad).join(df.select(*keys).distinct(), keys, "left_semi").select(*schema.names)
