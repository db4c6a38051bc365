"""Five stages from raw documents to packed training sequences.

Each stage takes the documents its predecessor kept, as a table read again, and returns
documents with the same columns; the last returns packed pieces. ``run`` writes each stage
below ``spark.checkpoint.dir``, so a lost executor repeats one stage's tasks at most.
Empty tables pass through: no labels, no benchmark or no documents reject nothing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancekit.llm import common as C
from stancekit.llm import decontam, packing, quality, simhash, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more (operator 5)."""
    model = quality.fit(docs, C.table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model, F.col("text")) >= 0.5)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores below 0.5 (operator 3)."""
    model = toxicity.fit(docs, C.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model, F.col("text")) < 0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that with the smallest id (operator 8)."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (operator 7)."""
    return decontam.clean(docs, C.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids (operator 1)."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifiers and the tokenizer cannot be put in SQL; tests hold each stage against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
