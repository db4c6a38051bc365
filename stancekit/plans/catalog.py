"""Query catalog: one Spark plan per operator, each with its DuckDB oracle.

Every query reads the supplied tables (or views Spark derives from them)
whole. Outputs are flattened for comparison: integers as BIGINT, doubles
rounded to 6 digits, arrays rendered as strings.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def normalize(df: DataFrame) -> DataFrame:
    """Integers to BIGINT, floats to DOUBLE rounded to 6 digits."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from stancekit.plans import (  # noqa: F401
        q_attribution, q_core, q_features, q_io, q_prompts, q_resume, q_retrieval, q_windows,
    )


def QUERIES_LOADED() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return QUERIES
