"""DataFrame-level label encoding and row filters."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancekit.functions.labels import explained_classes


def filter_positive(df: DataFrame, code_col: str = "class_code") -> DataFrame:
    """Rows whose class is not 0."""
    return df.where(F.col(code_col) != 0)


def fit_classes(df: DataFrame, ids_col: str = "ids", most: int = 10000) -> list[int]:
    """Sorted class set seen in the data; raises beyond ``most`` classes."""
    found = df.select(F.explode(ids_col).alias("c")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} classes")
    return sorted(r[0] for r in found)


def binarize(df: DataFrame, classes: list[int], ids_col: str = "ids", out: str = "vec") -> DataFrame:
    """Encode id lists with a class set learned elsewhere (e.g. on train)."""
    vec = F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.array_contains(F.col(ids_col), c).cast("int"))
    return df.withColumn(out, vec)


def explode_explained(df: DataFrame, vec_col: str = "pred_vec", out: str = "class_id") -> DataFrame:
    """One row per class to explain; rows with an empty prediction vanish."""
    return df.withColumn(out, F.explode(explained_classes(F.col(vec_col))))
