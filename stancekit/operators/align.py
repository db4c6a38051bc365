"""Align a prediction file with gold rows by position and text."""
from __future__ import annotations

from pyspark.sql import DataFrame


def align_predictions(pred: DataFrame, gold: DataFrame, on=("idx", "text")) -> DataFrame:
    """Prediction line i meets gold row i; kept only where the texts agree."""
    return pred.join(gold, list(on))


def align_mismatch(pred: DataFrame, gold: DataFrame, on=("idx", "text")) -> DataFrame:
    """Prediction lines the text rule drops."""
    return pred.join(gold, list(on), "left_anti")
