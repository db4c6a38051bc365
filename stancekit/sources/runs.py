"""Run names: model short name plus option parts."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def run_tag(model, lora=False, dist=False, prior=False, rag=False, k=0, seed=42) -> Column:
    """'<short model>[_lora][_dist][_use_prior][_rag]_k_<k>_seed_<seed>'.

    Every argument may be a literal or a Column.
    """
    short = F.element_at(F.split(_lit(model), "/"), -1)
    parts = [short]
    for flag, suffix in ((lora, "_lora"), (dist, "_dist"), (prior, "_use_prior"), (rag, "_rag")):
        parts.append(F.when(_lit(flag).cast("boolean"), F.lit(suffix)).otherwise(F.lit("")))
    parts += [F.lit("_k_"), _lit(k).cast("string"), F.lit("_seed_"), _lit(seed).cast("string")]
    return F.concat(*parts)
