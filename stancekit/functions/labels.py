"""Label encodings: class codes, id lists, multi-hot vectors, fused codes.

Class codes: 0 = none, 1 = anti-elitism, 2 = people-centrism, 3 = both.
Label ids (multi-label space of size 3): 0 = none, 1 = anti-elitism, 2 = people-centrism.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the studied code's for identical results) ---
LETTERS = ["a", "b", "c", "d"]
FULL_LABELS = [
    "(a) No populism",
    "(b) Anti-elitism",
    "(c) People-centrism",
    "(d) Both people-centrism and anti-elitism",
]
# letter -> multi-hot vector
LETTER_VECTORS = {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1], "d": [0, 1, 1]}
# report names of the three label ids
REPORT_NAMES = ["None", "Elite", "People"]
# --- end of fixed values ---

N_LABELS = 3


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def label_ids(code, fold4: bool = False) -> Column:
    """Class code -> label id list. 3 (and 4 when ``fold4``) becomes [1, 2]."""
    c = _c(code)
    both = c.isin(3, 4) if fold4 else (c == 3)
    return (
        F.when(both, F.array(F.lit(1), F.lit(2)))
        .when(c.between(0, 2), F.array(c.cast("int")))
        .otherwise(F.lit(None).cast("array<int>"))
    )


def multi_hot(ids, k: int = N_LABELS) -> Column:
    """Label id list -> 0/1 vector of length k."""
    i = _c(ids)
    return F.transform(
        F.array(*[F.lit(j) for j in range(k)]),
        lambda j: F.array_contains(i, j).cast("int"),
    )


def hot_to_ids(vec) -> Column:
    """0/1 vector -> ascending id list of the set positions."""
    return F.filter(
        F.transform(_c(vec), lambda x, i: F.when(x == 1, i)),
        lambda x: x.isNotNull(),
    )


def hot_to_ids_nested(vecs) -> Column:
    """Array of 0/1 vectors -> array of id lists."""
    return F.transform(
        _c(vecs),
        lambda v: F.filter(F.transform(v, lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull()),
    )


def fuse_code(vec) -> Column:
    """Multi-hot vector -> fused code.

    100->0, 010->1, 001->2, 011->3, first bit with any other -> 4, 000->5.
    """
    v = _c(vec)
    b0, b1, b2 = F.get(v, 0), F.get(v, 1), F.get(v, 2)
    return (
        F.when((b0 == 1) & (b1 == 0) & (b2 == 0), 0)
        .when((b0 == 0) & (b1 == 1) & (b2 == 0), 1)
        .when((b0 == 0) & (b1 == 0) & (b2 == 1), 2)
        .when((b0 == 0) & (b1 == 1) & (b2 == 1), 3)
        .when(b0 == 1, 4)
        .otherwise(5)
    )


def explained_classes(vec) -> Column:
    """Classes to explain for a thresholded prediction: the set bits.

    Code 3 gives {1, 2}, code 4 all set bits, code 5 (empty) nothing,
    any single-label code itself -- all of which are the set positions.
    """
    return hot_to_ids(vec)


def letter(code) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LETTERS]), _c(code).cast("int"))


def full_label(code) -> Column:
    return F.get(F.array(*[F.lit(x) for x in FULL_LABELS]), _c(code).cast("int"))


def letter_vector(s) -> Column:
    """Letter a..d, or a class name with or without its letter, -> multi-hot vector
    (case and outer spaces do not matter; null for anything else)."""
    c = F.lower(F.trim(_c(s)))
    expr = F.when(F.lit(False), F.lit(None).cast("array<int>"))
    for (k, v), full in zip(LETTER_VECTORS.items(), FULL_LABELS):
        name = full.lower()
        expr = expr.when(c.isin(k, f"({k})", name, name.split(") ", 1)[1]), F.array(*[F.lit(x) for x in v]))
    return expr


def binary_gold(code) -> Column:
    """Any class but 0 becomes 1."""
    return (_c(code) != 0).cast("int")


def binary_gold_nested(codes) -> Column:
    return F.transform(_c(codes), lambda x: (x != 0).cast("int"))


def threshold_logits(logits) -> Column:
    """Strictly positive logit -> 1, else 0."""
    return F.transform(_c(logits), lambda x: (x > 0).cast("int"))
