"""Sampling, splitting and upsampling with a portable seeded hash.

No operator here collects rows: splits are per-row predicates, exact splits
find their cut from a bounded hash histogram, per-class samples use a
limited window (Spark plans a partial WindowGroupLimit before the shuffle,
so a class holding most rows never lands whole in one task).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancekit.functions.hashing import portable_hash, sentence_key, unit_hash
from stancekit.functions.text import word_count

KEY = ["speech_id", "sent_idx"]
# --- fixed values ---
CLASS_SHARES = [0.92, 0.04, 0.02, 0.02]  # share of each class code 0..3
# --- end of fixed values ---


def _row_key(keys) -> Column:
    keys = list(keys)
    if keys == KEY:
        return sentence_key()
    if len(keys) == 1:
        return F.col(keys[0]).cast("string")
    return F.concat_ws("-", *[F.col(k).cast("string") for k in keys])


def upsample_minority(df: DataFrame, ratio: int = 5, code_col: str = "class_code") -> DataFrame:
    """All rows plus ``ratio`` more copies of each row whose class is not 0.

    One narrow pass (explode of a per-row sequence); ``copy_no`` 0 is the
    original row.
    """
    n = F.when(F.col(code_col) != 0, F.lit(ratio)).otherwise(F.lit(0))
    return df.select("*", F.explode(F.sequence(F.lit(0), n)).alias("copy_no"))


def upsample_weights(df: DataFrame, ratio: int = 5, code_col: str = "class_code",
                     out: str = "copies") -> DataFrame:
    """Same multiset as ``upsample_minority`` as a count column (no new rows)."""
    return df.withColumn(out, F.when(F.col(code_col) != 0, F.lit(1 + ratio)).otherwise(F.lit(1)))


def concat_datasets(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def train_test_split(df: DataFrame, test_size: float = 0.2, keys=KEY, seed: int = 42,
                     group: str | None = None, out: str = "split") -> DataFrame:
    """Random split by hash: stable under append, no shuffle.

    With ``group`` every row of one group lands on the same side.
    """
    by = F.col(group).cast("string") if group else _row_key(keys)
    return df.withColumn(out, F.when(unit_hash(seed, by) < test_size, "test").otherwise("train"))


def train_test_split_exact(df: DataFrame, test_size: float = 0.2, keys=KEY, seed: int = 42,
                           out: str = "split", bucket_bits: int = 16) -> DataFrame:
    """Exactly ceil(test_size * n) rows go to test: those first by (hash, key).

    Instead of a global sort, a histogram over the top ``bucket_bits`` of the
    hash (bounded: 2**bucket_bits rows) locates the boundary bucket; only that
    bucket is ranked.
    """
    from stancekit.session import materialize

    keys = list(keys)
    shift = 32 - bucket_bits
    # the keys with their hash, written once: the histogram, the count and the rows read this narrow table
    h = materialize(df.select(*keys, portable_hash(seed, _row_key(keys)).alias("_h")), "split-keys")
    h = h.withColumn("_b", F.shiftright(F.col("_h"), shift))
    hist = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    # bounded frame (<= 2**bucket_bits rows): a global running sum is cheap
    order = Window.orderBy("_b")
    cum = hist.select("_b", "_c", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"),
                      F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    cut = cum.withColumn("_k", F.ceil(F.lit(test_size) * F.col("_n"))).where(F.col("_cum") >= F.col("_k")).orderBy("_b").limit(1)
    edge = cut.select("_b", (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("_need")).first()   # one row
    if edge is None:
        return df.withColumn(out, F.lit("train"))
    rn = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *keys))
    at_edge = h.where(F.col("_b") == edge["_b"]).withColumn("_rn", rn).where(F.col("_rn") <= edge["_need"]).select(*keys)
    mine = F.shiftright(portable_hash(seed, _row_key(keys)), shift)
    # one bucket of 2**bucket_bits: about rows / 2**bucket_bits keys
    marked = df.join(at_edge.withColumn("_in", F.lit(True)), keys, "left")
    return marked.withColumn(out, F.when((mine < edge["_b"]) | F.col("_in"), "test").otherwise("train")).drop("_in")


def seeded_shuffle(df: DataFrame, seed: int = 42, keys=KEY, out: str = "shuffle_hash") -> DataFrame:
    """Deterministic permutation: range-partitioned sort by (hash, key)."""
    return df.withColumn(out, portable_hash(seed, _row_key(keys))).orderBy(out, *keys)


def word_band(df: DataFrame, lo: int = 9, hi: int = 31, text_col: str = "sentence") -> DataFrame:
    return df.where(word_count(F.col(text_col)).between(lo, hi))


def kshot_sample(df: DataFrame, k: int, seed: int = 42, order: str = "hash", keys=KEY,
                 code_col: str = "class_code", n_classes: int = 4, lo: int = 9, hi: int = 31,
                 strict: bool = True) -> DataFrame:
    """k // n_classes rows per class from the word band, then mixed.

    ``order='hash'`` takes the first rows of a seeded shuffle per class,
    ``order='source'`` the first rows in key order. ``mix_hash`` gives the
    mixed order of the shots. A class with too few rows raises; ``strict=False``
    takes what there is.
    """
    keys = list(keys)
    per = k // n_classes
    band = word_band(df, lo, hi)
    sort = [portable_hash(seed, _row_key(keys)), *keys] if order == "hash" else keys
    rn = F.row_number().over(Window.partitionBy(code_col).orderBy(*sort))
    shots = band.withColumn("_rn", rn).where(F.col("_rn") <= per).drop("_rn")
    shots = shots.withColumn("mix_hash", portable_hash(f"mix{seed}", _row_key(keys)))
    if strict:
        got = {r[0]: r[1] for r in shots.groupBy(code_col).count().collect()}  # <= n_classes rows
        short = [c for c in range(n_classes) if got.get(c, 0) < per]
        if short:
            raise ValueError(f"classes {short} have fewer than {per} rows in the word band")
    return shots


def random_baseline(df: DataFrame, weights=CLASS_SHARES, seed: int = 0, keys=KEY,
                    out: str = "pred_code") -> DataFrame:
    """Class drawn with the given weights from a seeded per-row uniform."""
    u = unit_hash(seed, _row_key(keys))
    expr = None
    acc = 0.0
    for code, w in enumerate(weights[:-1]):
        acc += w
        expr = (F.when(u < acc, code) if expr is None else expr.when(u < acc, code))
    expr = expr.otherwise(len(weights) - 1)
    return df.withColumn(out, expr)


def log_sample(df: DataFrame, n: int = 3, seed: int = 42, keys=KEY) -> DataFrame:
    """n rows picked by seeded hash (a top-n, not a sort of everything)."""
    keys = list(keys)
    h = portable_hash(seed, _row_key(keys))
    return df.withColumn("sample_hash", h).orderBy("sample_hash", *keys).limit(n)


def limit_samples(df: DataFrame, n: int, order=KEY) -> DataFrame:
    """First min(n, rows) rows in key order."""
    return df.orderBy(*order).limit(n)


def head_sample(df: DataFrame, n: int = 10, order=KEY) -> DataFrame:
    return limit_samples(df, n, order)


def class_distribution(df: DataFrame, code_col: str = "class_code") -> DataFrame:
    """Rows and share per class (map-side combined count)."""
    counts = df.groupBy(code_col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)

