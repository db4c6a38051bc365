"""Context windows over ordered sentences, safe for hot speeches.

A speech may hold a large share of all rows, so no window here is
partitioned by the speech alone. Rows are cut into blocks of ``block``
consecutive rows; each block also receives a halo (the few rows its
frames reach into the neighbouring block), so every frame is complete and
no task holds more than ``block + before + after`` rows of one speech.
Blocks and halo count rows, not positions: positions may have gaps, and no
block size changes an answer.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancekit.functions.text import words

KEY = ["speech_id", "sent_idx"]
BLOCK = 4096
# --- fixed values: window packing ---
CLS, SEP, PAD = "<cls>", "<sep>", "<pad>"
# --- end of fixed values ---


def with_halo(df: DataFrame, order: str, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Add ``_blk`` and ``_halo``: each row once in its own block (``_halo``
    false) and once in every other block whose frames reach it: rows up to
    ``before`` positions later or ``after`` positions earlier."""
    o = F.col(order)
    own = F.floor(o / block).cast("long")
    lo = F.floor(F.greatest(o - after, F.lit(0)) / block).cast("long")
    hi = F.floor((o + before) / block).cast("long")
    x = df.select("*", F.explode(F.sequence(lo, hi)).alias("_blk"))
    return x.withColumn("_halo", F.col("_blk") != own)


def block_window(group: str, order: str) -> Window:
    return Window.partitionBy(group, "_blk").orderBy(order)


def neighbours(df: DataFrame, value: Column | str, before: int, after: int, group: str = "speech_id",
               order: str = "sent_idx", block: int = BLOCK, prev_col: str = "prev", next_col: str = "next") -> DataFrame:
    """Arrays of up to ``before`` preceding and ``after`` following values."""
    v = value if isinstance(value, Column) else F.col(value)
    x = dense_index(df.withColumn("_v", v), group, order, block, "_row")
    x = with_halo(x, "_row", before, after, block)
    w = block_window(group, "_row")
    if before > 0:
        x = x.withColumn(prev_col, F.collect_list("_v").over(w.rowsBetween(-before, -1)))
    if after > 0:
        x = x.withColumn(next_col, F.collect_list("_v").over(w.rowsBetween(1, after)))
    return x.where(~F.col("_halo")).drop("_v", "_row", "_blk", "_halo")


def prior_context(df: DataFrame, n: int = 5, group: str = "speech_id", order: str = "sent_idx",
                  text: str = "sentence", block: int = BLOCK, out: str = "context") -> DataFrame:
    """Up to n preceding sentences of the same speech, oldest first."""
    return neighbours(df, text, n, 0, group, order, block, prev_col=out)


def speech_reset(df: DataFrame, group: str = "speech_id", order: str = "sent_idx", block: int = BLOCK,
                 out: str = "is_start") -> DataFrame:
    """1 where a new speech starts (no earlier row of the same speech)."""
    x = dense_index(df, group, order, block, "_row")
    return x.withColumn(out, (F.col("_row") == 0).cast("int")).drop("_row")


def dense_index(df: DataFrame, group: str = "speech_id", order: str = "sent_idx", block: int = BLOCK,
                out: str = "row_idx") -> DataFrame:
    """0-based position by a numeric ``order`` within ``group``.

    Local row numbers per (group, block) plus the running count of the
    earlier blocks of the group (a table of rows / block entries).
    """
    o = F.col(order)
    x = df.withColumn("_blk", F.floor(o / block).cast("long"))
    x = x.withColumn("_loc", F.row_number().over(Window.partitionBy(group, "_blk").orderBy(order)) - 1)
    counts = x.groupBy(group, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy(group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (x.join(offs.select(group, "_blk", "_off"), [group, "_blk"])
            .withColumn(out, (F.col("_off") + F.col("_loc")).cast("long"))
            .drop("_blk", "_loc", "_off"))


def global_index(df: DataFrame, order: list[str], partitions: int | None = None, out: str = "row_idx") -> DataFrame:
    """0-based global position by ``order`` without a single-partition window.

    Range-partition and sort, stamp each row with its partition and local
    position, write that once to the checkpoint folder (so the stamps are
    data, fixed across retries), then add per-partition offsets from a table
    of one row per partition.
    """
    from stancekit.session import materialize

    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(p, *order).sortWithinPartitions(*order)
    laid = laid.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    laid = materialize(laid, "global-index")
    counts = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (laid.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
            .withColumn(out, (F.col("_off") + local).cast("long")).drop("_pid", "_mid", "_off"))


def row_index(df: DataFrame, group: str | None = "speech_id", order: str = "sent_idx",
              block: int = BLOCK, out: str = "row_idx") -> DataFrame:
    if group is None:
        return global_index(df, [order] if isinstance(order, str) else list(order), out=out)
    return dense_index(df, group, order, block, out)


def units(s, max_units: int) -> Column:
    return F.slice(words(s), 1, max_units)


def pack_window(df: DataFrame, before: int = 4, after: int = 4, centre: int = 64, total: int = 512,
                text: str = "sentence", group: str = "speech_id", order: str = "sent_idx",
                block: int = BLOCK) -> DataFrame:
    """Centre sentence (<= centre-1 units) padded to ``centre``, separator,
    neighbours (each <= centre-1 units), separator, cut and padded to ``total``.

    Adds ``units`` (array<string>) and ``mask`` (array<int>).
    """
    cut = centre - 1
    x = neighbours(df, units(F.col(text), cut), before, after, group, order, block, "_prev", "_next")
    c = units(F.col(text), cut)
    nb = F.concat(F.flatten(F.col("_prev")), F.flatten(F.col("_next")))
    pad_c = F.lit(centre) - F.size(c)
    seq = F.concat(F.array(F.lit(CLS)), c, F.array_repeat(F.lit(PAD), pad_c), F.array(F.lit(SEP)), nb,
                   F.array(F.lit(SEP)))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(c) + 1), F.array_repeat(F.lit(0), pad_c),
                    F.array_repeat(F.lit(1), F.size(nb) + 2))
    tail = F.greatest(F.lit(total) - F.size(seq), F.lit(0))
    seq = F.slice(F.concat(seq, F.array_repeat(F.lit(PAD), tail)), 1, total)
    mask = F.slice(F.concat(mask, F.array_repeat(F.lit(0), tail)), 1, total)
    return x.withColumn("units", seq).withColumn("mask", mask).drop("_prev", "_next")


def truncate_pad(df: DataFrame, max_len: int = 128, pad: bool = True, text: str = "sentence") -> DataFrame:
    """Cut to ``max_len`` units; pad to it (or leave ragged), with a 0/1 mask."""
    u = units(F.col(text), max_len)
    if pad:
        fill = F.lit(max_len) - F.size(u)
        return df.withColumn("units", F.concat(u, F.array_repeat(F.lit(PAD), fill))).withColumn(
            "mask", F.concat(F.array_repeat(F.lit(1), F.size(u)), F.array_repeat(F.lit(0), fill)))
    return df.withColumn("units", u).withColumn("mask", F.array_repeat(F.lit(1), F.size(u)))
