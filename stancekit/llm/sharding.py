"""Hilbert-curve sharding: metadata is quantised, rows are sorted by curve index, runs are cut.

Each dimension gets 2**bits cells of about equal counts: numbers by quantile sketches over all
rows, strings by exact counts of all their values, compared whole. Rows in one cell lie together on the curve, so
a shard covers a compact box of every dimension and a reader can skip shards by
their minima and maxima. The law is ``rows``: shard sizes differ by one row at most.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancekit.llm import common as C
from stancekit.operators.windows import global_index

BITS = 5


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of points (rows x dimensions of cell numbers below 2**bits).

    Axes are turned into the transposed index from the highest bit down
    (inverse undo of the excess rotations, then a Gray code), and its bits interleaved.
    """
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(dims):
            on = (x[i] & np.uint64(q)) > 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(len(cells), np.uint64), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & np.uint64(q)) > 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def number_cuts(df: DataFrame, names: list[str], bits: int) -> list[list[float]]:
    """Cut points of each numeric column: quantile sketches, of bounded size, over all rows."""
    share = [k / (1 << bits) for k in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(F.col(n).cast("double"), share, 10000).alias(f"c{k}") for k, n in enumerate(names)]).first()
    return [sorted(set(c or [])) for c in row]


def string_cuts(df: DataFrame, name: str, bits: int, partitions: int | None = None) -> list[str]:
    """Cut points of a string column, at most 2**bits: a value starts a cell if it is the first whose
    smaller rows fill another 1 / 2**bits of all. Exact: values are counted, ranged over partitions
    and their counts summed up in order; only the cuts come to the driver."""
    cells = 1 << bits
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    laid = C.written(values.repartitionByRange(p, "value").withColumn("part", F.spark_partition_id()), "value-counts")
    ends = Window.orderBy("part")                               # one row a partition
    parts = laid.groupBy("part").agg(F.sum("n").alias("t")).select(
        "part", (F.sum("t").over(ends) - F.col("t")).alias("base"), F.sum("t").over(Window.partitionBy()).alias("all"))
    run = F.sum("n").over(Window.partitionBy("part").orderBy("value"))
    before = laid.withColumn("before", run - F.col("n")).join(F.broadcast(parts), "part")
    firsts = before.groupBy(F.floor((F.col("base") + F.col("before")) * cells / F.col("all")).alias("cell")).agg(F.min("value").alias("value"))
    return sorted(r["value"] for r in firsts.collect())[1:]     # nothing lies below the first


def curve_index(df: DataFrame, dims: list[str], bits: int = BITS, out: str = "curve") -> DataFrame:
    """Adds the Hilbert index of ``dims``, as ``out``; all columns stay, whatever their names.

    A cell is the number of cuts at or below the value; null takes cell 0, an empty string is a value.
    A column without values has one cell; an empty table stays empty.
    """
    strings = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    numbers = [d for d in dims if d not in strings]
    edges = dict(zip(numbers, number_cuts(df, numbers, bits) if numbers else []))
    edges |= {d: string_cuts(df, d, bits) for d in strings}

    def cell(d: str) -> Column:
        x = F.col(d) if d in strings else F.col(d).cast("double")
        return F.coalesce(reduce(lambda a, e: a + (x >= F.lit(e)).cast("int"), edges[d], F.lit(0)), F.lit(0))

    @F.arrow_udf("long")
    def index(*cells: pa.Array) -> pa.Array:
        return pa.array(hilbert(np.stack([np.asarray(c) for c in cells], 1), bits))

    return df.withColumn(out, index(*[cell(d) for d in dims]))


def assign(docs: DataFrame, dims: list[str], shards: int = 16, bits: int = BITS, id_col: str = "doc_id",
           text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """id, size (UTF-8 bytes + 1; null text: 1), text_crc32, curve, shard, slot for every row.

    Order: curve index, then text checksum (so copies in a cell stay together), then
    id; nulls first. Repeated rows are rows of their own. Texts are read once; what is
    sorted is a narrow table, ranged over partitions, so no key is hot.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    extra = [d for d in dims if d not in (id_col, "size")]
    base = C.written(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                                 F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), *[F.col(d).alias(f"d_{d}") for d in extra]), "shard-base")
    named = [{id_col: "id", "size": "size"}.get(d, f"d_{d}") for d in dims]
    placed = C.written(curve_index(base, named, bits).select("id", "size", "text_crc32", "curve"), "shard-curve")
    n = placed.count()
    ranked = global_index(placed, ["curve", "text_crc32", "id"], partitions, out="rank")
    small, more = divmod(n, shards)
    edge = more * (small + 1)
    r = F.col("rank")
    shard = F.when(r < edge, F.floor(r / (small + 1))).otherwise(more + F.floor((r - edge) / max(1, small))).cast("int")
    start = F.when(F.col("shard") < more, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - more) * small)
    return (ranked.withColumn("shard", shard).withColumn("slot", (r - start).cast("long"))
            .select(F.col("id").alias(id_col), "size", "text_crc32", "curve", "shard", "slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Documents as Parquet, one folder a shard, in slot order within each file."""
    (docs.join(assigned.select(id_col, "shard", "slot"), id_col)
     .repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def manifest(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Per shard the row count and each dimension's minimum and maximum: a small table a reader prunes by."""
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))])


def prune(table: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """The shards of a manifest whose boxes meet all the given (low, high) ranges."""
    for d, (low, high) in ranges.items():
        table = table.where((F.col(f"max_{d}") >= F.lit(low)) & (F.col(f"min_{d}") <= F.lit(high)))
    return table
