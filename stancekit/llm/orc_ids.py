"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on the id.

Rows are laid out in ascending document order over the files, so a stripe's
minimum and maximum prune ranges, and the Bloom filters of the row groups prune
single documents. Stripes are the unit of parallel reads.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stancekit.llm.encoder import encoder

OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.fpp": "0.01",
}


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
              tokenizer: str = "word_bpe_49k.json", end_id: int = 2, partitions: int | None = None,
              options: dict[str, str] | None = None) -> None:
    """Encode texts, append ``end_id`` and write (id, part, pos, ids) in ascending id order.

    Texts are dealt by id range first and encoded behind that exchange, so each is
    encoded once. Null texts are empty, null ids come first, equal ids stay rows of
    their own in the order of their texts' hashes. ``part`` is the file's place in the order, ``pos``
    the row's in the file. An empty table writes no rows; columns beside the id and the text
    play no part; an id column with the name of one of the file's own columns raises.
    """
    if id_col in ("part", "pos", "ids"):
        raise ValueError(f"the file has a column {id_col} of its own")
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    x = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    x = x.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                flat, offs = enc.ids(part.column("text"))
                rows = np.arange(len(offs) - 1)
                ids = np.insert(flat.astype(np.int32), offs[1:], np.int32(end_id))
                ends = offs + np.append(0, rows + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], ["id", "ids"])

    out = x.mapInArrow(run, f"id {kind}, ids array<int>").select(
        F.col("id").alias(id_col), F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"), "ids")
    w = out.write.options(**(OPTIONS | (options or {}))).option("orc.bloom.filter.columns", id_col)
    w.orc(path)


def read_ids(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The rows, or those that ``where`` on the id keeps: the filter reaches the ORC
    reader, which skips stripes by their statistics and row groups by index and Bloom filter."""
    x = spark.read.orc(path)
    return x if where is None else x.where(where)


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, part, pos, n_tokens and ids_crc32 (little-endian unsigned 32-bit) of each row read."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("ids")
            offs = np.asarray(col.offsets)
            flat = memoryview(np.ascontiguousarray(np.asarray(col.values), dtype="<i4")).cast("B")
            crc = [zlib.crc32(flat[4 * a:4 * b]) for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("part"), batch.column("pos"), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())],
                [id_col, "part", "pos", "n_tokens", "ids_crc32"])

    return rows.select(id_col, "part", "pos", "ids").mapInArrow(
        run, f"`{id_col}` {kind}, part int, pos bigint, n_tokens bigint, ids_crc32 bigint")


def with_start(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """start: ids of all rows before this one in the files. A running sum inside each file, whose size the
    writer bounds, plus the totals of the files before it (one row per file)."""
    inside = Window.partitionBy("part").orderBy("pos")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy("part").agg(F.sum("n_tokens").alias("t")).select(
        "part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    run = rows.withColumn("run", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return run.join(F.broadcast(total), "part").select(
        id_col, (F.col("base") + F.col("run") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
