"""Shared helpers: table reading, scratch tables, Arrow string buffers, word kernels.

Python workers need the package on their path (``PYTHONPATH`` or
``--py-files``). Scratch tables go below ``spark.checkpoint.dir``.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancekit.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; ``session.scratch_scope`` owns it."""
    return scratch_path(spark, f"llm-{name}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet in the shared checkpoint folder and read back: cuts the
    lineage, computes the plan once, survives a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Null texts count as empty."""
    return df.withColumn(text, F.coalesce(F.col(text), F.lit("")))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, size: int = 1 << 20):
    """Row ranges of about ``size`` bytes (a longer row stands alone): bounds the
    memory of the byte kernels whatever the batch holds."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


BASE = np.uint64(0x9E3779B97F4A7C15)
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POW.get("up", ())) < n:
        size = max(n, 1 << 20) + 1
        inv = np.uint64(pow(int(BASE), -1, 1 << 64))
        for key, base in (("up", BASE), ("down", inv)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[key] = np.multiply.accumulate(a)
    return _POW["up"], _POW["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on all bytes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from one running sum over the block."""
    up, down = powers(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=run[1:])
    h = (run[ends] - run[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``inside[byte]``, cut at row borders: starts, ends,
    and for each row the index of its first run (length rows + 1)."""
    m = np.zeros(len(data) + 2, bool)
    m[1:-1] = inside[data]
    first = m[1:-1] & ~m[:-2]
    last = m[1:-1] & ~m[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = m[1:-1][edge]
    last[edge - 1] = m[1:-1][edge - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_class(chars: bytes, high: bool = True) -> np.ndarray:
    """Lookup table of 256 booleans: the given ASCII bytes, and all bytes >= 0x80."""
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    t[128:] = high
    return t


ALNUM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
