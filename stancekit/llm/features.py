"""Hashed indicator features of texts: which n-grams of tokens and of token shapes occur.

A token is a run of word bytes (ASCII letters and digits, all bytes from 0x80
on) or a run of other non-space bytes. Its shape says case, digits or which
signs, and whether it repeats the token before it.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancekit.llm import common as C

_CLASS = np.full(256, 2, np.uint8)
_CLASS[np.frombuffer(C.ALNUM, np.uint8)] = 1
_CLASS[128:] = 1
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_UPPER = C.byte_class(C.ALNUM[10:36], high=False)
_LOWER = C.byte_class(C.ALNUM[36:], high=False)
_DIGIT = C.byte_class(C.ALNUM[:10], high=False)


def _tokens(d: np.ndarray, offsets: np.ndarray):
    cls = _CLASS[d]
    change = np.ones(len(d) + 1, bool)
    change[1:-1] = cls[1:] != cls[:-1]
    change[offsets[:-1][offsets[:-1] < len(d)]] = True
    cut = np.flatnonzero(change)
    starts, ends = cut[:-1], cut[1:]
    keep = cls[starts] > 0
    return starts[keep], ends[keep], cls[starts[keep]]


def _joined(h: np.ndarray, row: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n neighbours in a row."""
    if len(h) < n:
        return h[:0], row[:0]
    g = np.full(len(h) - n + 1, salt, np.uint64)
    for k in range(n):
        g = C.mix(g * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k])
    same = row[:len(g)] == row[n - 1:]
    return g[same], row[:len(g)][same]


def parts(rows, size: int = 1024):
    """A batch or array in slices of ``size`` rows: features take many times the room of their texts."""
    return (rows.slice(lo, size) for lo in range(0, len(rows), size))


def indicators(column, bits: int, words: int = 1, shapes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets per row, ascending: flat uint32, and row offsets.

    ``words``/``shapes``: longest n-gram of folded tokens / of token shapes.
    """
    data, offsets = C.utf8(column)
    flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for lo, hi in C.row_blocks(offsets, 1 << 18):
        d, off = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        rows = hi - lo
        if not len(d):
            sizes.append(np.zeros(rows, np.int64))
            continue
        starts, ends, kind = _tokens(d, off)
        row = np.searchsorted(off, starts, "right") - 1
        h = C.span_hashes(C.FOLD[d], starts, ends)
        keys = []
        for n in range(1, words + 1):
            keys.append(_joined(h, row, n, n))
        if shapes:
            count = lambda t: (c := np.concatenate([[0], np.cumsum(t[d])]))[ends] - c[starts]
            up, low, dig = count(_UPPER), count(_LOWER), count(_DIGIT)
            first = _UPPER[d[starts]]
            shape = np.where(dig > 0, 1, np.where((up > 1) & (up >= low), 2, np.where(first, 3, 4))).astype(np.uint64)
            shape[kind == 2] = h[kind == 2]
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
            shape = C.mix(shape + again.astype(np.uint64) * np.uint64(977))
            for n in range(1, shapes + 1):
                keys.append(_joined(shape, row, n, 100 + n))
        key = np.unique(np.concatenate([(r.astype(np.uint64) << np.uint64(32)) | (g >> np.uint64(64 - bits)) for g, r in keys]))
        flat.append((key & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        sizes.append(np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=rows))
    return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def bucket_counts(df: DataFrame, groups: list[str], bits: int, words: int, shapes: int, text: str = "text") -> DataFrame:
    """(bucket, one column per group): rows that have the bucket, weighted by the 0/1 group
    columns. Each task counts into fixed arrays first, so the exchange holds at most
    2**bits rows a task; no key can be hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(groups), 1 << bits), np.int64)
        for batch in (p for b in batches for p in parts(b)):
            flat, off = indicators(batch.column(text), bits, words, shapes)
            for k, g in enumerate(groups):
                on = np.repeat(np.asarray(batch.column(g).fill_null(0)).astype(np.int64), np.diff(off))
                total[k] += np.bincount(flat, weights=on, minlength=1 << bits).astype(np.int64)
        some = np.flatnonzero(total.any(0))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(t[some]) for t in total]], ["bucket", *groups])

    per_task = df.select(F.col(text), *[F.col(g).cast("int").alias(g) for g in groups]).mapInArrow(
        run, "bucket int, " + ", ".join(f"{g} bigint" for g in groups))
    return per_task.groupBy("bucket").agg(*[F.sum(g).alias(g) for g in groups])


def sparse_rows(df: DataFrame, keep: list[str], bits: int, words: int, shapes: int, text: str = "text") -> DataFrame:
    """keep columns (ints) and the row's buckets as binary uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b)):
            flat, off = indicators(batch.column(text), bits, words, shapes)
            rows = [flat[a:b].astype("<u4").tobytes() for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(rows, pa.binary())], [*keep, "buckets"])

    return df.select(F.col(text), *[F.col(k).cast("int").alias(k) for k in keep]).mapInArrow(
        run, ", ".join(f"{k} int" for k in keep) + ", buckets binary")


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: int, folds: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of rows that may be learned from: crc32 of the id as text modulo ``folds`` is not ``fold``.
    Null ids and labels teach nothing; of labels that disagree on an id the largest counts."""
    return (labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
            .where(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != fold)
            .groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y")))


def first_by_hash(marked: DataFrame, cap: int, seed: int) -> DataFrame:
    """A fixed sample: the first ``cap`` rows (id, y) by a seeded hash of the id.

    A hash threshold keeps about 1.2 cap rows before they are ranked, so what meets in one
    task is bounded by the cap, not by cap rows of each task."""
    return head_by_hash(marked, cap, F.xxhash64(F.lit(seed), "id"), "id", marked.count())


def head_by_hash(df: DataFrame, cap: int, h, key: str, n: int) -> DataFrame:
    """The first ``cap`` of ``n`` rows by the hash ``h``, then ``key``."""
    share = (1.2 * cap + 200) / max(n, 1)
    near = df if share >= 1 else df.where(h < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return near.orderBy(h, key).limit(cap)


def sample_texts(docs: DataFrame, few: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, y, text) of a bounded sample of ids; of rows that share an id the smallest text."""
    one = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the caps of the sample bound what is broadcast: two numbers a row
    return one.join(F.broadcast(few), "id").groupBy("id", "y").agg(F.min("text").alias("text"))


def key_filter(keys: DataFrame, col: str, bits: int = 24):
    """A Column function: may the key be in ``keys``? A bitmap of 2**bits hashed places, whatever the
    number of keys: never wrongly false; true by chance as often as the bitmap is full."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    at = keys.select(place(F.col(col)).alias("p"))
    got = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b")).toArrow()   # at most 2**(bits - 6) rows
    words = np.zeros(1 << (bits - 6), np.int64)
    words[np.asarray(got.column("w"))] = np.asarray(got.column("b"))

    @F.arrow_udf("boolean")
    def may(column: pa.Array) -> pa.Array:
        p = np.asarray(column)
        return pa.array(((words[p >> 6] >> (p & 63)) & 1).astype(bool))

    return lambda c: may(place(c))


def labelled_texts(docs: DataFrame, y: DataFrame, fold: int, folds: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, p, q) of every document with a label in ``y``: p and q say its class. Rows that share an id all count.
    Where the labels are too many to be broadcast, a filter of bounded size keeps most other texts from moving."""
    one = docs.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != fold)
    one = one.where(key_filter(y.select(F.col("id").cast(docs.schema[id_col].dataType).alias("id")), "id")(F.col(id_col)))
    return one.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(y, "id").select(
        "text", (F.col("y") > 0).cast("int").alias("p"), (F.col("y") <= 0).cast("int").alias("q"))
