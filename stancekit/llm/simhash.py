"""SimHash near-duplicates: vantage-point trees over fingerprints, exact pairs, components.

Two fingerprints that differ in at most ``bits`` of 64 differ in at most
bits // 3 of one of three disjoint blocks of bits. For each block a tree of vantage
points splits the fingerprints by their distance to the vantage point within
the block (or over all bits, where that parts them better). A fingerprint has one
home leaf, and visits a leaf beyond a boundary if its distance is within the
reach of the boundary: by the triangle inequality no linked pair is missed. Leaves
are the shards; inside a shard the same trees, now over all bits, prune down to
blocks that are compared exactly. Shards return a spanning forest of their links,
not all pairs, and a min-label star contraction joins them into components.

Trees are fitted on a bounded sample (``sample`` distinct fingerprints); every fingerprint
is placed. Equal fingerprints count once, so groups of copies cost nothing here.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancekit.llm import common as C
from stancekit.llm.features import head_by_hash

SHINGLE, MAX_BITS, SEED = 4, 4, 42
SAMPLE, LEAF_ROWS, BLOCK = 16384, 8192, 512

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256


def fingerprint_bytes(text: bytes, n: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text (no word: 0)."""
    words = text.lower().split()            # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist())], "<u8")
    per = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((per.ravel() * 2 > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, n: int = SHINGLE, seed: int = SEED) -> Column:
    """SimHash as a signed long of whole texts (null: empty)."""

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        data, off = C.utf8(column)
        view = memoryview(np.ascontiguousarray(data))
        got = [fingerprint_bytes(bytes(view[a:b]), n, seed) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        return pa.array(np.array(got, np.uint64).view(np.int64))

    return run(text)


# -- vantage-point trees ------------------------------------------------------------------------

def distance(x: np.ndarray, v: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((x ^ v) & mask).astype(np.int16)


def choose(x: np.ndarray, masks: list[tuple[np.uint64, int]], rng, tries: int = 6):
    """The vantage point, mask and radius whose two sides, visitors included, cost least:
    (mask, reach, point, radius) or None if no split helps."""
    best, n = None, len(x)
    for mask, reach in masks:
        for v in x[rng.integers(0, n, tries)]:
            hist = np.bincount(distance(x, v, mask), minlength=66)
            below = np.cumsum(hist)
            for radius in np.unique(np.searchsorted(below, [n * 0.35, n * 0.5, n * 0.65])):
                left = below[radius]
                if left in (0, n):
                    continue
                lv = below[min(radius + reach, 65)] - left                       # visitors of the left side
                rv = left - (below[radius - reach] if radius >= reach else 0)    # and of the right one
                cost = left * (left + lv) + (n - left) * (n - left + rv)
                if best is None or cost < best[0]:
                    best = cost, mask, reach, v, int(radius)
    return best[1:] if best and best[0] < 0.9 * n * n else None


@dataclass
class Tree:
    """Inner nodes as (mask, reach, point, radius, left, right); a leaf is (number,)."""
    nodes: list[tuple]

    def place(self, x: np.ndarray):
        """(leaf, row, is_home) of every fingerprint: its home and the leaves it visits."""
        out, stack = [], [(0, np.arange(len(x)), np.ones(len(x), bool))]
        while stack:
            k, row, home = stack.pop()
            node = self.nodes[k]
            if len(node) == 1:
                out.append((np.full(len(row), node[0], np.int32), row, home))
                continue
            mask, reach, point, radius, left, right = node
            d = distance(x[row], point, mask)
            inner = d <= radius
            go_left, go_right = d <= radius + reach, d > radius - reach
            stack.append((left, row[go_left], home[go_left] & inner[go_left]))
            stack.append((right, row[go_right], home[go_right] & ~inner[go_right]))
        return tuple(map(np.concatenate, zip(*out)))


def grow(sample: np.ndarray, masks: list[tuple[np.uint64, int]], leaf: float, first: int, seed: int) -> tuple[Tree, int]:
    """A tree whose leaves hold at most ``leaf`` sample points where they can be parted."""
    nodes: list[tuple] = [()]
    rng, todo, number = np.random.default_rng(seed), [(0, sample)], first
    while todo:
        k, x = todo.pop()
        cut = choose(x, masks, rng) if len(x) > leaf and len(x) > 1 else None
        if cut is None:
            nodes[k] = (number,)
            number += 1
            continue
        mask, reach, point, radius = cut
        d = distance(x, point, mask)
        nodes[k] = (mask, reach, point, radius, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), x[d <= radius]), (len(nodes) + 1, x[d > radius])]
        nodes += [(), ()]
    return Tree(nodes), number


FULL = np.uint64((1 << 64) - 1)


def blocks(bits: int) -> list[tuple[np.uint64, int]]:
    """Three disjoint masks and the reach that one of them must keep."""
    edges = [0, 21, 42, 64]
    return [(np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)), bits // 3) for a, b in zip(edges, edges[1:])]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, by repeated minima."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def links(x: np.ndarray, home: np.ndarray, bits: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a shard: pairs (home, home or visitor) at most ``bits`` apart.

    Vantage points part the shard until a block of homes is small enough to compare
    with its own visitors; memory is a block's, whatever the shard holds."""
    rng, out_a, out_b = np.random.default_rng(seed), [], []
    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        h, v = stack.pop()
        if not len(h) or len(h) + len(v) < 2:
            continue
        cut = choose(x[h], [(FULL, bits)], rng, 3) if len(h) > BLOCK else None
        if cut is not None:
            mask, reach, point, radius = cut
            dh, dv = distance(x[h], point, mask), distance(x[v], point, mask)
            # a home beyond the boundary but within reach visits the other side
            stack.append((h[dh <= radius], np.concatenate([v[dv <= radius + reach], h[(dh > radius) & (dh <= radius + reach)]])))
            stack.append((h[dh > radius], v[dv > radius - reach]))
            continue
        for lo in range(0, len(h), BLOCK):          # rows that no vantage point parts: block by block
            rows = h[lo:lo + BLOCK]
            others = np.concatenate([h[lo:], v])
            for at in range(0, len(others), 8 * BLOCK):
                cols = others[at:at + 8 * BLOCK]
                i, j = np.nonzero(np.bitwise_count(x[rows][:, None] ^ x[cols][None, :]) <= bits)
                a, b = rows[i], cols[j]
                keep = a != b
                a, b = a[keep], b[keep]
                if len(a):
                    node, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
                    root = roots(len(node), inv[:len(a)], inv[len(a):])
                    some = root != np.arange(len(node))
                    out_a.append(node[some])
                    out_b.append(node[root[some]])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    node, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(len(node), inv[:len(a)], inv[len(a):])
    some = root != np.arange(len(node))
    return node[some], node[root[some]]


def near_links(prints: DataFrame, bits: int = MAX_BITS, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints ``fp`` at most ``bits`` apart."""
    n = prints.count()
    few = np.asarray(head_by_hash(prints.select("fp"), sample, F.xxhash64(F.lit(SEED), "fp"), "fp", n).toArrow().column("fp")).astype(np.int64).view(np.uint64)
    trees, leaves = [], 0
    for k, (mask, reach) in enumerate(blocks(bits)):
        tree, leaves = grow(few, [(mask, reach), (FULL, bits)], max(4.0, leaf_rows * len(few) / max(n, 1)), leaves, k)
        trees.append(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp"))
            for tree in trees:
                leaf, row, home = tree.place(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fp[row]), pa.array(home)], ["leaf", "fp", "home"])

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        x = part["fp"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(x, kind="stable")            # the result must not depend on the order of arrival
        x, home = x[order], part["home"].to_numpy()[order]
        a, b = links(x, home, bits)
        return pd.DataFrame({"a": x[a].view(np.int64), "b": x[b].view(np.int64)})

    # a partition of its own for each leaf: a shard is the unit of work and of recovery
    return (prints.select("fp").mapInArrow(place, "leaf int, fp bigint, home boolean").repartition(max(1, leaves), "leaf")
            .groupBy("leaf").applyInPandas(compare, "a bigint, b bigint").distinct())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, label): each node's smallest reachable node, by alternating large and small stars.

    Minima are aggregated before the join, so a hub is one row there; each round is
    written to the shared folder. Raises if ``rounds`` do not suffice."""
    e = C.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star")
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now every v is the smaller end
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
        e = C.written(small.select("p.u", "p.v").where("u <> v").distinct(), "star")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return e.select(F.col("u").alias("fp"), F.col("v").alias("label")).unionByName(
                e.select(F.col("v").alias("fp"), F.col("v").alias("label")).distinct())
        state = now
    raise RuntimeError("star contraction did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE,
                    bits: int = MAX_BITS, salts: int = 16) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id
    reachable), label (the component's smallest fingerprint).

    Null and empty texts have fingerprint zero and are linked like any other; null ids are
    never the smallest unless a component has no other; repeated rows stay rows.
    """
    rows = C.written(docs.select(F.col(id_col), fingerprint(F.col(text_col), n).alias("fp")), "prints")
    prints = C.written(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-prints")
    linked = components(near_links(prints, bits))
    multi = prints.join(linked, "fp")
    # a component may hold a third of all fingerprints: its smallest id goes to ``salts`` places
    least = multi.groupBy("label").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    multi = multi.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")).join(least, ["label", "salt"])
    single = prints.join(linked, "fp", "left_anti").select("fp", F.col("fp").alias("label"), F.col("least").alias("component_id"))
    known = C.written(multi.select("fp", "label", "component_id").unionByName(single), "known-prints")
    # a fingerprint may hold a third of all rows: one row here, and adaptive execution splits the other side
    return rows.join(known, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "label")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """The documents less all but one of each component: the row with the smallest id stays
    (of repeated rows, or rows that share the id and the component, the one with the smallest text).
    """
    found = C.written(near_duplicates(docs, id_col, text_col, n, bits), "components")
    stay = found.where(F.col(id_col).eqNullSafe(F.col("component_id")))
    per_id = found.groupBy(F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    once = stay.join(per_id.where("__n = 1"), F.col(id_col) == F.col("__id")).select("__id")
    kept = docs.join(once, docs[id_col] == F.col("__id"), "left_semi")
    again = per_id.where("__n > 1 or __id is null")
    if again.isEmpty():
        return kept
    # ids that several rows share: few in sound data, told apart by fingerprint
    named = stay.select(F.col(id_col).alias("__j"), F.col("fingerprint").alias("__f"), F.col("label").alias("__label")).distinct()
    ids = again.select("__id").join(named, F.col("__id").eqNullSafe(F.col("__j")))
    shared = docs.withColumn("__fp", F.lower(F.lpad(F.hex(fingerprint(F.col(text_col), n)), 16, "0"))).join(
        ids, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__f")))
    first = Window.partitionBy("__id", "__label").orderBy(F.col(text_col).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in docs.columns])
    return kept.unionByName(shared.withColumn("__k", F.row_number().over(first)).where("__k = 1").select(*docs.columns))
