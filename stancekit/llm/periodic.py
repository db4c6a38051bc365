"""Periodic runs of words: a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q whose length reaches
``min_length`` and ``exponent`` times q and which no neighbouring word extends. The suffix links of the
automaton form a tree; a node's colour is the end of the last occurrence of its words. Appending
word i is a link-cut access to the node of that prefix: the path to the root falls into segments of
one colour e, and the deepest node of such a segment tells the longest stretch that ends at i and
ended at e before. If the distance i - e is within that length, the words are a square of period i - e,
stretched to the left as far as it goes; it is a run if the next word does not go on with it.
(By Fine and Wilf the distance is the smallest period, so each run is met once, at its last word.)

The automaton runs where a run can lie at all: if w[i] .. w[j] has period q, all its word four-grams but
the last occur again at most q words later. Stretches of such four-grams that are long enough for a run
are found by sorting hashes (equal hashes of different four-grams only add stretches), merged where they
overlap, and each is searched as a whole, so no run is cut. Map-only: a document's runs are part of its row.
"""
from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.llm import common as C

RUN = "start bigint, length bigint, period bigint"
GRAM = 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def automaton(words: list[int]) -> tuple[array, array, array]:
    """(link, length, node of each prefix) of the suffix automaton; nodes from 1, 1 is the root, 0 is none.

    Most nodes have one transition, kept in two arrays; only the others have a dictionary."""
    link, length, first, to = (array("q", [0, 0]) for _ in range(4))
    first[0] = first[1] = -1
    more: dict[int, dict[int, int]] = {}
    ends, last = array("q"), 1
    for c in words:
        now = len(link)
        link.append(1), length.append(length[last] + 1), first.append(-1), to.append(0)
        p, q = last, 0
        while p:
            if first[p] == c:
                q = to[p]
                break
            if first[p] < 0:
                first[p], to[p] = c, now
            elif p not in more:
                more[p] = {c: now}
            elif c in more[p]:
                q = more[p][c]
                break
            else:
                more[p][c] = now
            p = link[p]
        if q and length[q] == length[p] + 1:
            link[now] = q
        elif q:
            twin = len(link)
            link.append(link[q]), length.append(length[p] + 1), first.append(first[q]), to.append(to[q])
            if q in more:
                more[twin] = dict(more[q])
            link[q] = link[now] = twin
            while p:
                if first[p] == c:
                    if to[p] != q:
                        break
                    to[p] = twin
                elif p in more and more[p].get(c) == q:
                    more[p][c] = twin
                else:
                    break
                p = link[p]
        last = now
        ends.append(now)
    return link, length, ends


def runs_of(words: list[int], min_length: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in the order of their ends.

    The tree's preferred paths are splay trees by depth. A path has one colour, kept at the
    top of its splay tree; what an access cuts off below takes the colour along."""
    link, length, ends = automaton(words)
    n, size = len(words), len(link)
    parent, left, right = array("q", link), array("q", bytes(8 * size)), array("q", bytes(8 * size))
    colour = array("q", [-1]) * size
    out = []
    for i, node in enumerate(ends):
        below, x = 0, node
        while x:
            # splay x to the top of its path
            top = 0
            while True:
                p = parent[x]
                if not p or left[p] != x and right[p] != x:
                    break
                g = parent[p]
                top = p
                if g and (left[g] == p or right[g] == p):
                    top = g
                    turns = (p, x) if (left[g] == p) == (left[p] == x) else (x, x)
                else:
                    turns = (x,)
                for y in turns:
                    a = parent[y]
                    b = parent[a]
                    if left[a] == y:
                        k = left[a] = right[y]
                        right[y] = a
                    else:
                        k = right[a] = left[y]
                        left[y] = a
                    if k:
                        parent[k] = a
                    parent[a], parent[y] = y, b
                    if b:
                        if left[b] == a:
                            left[b] = y
                        elif right[b] == a:
                            right[b] = y
            if top:
                colour[x] = colour[top]
            e = colour[x]
            if e >= 0:
                reach, period = length[x], i - e
                total = reach + period
                if total >= min_length and total >= exponent * period and (i + 1 == n or words[i + 1] != words[i + 1 - period]):
                    out.append((i - total + 1, total, period))
            cut = right[x]
            if cut:
                colour[cut] = e
            right[x] = below
            below, x = x, parent[x]
        # the whole path is one now, and its top the last one splayed
        colour[below] = i
    return out


def needed(low: int, high: int, gram: int, min_length: int, exponent: int) -> int:
    """Fewest consecutive grams that come again within ``high`` words in a run of a period in low..high."""
    turn = min(max(min_length // exponent, low), high)
    return min(max(min_length, exponent * q) - q for q in {low, high, turn, min(turn + 1, high)}) - gram + 1


def regions(ids: np.ndarray, offsets: np.ndarray, min_length: int, exponent: int) -> list[tuple[int, int, int]]:
    """(row, first, end): disjoint stretches of the words of the rows that hold every run."""
    n = len(ids)
    gram = min(GRAM, min(max(min_length, exponent * q) - q for q in range(1, max(2, min_length))))
    if n < gram:
        return []
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    h = row.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    for j in range(gram):
        h[:n - j] += (ids[j:].astype(np.uint64) + np.uint64(1)) * _ODD[j]
    bits = np.uint64(max(1, int(n).bit_length()))
    at = np.arange(n, dtype=np.uint64)
    inside = np.arange(n) + gram <= offsets[row + 1]
    key = np.sort(((C.mix(h) >> bits << bits) | at)[inside])
    again = key[1:] >> bits == key[:-1] >> bits
    low = key & ((np.uint64(1) << bits) - np.uint64(1))
    here = low[:-1][again].astype(np.int64)
    far = low[1:][again].astype(np.int64) - here
    order = np.argsort(here)
    here, far = here[order], far[order]
    found = []
    first, high = 1, 1
    while len(here) and first * exponent <= sizes.max():
        p = here[far <= high]
        if len(p):
            cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(row[p]) != 0))
            a, b = p[np.append(0, cut + 1)], p[np.append(cut, len(p) - 1)]
            long = b - a + 1 >= needed(first, high, gram, min_length, exponent)
            a, b = a[long], b[long]
            found += zip(row[a].tolist(), a.tolist(), np.minimum(b + high + gram, offsets[row[a] + 1]).tolist())
        first, high = high + 1, 2 * high
    out: list[list[int]] = []
    for r, a, b in sorted(found):
        if out and out[-1][0] == r and a < out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([r, a, b])
    return [(r, a, b) for r, a, b in out if b - a >= min_length]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, exponent: int = 4) -> DataFrame:
    """id, n_words, runs (by start, then period) and the collapsed text of every row.

    Words are the maximal runs of other characters than the six ASCII white spaces, numbered
    from 0. Collapsed is the text without the words that any run holds after its first
    period, joined by one space. Null and empty texts have no words, no runs and an empty
    collapsed text; null ids and repeated rows stay rows of their own; other columns take no part;
    an empty table gives none. ``exponent`` is 2 or more.
    """
    if exponent < 2 or min_length < 2:
        raise ValueError("a run holds its period twice")
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        number: dict[bytes, int] = defaultdict(count().__next__)
        data, offs = C.utf8(part.column("text"))
        raw = data.tobytes()
        words = [raw[a:b].split() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        ids = [list(map(number.__getitem__, w)) for w in words]
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        flat = np.fromiter((x for w in ids for x in w), np.int64, int(offsets[-1]))
        runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
        for r, a, b in regions(flat, offsets, min_length, exponent):
            lo = int(a - offsets[r])
            runs[r] += [(lo + s, n, q) for s, n, q in runs_of(ids[r][lo:lo + b - a], min_length, exponent)]
        texts = []
        for w, found in zip(words, runs):
            if found:
                found.sort(key=lambda x: (x[0], x[2]))
                keep = np.ones(len(w), bool)
                for s, n, q in found:
                    keep[s + q:s + n] = False
                w = compress(w, keep.tolist())
            texts.append(b" ".join(w).decode())
        ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        members = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(np.diff(offsets)),
             pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(members[:, k]) for k in range(3)], fields=list(item))),
             pa.array(texts, pa.string())], ["id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in C.row_blocks(C.utf8(batch.column("text"))[1]):
                yield rows(batch.slice(lo, hi - lo))

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_words bigint, runs array<struct<{RUN.replace(' bigint', ':bigint')}>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run of greatest exact length / period (ties: smallest start, then period); null if there is none."""
    def order(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))
    return F.get(F.array_sort(runs, order), 0)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_runs, the strongest run and SHA-256 of the list of runs and of the collapsed text."""
    x = found.withColumn("_top", strongest(F.col("runs")))
    line = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return x.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _top.length div _top.period").alias("exponent_milli"),
        F.sha2(line.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose id says so turn periodic: with h the id's CRC-32 and g = h // 10, if 10 divides h word
    i from a = g % n on is word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). Other rows stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))

    @F.arrow_udf("string")
    def plant(text: pa.Array, g: pa.Array) -> pa.Array:
        out = []
        for t, k in zip(text.to_pylist(), g.to_pylist()):
            w = t.encode().split() if t is not None else []
            if w:
                n = len(w)
                a = k % n
                p = 1 + (n - a) // (3 + k % 8)
                w[a:] = [w[a + j % p] for j in range(n - a)]
                t = b" ".join(w).decode()
            out.append(t)
        return pa.array(out, pa.string())

    g = F.floor(h / 10)
    return docs.withColumn(text_col, F.coalesce(plant(F.when(h % 10 == 0, F.col(text_col)), g), F.col(text_col)))
