"""Nearest neighbours by inner product over robust-pruned directed graphs.

Vectors get one coordinate more, sqrt(M^2 - |x|^2) with M the longest length, which turns the
largest inner product into the smallest distance. Each shard builds its own graph: greedy
searches from the centre propose neighbours, relaxed distance pruning (factor ``alpha``)
keeps diverse ones, reverse edges are added and pruned alike. Every query is searched
for in every shard by a beam, and scored exactly on the original vectors.

Equal vectors are one node with its smallest ids, so copies neither clog a graph nor get
lost: beyond ``k`` + 1 ids of one vector none can be among the ``k`` nearest.
A shard holds about ``shard_rows`` nodes, whatever the input, so the recall does not fall as it
grows; queries stream through its task in batches.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stancekit.llm import common as C

DEGREE, BEAM, ALPHA = 32, 96, 1.2
SHARD_ROWS, LEAST_SHARDS = 8192, 12     # recall 0.95 on shards of this size, on vectors almost without clusters
EXPAND = 4      # beam entries opened at a time


class Graph:
    """A directed graph over the rows of ``x``; at most ``degree`` edges a node after pruning."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 3):
        self.x = np.ascontiguousarray(x, np.float32)
        self.sq = np.einsum("ij,ij->i", self.x, self.x)
        self.degree, self.beam, self.alpha = degree, beam, alpha
        n, rng = len(x), np.random.default_rng(seed)
        self.nb = np.full((n, 2 * degree), -1, np.int32)
        self.deg = np.zeros(n, np.int32)
        self.entry = int(np.argmin(self.sq - 2 * self.x @ self.x.mean(0))) if n else 0
        if n > 1:
            start = min(degree // 2, n - 1)
            self.nb[:, :start] = (np.arange(n)[:, None] + rng.integers(1, n, (n, start))) % n
            self.deg[:] = start
            order = rng.permutation(n)
            for lo in range(0, n, 256):
                self._insert(order[lo:lo + 256])
            for lo in range(0, n, 1024):
                self._trim(np.arange(lo, min(lo + 1024, n)))

    def search(self, q: np.ndarray, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances) of the ``beam`` nearest found for each row of q, nearest first; -1 pads."""
        beam = beam or self.beam
        m, n = len(q), len(self.x)
        ids = np.full((m, beam), -1, np.int64)
        dist = np.full((m, beam), np.inf, np.float32)
        done = np.ones((m, beam), bool)
        seen = np.zeros((m, n), bool)
        ids[:, 0], done[:, 0], seen[:, self.entry] = self.entry, False, True
        dist[:, 0] = self.sq[self.entry] - 2 * q @ self.x[self.entry]
        active = np.arange(m)
        while len(active):
            open_ = ~done[active]
            rank = np.cumsum(open_, 1)
            pick = open_ & (rank <= EXPAND)
            a, col = np.nonzero(pick)
            done[active[a], col] = True
            row = active[a]
            new = self.nb[ids[row, col]].astype(np.int64)                 # (picked, 2 degree)
            rows = np.repeat(row, new.shape[1])
            flat = new.ravel()
            ok = flat >= 0
            rows, flat = rows[ok], flat[ok]
            fresh = ~seen[rows, flat]
            rows, flat = rows[fresh], flat[fresh]
            key = np.unique(rows * n + flat)                              # a node may be reached twice in a step
            rows, flat = key // n, key % n
            seen[rows, flat] = True
            d = self.sq[flat] - 2 * np.einsum("ij,ij->i", self.x[flat], q[rows])
            per = np.bincount(rows, minlength=m)[active]
            width = int(per.max()) if len(per) else 0
            if width:
                slot = np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)
                local = np.repeat(np.arange(len(active)), per)
                ci = np.full((len(active), width), -1, np.int64)
                cd = np.full((len(active), width), np.inf, np.float32)
                ci[local, slot], cd[local, slot] = flat, d
                ai = np.concatenate([ids[active], ci], 1)
                ad = np.concatenate([dist[active], cd], 1)
                ax = np.concatenate([done[active], ci < 0], 1)
                top = np.argsort(ad, 1, kind="stable")[:, :beam]
                ids[active] = np.take_along_axis(ai, top, 1)
                dist[active] = np.take_along_axis(ad, top, 1)
                done[active] = np.take_along_axis(ax, top, 1)
            active = active[(~done[active]).any(1)]
        return ids, dist

    def _prune(self, node: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Diverse neighbours of each node out of its candidates (-1 pads): the nearest stays and
        removes those that lie ``alpha`` times nearer to it than to the node."""
        valid = (cand >= 0) & (cand != node[:, None])
        cand = np.where(valid, cand, 0)
        d = np.where(valid, self.sq[cand] - 2 * np.einsum("ijk,ik->ij", self.x[cand], self.x[node]) + self.sq[node][:, None], np.inf)
        order = np.argsort(d, 1, kind="stable")
        cand, d = np.take_along_axis(cand, order, 1), np.maximum(np.take_along_axis(d, order, 1), 0)
        d[:, 1:][(cand[:, 1:] == cand[:, :-1])] = np.inf
        live = np.isfinite(d)
        vec, out = self.x[cand], np.full((len(node), self.degree), -1, np.int32)
        rows = np.arange(len(node))
        for k in range(self.degree):
            first = np.argmax(live, 1)
            some = live[rows, first]
            if not some.any():
                break
            p = cand[rows, first]
            out[some, k] = p[some]
            live[rows, first] = False
            near = self.sq[cand] - 2 * np.einsum("ijk,ik->ij", vec, self.x[p]) + self.sq[p][:, None]
            live &= ~((self.alpha ** 2 * near <= d) & some[:, None])
        return out

    def _set(self, node: np.ndarray, nb: np.ndarray) -> None:
        self.nb[node] = -1
        self.nb[node, :nb.shape[1]] = nb
        self.deg[node] = (nb >= 0).sum(1)

    def _insert(self, node: np.ndarray) -> None:
        found, _ = self.search(self.x[node])
        nb = self._prune(node, np.concatenate([found, self.nb[node].astype(np.int64)], 1))
        self._set(node, nb)
        src, col = np.nonzero(nb >= 0)
        to, back = nb[src, col].astype(np.int64), node[src]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        while len(to):          # each target takes what it has room for, is pruned, and goes on
            first = np.concatenate([[True], to[1:] != to[:-1]])
            start = np.flatnonzero(first)
            place = np.arange(len(to)) - np.repeat(start, np.diff(np.append(start, len(to))))
            fits = self.deg[to] + place < self.nb.shape[1]
            self.nb[to[fits], self.deg[to[fits]] + place[fits]] = back[fits]
            who, n = np.unique(to[fits], return_counts=True)
            self.deg[who] += n
            full = np.unique(to[~fits])
            for lo in range(0, len(full), 512):
                self._trim(full[lo:lo + 512], always=True)
            to, back = to[~fits], back[~fits]

    def _trim(self, node: np.ndarray, always: bool = False) -> None:
        node = node if always else node[self.deg[node] > self.degree]
        if len(node):
            self._set(node, self._prune(node, self.nb[node].astype(np.int64)))


def usable(v) -> F:
    """Neither null nor zero, and no null or non-finite component."""
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(v, lambda c: c != 0), F.lit(False))


def nearest(items: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, shard_rows: int = SHARD_ROWS,
            least_shards: int = LEAST_SHARDS) -> DataFrame:
    """query_id, rank, id, score: the ``k`` nearest items found for each query other than the item
    of the query's own id, by inner product in double precision, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor those
    whose length is not the commonest (ties: the larger); nor rows with a null id. Repeated rows with one id
    count once. An empty side gives an empty result.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = items.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = queries.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    spark = items.sparkSession
    schema = "query_id long, rank int, id long, score double"
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if dim is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d = int(dim["d"])
    rows, asked = rows.where(F.size("v") == d), asked.where(F.size("v") == d)
    # one node per distinct vector with its k + 1 smallest ids
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = C.written(rows.distinct().withColumn("r", first).where(F.col("r") <= k + 1)
                      .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                      .withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)), "ann-nodes")
    stat = nodes.agg(F.count(F.lit(1)).alias("n"), F.max("sq").alias("m")).first()
    shards = max(1, min(max(least_shards, -(-stat["n"] // shard_rows)), stat["n"]))
    longest = stat["m"]
    home = nodes.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.col("ids").getItem(0).alias("id"), "v", "ids", "sq")
    visit = asked.distinct().select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "v",
        F.array().cast("array<bigint>").alias("ids"), F.lit(0.0).alias("sq"))
    dealt = home.unionByName(visit).repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", "id")

    def vectors(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column("v").flatten()).reshape(-1, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, held, ids = None, [], []
        for batch in batches:
            kind = np.asarray(batch.column("kind"))
            split = int(np.searchsorted(kind, 1))
            if split:
                part = batch.slice(0, split)
                held.append(vectors(part))
                ids += part.column("ids").to_pylist()
            if split == batch.num_rows:
                continue
            if not held:
                continue                # a shard without items
            if graph is None:
                x = np.concatenate(held)
                held = [x]
                more = np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", x, x), 0))[:, None]
                graph = Graph(np.concatenate([x, more], 1), degree, beam, alpha)
            asked = batch.slice(split)
            q, qid = vectors(asked), np.asarray(asked.column("id"))
            for lo in range(0, len(q), 256):
                part, who = q[lo:lo + 256], qid[lo:lo + 256]
                found, _ = graph.search(np.concatenate([part, np.zeros((len(part), 1))], 1).astype(np.float32), max(beam, k))
                out_q, out_i, out_s = [], [], []
                for j, row in enumerate(found):
                    row = row[row >= 0]
                    score = x[row] @ part[j]
                    own = int(who[j])
                    best = sorted((-s, i) for s, r in zip(score.tolist(), row.tolist()) for i in ids[r] if i != own)[:k]
                    out_q += [own] * len(best)
                    out_i += [i for _, i in best]
                    out_s += [-s for s, _ in best]
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_i, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "id", "score"])

    found = dealt.mapInArrow(run, "query_id bigint, id bigint, score double")
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
