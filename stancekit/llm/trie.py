"""Prefix trie of conversations: subtree totals by time-forward processing.

A node is a distinct sequence of first turns. Turns shrink to a digest and a size at once, so texts do
not travel. A prefix's key is a running polynomial over the digests modulo a prime of 127 bits: parts of a
conversation compose, so a conversation may lie in any number of partitions (``scanned``).

Totals go up the tree in reverse level order. A node's weight, the turns its members have left, bounds
the nodes below it and is known without the tree. Shards are the largest subtrees whose weight is at most ``shard``:
their nodes are sorted by shard and reverse level, and one pass sends each node's totals forward to its
parent through a priority queue, which spills. What the shard roots send is summed per parent, and the
nodes above them are dealt again by a bound 64 times as large, until the root is reached: a shard of any
level holds a bounded number of nodes per depth, however many conversations share a turn.
"""
from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from stancekit.llm import common as C

PRIME = (1 << 127) - 1
BASE = 0x5D3C_9A1F_27B8_E46D_13F0_8C75_B29E_6A41 % PRIME
ROOT = bytes(16)
SHARD = 1 << 10       # weight of the shards of the first level
STEP = 64             # by which the bound grows from level to level
KEEP = 100_000        # messages a queue keeps in memory
CHUNK = 1 << 20       # bytes of a list of ids that travel as one row


def digest(role: str = "role", text: str = "text"):
    """128 bits of a turn; null counts as empty."""
    r, t = (F.md5(F.coalesce(F.col(c), F.lit("")).cast("binary")) for c in (role, text))
    return F.unhex(F.md5(F.concat(r, t).cast("binary")))


def key_bytes(h: int) -> bytes:
    return h.to_bytes(16, "big")


# -- running keys ---------------------------------------------------------------------------------

def scanned(rows: DataFrame, order: list, keep: list[str]) -> DataFrame:
    """(conv_id, n, key, up, *keep): each row's place in its conversation (from 1), the key of the
    sequence up to it, and the key before it. ``rows``: conv_id, digest, the columns of ``order`` and ``keep``.

    Rows are ranged by conversation and order over the partitions. Each partition runs alone and notes what it has of
    its first and its last conversation; a conversation that began in an earlier partition is then carried
    on from these notes (two rows a partition, so their number is that of the partitions)."""
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType.simpleString()
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    laid = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", *order).sortWithinPartitions("conv_id", *order)
    kinds = to_arrow_schema(laid.select("conv_id", *keep).schema)

    def table(out: tuple, kept: pa.RecordBatch | None, notes: list, pid: int) -> pa.RecordBatch:
        """Rows of a batch, and behind them the notes (conversation, turns, key, 1 for the first or 2 for the last)."""
        k, m = len(out[0]), len(notes)
        columns = [pa.array(out[0] + [x[0] for x in notes], kinds.field(0).type), pa.array(out[1] + [x[1] for x in notes], pa.int64()),
                   pa.array(out[2] + [key_bytes(x[2]) for x in notes], pa.binary()), pa.array(out[3] + [None] * m, pa.binary()),
                   pa.array([pid] * (k + m), pa.int32()), pa.array([0] * k + [x[3] for x in notes], pa.int32())]
        for c in keep:
            none = pa.nulls(m, kinds.field(c).type)
            columns.append(none if kept is None else pa.concat_arrays([kept.column(c).cast(none.type), none]))
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "n", "key", "up", "pid", "edge", *keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, h, pid, first = None, 0, 0, 0, True
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            notes = []
            for c, d, pid in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "digest", "pid"))):
                if c != conv or not n:
                    if n and first:
                        notes.append((conv, n, h, 1))
                        first = False
                    conv, n, h = c, 0, 0
                before = h
                h = (h * BASE + int.from_bytes(d, "big") + 1) % PRIME
                n += 1
                for column, x in zip(out, (c, n, key_bytes(h), key_bytes(before))):
                    column.append(x)
            yield table(out, batch, notes, pid)
        if n:
            yield table(([], [], [], []), None, [(conv, n, h, 1 if first else 2)], pid)

    schema = f"conv_id {kind}, n bigint, key binary, up binary, pid int, edge int" + (f", {fields}" if keep else "")
    x = C.written(laid.select(F.spark_partition_id().alias("pid"), *dict.fromkeys(["conv_id", "digest", *keep])).mapInArrow(run, schema), "trie-scan")
    carried = carries(x.where("edge > 0").select("pid", "edge", "conv_id", "n", "key").orderBy("pid", "edge").collect())
    data = x.where("edge = 0").drop("edge")
    if not carried:
        return data.drop("pid")

    @F.arrow_udf("binary")
    def on(key: pa.Array, n: pa.Array, before: pa.Array) -> pa.Array:
        return pa.array([k if b is None else key_bytes((int.from_bytes(b, "big") * pow(BASE, m, PRIME) + int.from_bytes(k, "big")) % PRIME)
                         for k, m, b in zip(key.to_pylist(), n.to_pylist(), before.to_pylist())], pa.binary())

    before = F.broadcast(spark.createDataFrame(carried, f"pid int, conv_id {kind}, _n bigint, _key binary"))
    data = data.join(before, ["pid", "conv_id"], "left")
    return data.select("conv_id", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), on("key", "n", "_key").alias("key"),
                       on("up", F.col("n") - 1, "_key").alias("up"), *keep)


def carries(notes: list) -> list[tuple]:
    """(pid, conv_id, turns, key) of what earlier partitions hold of a partition's first conversation."""
    out, state = [], None
    for r in notes:
        h = int.from_bytes(r["key"], "big")
        if r["edge"] == 1:
            if state and state[0] == r["conv_id"]:
                out.append((r["pid"], r["conv_id"], state[1], key_bytes(state[2])))
                state = (r["conv_id"], state[1] + r["n"], (state[2] * pow(BASE, r["n"], PRIME) + h) % PRIME)
                continue
        state = (r["conv_id"], r["n"], h)
    return out


# -- time-forward processing ----------------------------------------------------------------------

class SpillingQueue:
    """A priority queue that keeps ``keep`` items; the larger half goes to disk as a sorted run.

    Runs are anonymous files in the executor's own spill folder, gone with the task; nobody else reads them."""

    def __init__(self, keep: int = KEEP):
        self.keep, self.heap, self.runs, self.spilled = max(2, keep), [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.keep:
            self.heap.sort()
            half = self.keep // 2
            run = self._read(self._write(self.heap[half:]))
            del self.heap[half:]
            self.spilled += 1
            heapq.heappush(self.runs, (next(run), self.spilled, run))

    def _write(self, items: list):
        folder = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0]
        f = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        for lo in range(0, len(items), 1024):
            pickle.dump(items[lo:lo + 1024], f)
        f.seek(0)
        return f

    @staticmethod
    def _read(f):
        with f:
            while True:
                try:
                    yield from pickle.load(f)
                except EOFError:
                    return

    def peek(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, number, run = heapq.heappop(self.runs)
            after = next(run, None)
            if after is not None:
                heapq.heappush(self.runs, (after, number, run))
            return item
        return heapq.heappop(self.heap)


def forward(rows: Iterator[tuple], keep: int = KEEP) -> Iterator[tuple[int, int, int]]:
    """(children, leaves, saved) of each row, in order. Rows: shard, depth, key, up, whether it is the
    shard's root, its own saving, and children, leaves and savings that other shards have sent; by shard,
    then depth descending, then key."""
    shard, queue = None, SpillingQueue(keep)
    for s, depth, key, up, root, own, children, leaves, saved in rows:
        if s != shard:
            shard, queue = s, SpillingQueue(keep)
        me = (-depth, key)
        saved += own
        while (m := queue.peek()) is not None and m[:2] == me:
            _, _, more, gain = queue.pop()
            children, leaves, saved = children + 1, leaves + more, saved + gain
        if not children:
            leaves = 1
        if not root:
            queue.push((1 - depth, up, leaves, saved))
        yield children, leaves, saved


def level_totals(nodes: DataFrame, keep: int = KEEP) -> DataFrame:
    """Totals of the nodes of one level. ``nodes``: shard, depth, key, up, top, own, c, l, s."""
    names = ["shard", "depth", "key", "up", "top", "own", "c", "l", "s"]
    x = nodes.select(*names).repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []

        def rows():
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in names)):
                    ready.append(row)
                    yield row

        def out(got):
            rest = ready[:len(got)]
            del ready[:len(got)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rest], pa.int64()), pa.array([r[2] for r in rest], pa.binary()), pa.array([r[3] for r in rest], pa.binary()),
                 pa.array([r[4] for r in rest], pa.bool_()), *[pa.array([g[k] for g in got], pa.int64()) for k in range(3)]],
                ["depth", "key", "up", "top", "n_children", "n_leaves", "saved_tokens"])

        got: list[tuple] = []
        for t in forward(rows(), keep):
            got.append(t)
            if len(got) == 4096:
                yield out(got)
                got = []
        if got:
            yield out(got)

    return x.mapInArrow(run, "depth bigint, key binary, up binary, top boolean, n_children bigint, n_leaves bigint, saved_tokens bigint")


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256): SHA-256 of the ids of each node's rows, ascending, joined by commas.

    Ids are sorted over all partitions and strung together in pieces there; a hash runs over
    the pieces of its node, so a node that a third of all conversations end in is a few rows here."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = ends.repartitionByRange(n, "depth", "key", "conv_id").sortWithinPartitions("depth", "key", "conv_id").select(
        "depth", "key", F.col("conv_id").cast("string").alias("id"), F.spark_partition_id().alias("pid"))

    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, parts, size, seq, pid = None, [], 0, 0, 0
        for batch in batches:
            out = []
            for depth, key, i, pid in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "id", "pid"))):
                if (depth, key) != node or size > CHUNK:
                    if parts:
                        out.append((*node, pid, seq, ",".join(parts)))
                        seq += 1
                    node, parts, size = (depth, key), [], 0
                parts.append(i)
                size += len(i) + 1
            yield _pieces(out)
        if parts:
            yield _pieces([(*node, pid, seq, ",".join(parts))])

    def _pieces(out: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["depth", "key", "pid", "seq", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for depth, key, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "piece"))):
                if (depth, key) != node:
                    if sha is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (depth, key), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(piece.encode())
            yield _hashes(out)
        if sha is not None:
            yield _hashes([(*node, sha.hexdigest())])

    def _hashes(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.string()))], ["depth", "key", "ends_sha256"])

    pieces = laid.mapInArrow(string, "depth bigint, key binary, pid int, seq bigint, piece string")
    return pieces.repartition(n, "depth", "key").sortWithinPartitions("depth", "key", "pid", "seq").mapInArrow(
        hashed, "depth bigint, key binary, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame, shard: int = SHARD, step: int = STEP, keep: int = KEEP) -> DataFrame:
    """One row per distinct sequence of first turns: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, pos (order within a conversation, no ties), digest, n_bytes. ``members``: conv_id of all
    conversations, turnless ones too, once each. The root has depth 0, no text and no parent. A node's saving is (members - 1)
    times the bytes of its last text; totals include the node. No members: no nodes.
    """
    lens = C.written(members.join(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len")), "conv_id", "left")
                     .select("conv_id", F.coalesce("len", F.lit(0)).cast("long").alias("len")), "trie-lens")
    path = scanned(turns, ["pos"], ["n_bytes"]).withColumnRenamed("n", "depth")
    path = C.written(path.join(lens, "conv_id"), "trie-paths")
    left = F.col("len") - F.col("depth") + 1
    nodes = path.groupBy("depth", "key").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("up").alias("up"), F.min("n_bytes").alias("n_bytes"), F.sum(left).alias("weight"))
    root = lens.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("len") + 1).alias("weight")).where("n_convs > 0")
    nodes = nodes.unionByName(root.select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), "conv_id", "n_convs",
                                          F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("n_bytes"), "weight"))
    nodes = C.written(nodes, "trie-nodes")
    total = nodes.agg(F.max("weight")).first()[0] or 0
    bounds = []
    while shard < total:
        bounds.append(shard)
        shard *= step
    # the top of each conversation's path that fits each bound
    tops = path.select("conv_id", "depth", "key").join(nodes.select("depth", "key", "weight"), ["depth", "key"]).groupBy("conv_id").agg(
        *[F.min(F.when(F.col("weight") <= b, F.struct("depth", "key"))).alias(f"top{j}") for j, b in enumerate(bounds)] or [F.lit(None).alias("none")])
    level = sum((F.when(F.col("weight") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    top = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"))
    for j in reversed(range(len(bounds))):
        top = F.when(F.col("weight") <= bounds[j], F.col(f"top{j}")).otherwise(top)
    dealt = nodes.join(tops, "conv_id", "left").select(
        *nodes.columns, level.alias("level"), top.alias("shard"),
        F.when(F.col("depth") == 0, F.lit(0)).otherwise((F.col("n_convs") - 1) * F.col("n_bytes")).cast("long").alias("own"))
    dealt = C.written(dealt.withColumn("top", (F.col("shard.depth") == F.col("depth")) & (F.col("shard.key") == F.col("key"))), "trie-dealt")

    done, sent = None, None
    for j in range(len(bounds) + 1):
        here = dealt.where(F.col("level") == j)
        zero = F.lit(0).cast("long")
        if sent is None:
            here = here.withColumns({"c": zero, "l": zero, "s": zero})
        else:
            sums = sent.groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("key")).agg(
                F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
            here = here.join(sums, ["depth", "key"], "left").withColumns({c: F.coalesce(c, zero) for c in "cls"})
        got = C.written(level_totals(here, keep), "trie-totals")
        done = got if done is None else done.unionByName(got)
        out = got.where("top and depth > 0")
        sent = out if sent is None else sent.unionByName(out)

    ends = path.where("depth = len").select("depth", "key", "conv_id").unionByName(
        lens.where("len = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), "conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    known = nodes.select("depth", "key", "up", "conv_id", "n_convs").join(done.drop("up", "top"), ["depth", "key"]).join(end_hashes(ends), ["depth", "key"], "left")
    return known.join(parents, ["depth", "up"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, n_bytes): the turns of each conversation, numbered from 0 by ``turn`` (null
    first; ties by the digest of role and text, so repeated rows are turns of their own). Null role and text are
    empty. Rows without a conv_id take no part; other columns are left behind."""
    x = conversations.where("conv_id is not null").select(
        "conv_id", "turn", digest().alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = scanned(x, [F.col("turn").asc_nulls_first(), "digest"], ["digest", "n_bytes"])
    return out.select("conv_id", (F.col("n") - 1).alias("pos"), "digest", "n_bytes")


def spliced(turns: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """(turns, members) in which each conversation c opens with the first h turns of conversation c - c % ``group``
    (fewer if it has fewer) in place of its own first h; h is the CRC-32 of the id, modulo ``most`` + 1."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("long")
    convs = C.written(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")), "trie-convs")
    head = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn(
        "head", F.least("h", F.coalesce("n_base", F.lit(0))))
    head = C.written(head.select("conv_id", "base", "h", "head"), "trie-heads")
    opening = turns.where((F.col("pos") < most) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    opening = opening.join(head, "base").where("pos < head")
    own = turns.join(head, "conv_id").where("pos >= h").withColumn("pos", F.col("head") + F.col("pos") - F.col("h"))
    names = ["conv_id", "pos", "digest", "n_bytes"]
    return C.written(opening.select(*names).unionByName(own.select(*names)), "trie-turns"), convs.select("conv_id")


ORACLE = r"""
WITH t AS (SELECT conv_id, strlen(coalesce(text, '')) AS bytes, d, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS pos
  FROM (SELECT *, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS d FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM (SELECT conv_id, COUNT(*) AS n FROM t GROUP BY conv_id)),
i AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS head FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT i.conv_id, pos + 1 AS depth, d, bytes FROM i JOIN t ON t.conv_id = i.base WHERE pos < head
  UNION ALL SELECT i.conv_id, head + pos - h + 1 AS depth, d, bytes FROM i JOIN t ON t.conv_id = i.conv_id WHERE pos >= h),
m AS (SELECT conv_id, depth, bytes, md5(string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(depth) AS len FROM m GROUP BY conv_id),
n AS (SELECT depth, key, min(conv_id) AS conv_id, COUNT(*) AS n_convs, any_value(bytes) AS bytes FROM m GROUP BY depth, key),
p AS (SELECT n.*, u.key AS up FROM n LEFT JOIN m u ON u.conv_id = n.conv_id AND u.depth = n.depth - 1),
k AS (SELECT p.*, coalesce(q.n_children, 0) AS n_children FROM p LEFT JOIN (SELECT depth - 1 AS depth, up, COUNT(*) AS n_children FROM p WHERE depth > 0 GROUP BY 1, 2) q
      ON q.depth = p.depth AND q.up = p.key),
s AS (SELECT m.depth, m.key, COUNT(*) FILTER (WHERE k.n_children = 0) AS n_leaves, SUM(CASE WHEN k.depth = 0 THEN 0 ELSE (k.n_convs - 1) * k.bytes END) AS saved
      FROM k JOIN m ON m.conv_id = k.conv_id AND m.depth <= k.depth GROUP BY m.depth, m.key),
e AS (SELECT m.depth, m.key, sha256(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id)) AS sha FROM m JOIN l ON l.conv_id = m.conv_id AND l.len = m.depth GROUP BY m.depth, m.key)
SELECT k.conv_id, k.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM k JOIN s ON s.depth = k.depth AND s.key = k.key LEFT JOIN n u ON u.depth = k.depth - 1 AND u.key = k.up LEFT JOIN e ON e.depth = k.depth AND e.key = k.key"""
