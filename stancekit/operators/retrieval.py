"""Nearest-neighbour retrieval without materialising all pairs.

Exact top-k: both sides are written once and dealt into blocks of bounded
bytes by a hash of the row key; every (query block, corpus part) pair meets in
one task, which scores it in slices and keeps its local top-k per query. A
limited window per query then merges at most k x parts candidates. Nothing
passes through the driver but two counts, no pair rows, no cross join. The
work is queries x corpus by nature: what is bounded is the memory of a task.

Ranking is by similarity rounded to 9 digits (descending), then by corpus
key, so engines with different summation order agree. Keys may be of any
orderable type, one column or several.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIM_DIGITS = 9
BLOCK_BYTES = 64 << 20       # one side of one task
PART_BYTES = 256 << 10
SCORE_CELLS = 4_000_000      # largest (queries x rows) score block held by a task
SLICE_CELLS = 2_000_000      # largest (rows x cells of the sphere) block


def _keys(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def topk_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the positions of the k best scores, best first, ties to the lower
    position. ``argpartition`` finds the k-th best in linear time; only rows with
    ties across that boundary are sorted whole."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    part = np.sort(np.argpartition(-scores, k - 1, axis=1)[:, :k], axis=1)
    top = np.take_along_axis(scores, part, 1)
    out = np.take_along_axis(part, np.argsort(-top, axis=1, kind="stable"), 1)
    tied = np.flatnonzero((scores >= top.min(axis=1)[:, None]).sum(axis=1) > k)
    if len(tied):
        out[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :k]
    return out


def dense_units(x: pd.DataFrame) -> np.ndarray:
    """The vectors (column vec) at length one, as rows; a zero vector stays zero."""
    m = np.stack(x["vec"].to_numpy()).astype("float64")
    n = np.linalg.norm(m, axis=1)
    return m / np.where(n == 0, 1.0, n)[:, None]


def local_topk(q: pd.DataFrame, c: pd.DataFrame, qkeys, ckeys, k: int, matrix, rows: int = 1 << 30) -> pd.DataFrame:
    """The k best corpus rows of one part for every query of one tile.

    ``q`` has its blocks in ``_block``: each meets the corpus in slices of at most ``rows`` rows."""
    c = c.sort_values(ckeys, kind="stable").reset_index(drop=True)
    q = q.sort_values("_block", kind="stable").reset_index(drop=True)
    qm, cm, ends = matrix(q), matrix(c), np.append(np.unique(q["_block"].to_numpy(), return_index=True)[1], len(q))
    found = []
    for a, b in zip(ends[:-1], ends[1:]):
        step = max(1, min(rows, SCORE_CELLS // (b - a)))
        best_s, best_i = np.zeros((b - a, 0)), np.zeros((b - a, 0), "int64")
        for lo in range(0, len(c), step):
            s = np.round(qm[a:b] @ cm[lo:lo + step].T, SIM_DIGITS)
            i = np.broadcast_to(np.arange(lo, lo + s.shape[1]), s.shape)
            s, i = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, i], axis=1)
            top = topk_rows(s, k)
            best_s, best_i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        who, col = np.nonzero(np.isfinite(best_s))
        found.append((who + a, best_i[who, col], best_s[who, col]))
    who, which, sim = (np.concatenate(x) for x in zip(*found))

    def taken(x: pd.Series, rows: np.ndarray) -> pd.Series:
        """Strings as plain objects: a concatenated Arrow-backed column would come back in chunks."""
        if isinstance(x.dtype, np.dtype) and x.dtype != object:
            return pd.Series(x.to_numpy()[rows])
        return pd.Series(x.to_numpy(dtype=object)[rows], dtype=object)

    out = {f"q{j}": taken(q[name], who) for j, name in enumerate(qkeys)}
    out |= {f"c{j}": taken(c[name], which) for j, name in enumerate(ckeys)}
    return pd.DataFrame(out | {"sim": sim})


def blocked_topk(queries: DataFrame, corpus: DataFrame, qkeys, ckeys, values: list[str], k: int, matrix,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(q0.., c0.., sim, rank). ``values`` are the array columns that ``matrix`` makes rows of.

    Both sides are materialised; the numbers of blocks follow their measured bytes. Blocks travel in
    tiles of ``BLOCK_BYTES`` (or one block, if that is more), so small blocks are met inside a task and cost no copies. An
    empty side gives an empty frame. Null keys are not allowed to meet: rows with one take no part.
    """
    from stancekit.session import materialize

    spark = queries.sparkSession

    def side(df, keys, prefix):
        some = [F.col(c).alias(f"{prefix}{j}") for j, c in enumerate(keys)]
        x = df.select(*some, *values)
        for j in range(len(keys)):
            x = x.where(F.col(f"{prefix}{j}").isNotNull())
        return materialize(x.where(F.col(values[0]).isNotNull()), f"knn-{prefix}")

    q, c = side(queries, qkeys, "q"), side(corpus, ckeys, "c")
    qk, ck = [f"q{j}" for j in range(len(qkeys))], [f"c{j}" for j in range(len(ckeys))]

    def measured(df):
        cells = sum((F.coalesce(F.size(v), F.lit(0)) for v in values), F.lit(0))
        return int(df.agg(F.sum(F.lit(8) * cells + 64).cast("long")).first()[0] or 0)

    q_size, size, tile = measured(q), measured(c), max(BLOCK_BYTES, block_bytes)
    blocks, tiles = max(1, -(-q_size // block_bytes)), max(1, -(-q_size // tile))
    # enough parts to use the cluster, none smaller than PART_BYTES for that alone
    wide = min(int(spark.conf.get("spark.sql.shuffle.partitions")) // tiles, -(-size // PART_BYTES))
    parts = max(1, wide, -(-size // tile))
    dealt_q = q.withColumn("_block", F.pmod(F.xxhash64(*qk), F.lit(blocks)).cast("int")).withColumn(
        "_tile", F.col("_block") % tiles).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt_c = c.withColumn("_part", F.pmod(F.xxhash64(*ck), F.lit(parts)).cast("int")).withColumn(
        "_tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    slices = max(1, -(-size // parts // block_bytes))      # of a part
    types = {**dict(q.dtypes), **dict(c.dtypes)}
    schema = ", ".join(f"{n} {types[n]}" for n in qk + ck) + ", sim double"

    def meet(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: pd.Series([], dtype="float64" if n == "sim" else object) for n in [*qk, *ck, "sim"]})
        return local_topk(a, b, qk, ck, k, matrix, -(-len(b) // slices))

    found = dealt_q.groupBy("_tile", "_part").cogroup(dealt_c.groupBy("_tile", "_part")).applyInPandas(meet, schema)
    return ranked(found, qk, ck, k)


def ranked(found: DataFrame, qk, ck, k: int) -> DataFrame:
    """Global top-k per query over local candidates (limited window)."""
    w = Window.partitionBy(*qk).orderBy(F.col("sim").desc(), *ck)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_cosine(queries: DataFrame, corpus: DataFrame, k: int = 8, qid="qid", cid="cid", vec: str = "embedding",
               block_bytes: int = BLOCK_BYTES, method: str = "block") -> DataFrame:
    """(qid..., cid..., rank, sim): the k corpus vectors of highest cosine per query.

    ``method='block'`` (default) is exact; ``method='lsh'`` approximate.
    """
    if method == "lsh":
        return knn_cosine_lsh(queries, corpus, k, qid, cid, vec)
    if method != "block":
        raise ValueError("method is 'block' or 'lsh'")
    q, c = _keys(qid), _keys(cid)
    out = blocked_topk(queries.withColumnRenamed(vec, "vec"), corpus.withColumnRenamed(vec, "vec"), q, c, ["vec"], k, dense_units, block_bytes)
    return out.select(*[F.col(f"q{j}").alias(n) for j, n in enumerate(q)], *[F.col(f"c{j}").alias(n) for j, n in enumerate(c)], "rank", "sim")


# ------------------------------------------------------------ lexical form
HEADS = 64             # rows scored at a time to raise the floor
FIRST = 4096           # postings read before the first floor
COMMON = 48            # a term is common where its list has more than one in so many of the rows
MARGIN = 1e-8          # above the rounding of a similarity
LOOSE = 1e-5           # above the rounding of a bound in single precision
INDEX_BYTES = 128 << 20      # rows of the corpus that one task searches, at 16 bytes a posting: some 6 million postings


class Postings:
    """A term's rows and their weights."""

    def __init__(self, rows: np.ndarray, values: np.ndarray):
        self.rows, self.values = rows, values


class PostingLists:
    """Lists by term, shortest first, the same values by row, and a sum a row that a search uses and leaves at zero.

    A list's rows fall by the length of what they hold from its term on, in the order of the lists. By posting: the row, its weight, ``suf``
    (the length of what the row holds behind the term), and in lists of rare terms ``common`` (of the common terms alone), in lists of
    common terms ``fall`` (of the term and what is behind it, negated). ``copies``: how many rows each row stands for; ``order``: their order in
    ties. By default 1 and the row."""

    def __init__(self, lists: dict[int, Postings]):
        rows = np.concatenate([p.rows for p in lists.values()] or [np.zeros(0, np.int64)])
        terms = np.repeat(np.array([*lists], np.int64), [len(p.rows) for p in lists.values()])
        by = np.argsort(rows, kind="stable")
        ptr = np.concatenate([[0], np.cumsum(np.bincount(rows))])
        self.number = np.arange(len(ptr) - 1)
        self._build(ptr, terms[by], np.concatenate([p.values for p in lists.values()] or [np.zeros(0)])[by], False)

    @classmethod
    def of_rows(cls, ptr: np.ndarray, terms: np.ndarray, values: np.ndarray) -> PostingLists:
        """The lists of rows given one after the other, each with a term. Rows are numbered anew, those of one rarest term side by
        side, so that a list's rows lie close together: ``number`` is the row given."""
        lists = cls.__new__(cls)
        lists._build(ptr, terms, values, True)
        return lists

    def _build(self, ptr, terms, values, anew):
        n, sizes = len(ptr) - 1, np.bincount(terms)
        ids = np.flatnonzero(sizes)
        ids = ids[np.argsort(sizes[ids], kind="stable")]
        sizes, self.rank = sizes[ids], np.full(len(sizes) + 1, -1, np.int64)
        self.rank[ids] = np.arange(len(ids))
        code = self.rank[terms].astype(np.uint16 if len(ids) < 1 << 16 else np.int32)
        long = np.diff(ptr)
        if anew:
            key = np.repeat(np.arange(n), long) * len(ids) + code
            key.sort()
            code, at = (key % max(1, len(ids))).astype(code.dtype), ptr[:-1]
            second = np.where(long > 1, code[np.minimum(at + 1, len(code) - 1)], code[at])
            self.number = np.lexsort((second, code[at]))
            code = self.rank[terms].astype(code.dtype)
            del key, at, second
        place = np.empty(n, np.int64)
        place[self.number] = np.arange(n)
        key = np.repeat(place, long) * len(ids) + code
        by = np.argsort(key)
        self.code, self.values = code[by], values[by]
        del key, by, code, place
        long = long[self.number]
        self.ptr = np.concatenate([[0], np.cumsum(long)])
        row = np.repeat(np.arange(n, dtype=np.int32), long)
        total = np.concatenate([[0.0], np.cumsum(self.values * self.values)])
        end = total[self.ptr[1:]]
        full = np.sqrt(np.maximum(0.0, end[row] - total[:-1])).astype(np.float32)
        suf = np.sqrt(np.maximum(0.0, end[row] - total[1:])).astype(np.float32)
        del total
        self.longest = float(full.max()) if len(full) else 0.0
        self.cut = int(np.searchsorted(sizes, n / COMMON + 64, "right"))       # the first common term
        common = np.sqrt(np.bincount(row, np.where(self.code < self.cut, 0.0, self.values * self.values), n)).astype(np.float32)
        by = np.argsort(-full)
        by = by[np.argsort(self.code[by], kind="stable")]
        self.ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        self.rows, self.weight, self.suf = row[by], self.values[by].astype(np.float32), suf[by]
        rare = self.ends[self.cut]
        self.common, self.fall, self.rare = common[self.rows[:rare]], -full[by[rare:]], rare
        self.sums, self.weights = np.zeros(n, np.float32), np.zeros(len(ids))
        self.copies, self.order = np.ones(n, np.int64), np.arange(n)

    def exact(self, rows: np.ndarray) -> tuple[np.ndarray, int]:
        """(similarities of ``rows`` to the weights set, postings shared with them). Each row has a posting."""
        lo = self.ptr[rows]
        n = self.ptr[rows + 1] - lo
        last = np.cumsum(n)
        at = np.repeat(lo - (last - n), n) + np.arange(last[-1])
        x = self.weights[self.code[at]]
        return np.add.reduceat(x * self.values[at], last - n), int(np.count_nonzero(x))

    def kth(self, rows: np.ndarray, sims: np.ndarray, k: int) -> float:
        """The k-th best of ``sims``, copies counted; -inf if there are fewer."""
        some = np.argpartition(-sims, k - 1)[:k] if len(sims) > k else np.arange(len(sims))
        some = some[np.argsort(-sims[some])]
        at = int(np.searchsorted(np.cumsum(self.copies[rows[some]]), k))
        return float(sims[some[at]]) if at < len(some) else -np.inf


def search_postings(lists: dict[int, Postings], longest: float, terms, weights, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(rows, similarities, postings shared, postings scored) of one query's k best rows, ties to the lower row. Where rows
    stand for copies, rows that k copies precede are left out.

    Lists are taken shortest first. What a row can gain from a term on is at most the length of the query's rest times that of the
    row's, both in this order of terms. The lists of the rare terms are added up in a sum a row until the query's rest is
    below the floor, the k-th similarity known; a row met so counts if its sum and what the rest may add reach the floor, and is then
    scored from its own values. A row that shares common terms only is met in the first of them, among the
    list's rows that are long enough from there on. A posting read in a list and once more from its row counts twice."""
    if not isinstance(lists, PostingLists):
        lists = PostingLists(lists)
    r, x = lists.rank[np.clip(terms, 0, len(lists.rank) - 1).astype(np.int64)], np.asarray(weights, np.float64)
    by = np.argsort(r, kind="stable")
    by = by[(r[by] >= 0) & (x[by] > 0)]
    r, x = r[by], x[by]
    m, best, sims = len(r), np.zeros(0, np.int64), np.zeros(0)
    if not m:
        return best, sims, 0, 0
    lists.weights[r] = x
    rest = np.sqrt(np.append(np.cumsum((x * x)[::-1])[::-1], 0.0)).tolist()
    ranks, xs, sums = r.tolist(), x.astype(np.float32).tolist(), lists.sums
    lo, hi = [lists.ends[a] for a in ranks], [lists.ends[a + 1] for a in ranks]
    floor, scored, read, j, due, met = -np.inf, 0, 0, 0, FIRST, []
    slack = (LOOSE + 1e-7 * m) * rest[0] * longest

    def check(rows):
        """Scores rows, each once a search."""
        nonlocal floor, scored, best, sims
        found, n = lists.exact(rows)
        scored += n
        sums[rows] = -np.inf
        if floor > 0:
            high = np.flatnonzero(found >= floor - MARGIN)
            rows, found = rows[high], found[high]
        best, sims = np.concatenate([best, rows]), np.concatenate([sims, found])
        floor = max(floor, lists.kth(best, sims, k))

    def check_some(rows, bound):
        """Scores some of the rows with the largest bounds."""
        if len(rows) > HEADS:
            rows = rows[np.flatnonzero(bound >= np.partition(bound, len(rows) - HEADS)[-HEADS])[:2 * HEADS]]
        if len(rows):
            check(np.unique(rows))

    while j < m and (not j or ranks[j] < lists.cut and rest[j] * longest >= floor - slack):
        rows = lists.rows[lo[j]:hi[j]].astype(np.int64)
        np.add.at(sums, rows, lists.weight[lo[j]:hi[j]] * np.float32(xs[j]))
        met.append(rows)
        read, j = read + len(rows), j + 1
        if read >= due and j < m:
            due, rows = 16 * read, np.concatenate(met)
            now = sums[rows]
            go = np.flatnonzero(now > 0)
            check_some(rows[go], now[go])
    rows = np.concatenate(met)
    bound = sums[rows]
    if j < m:
        behind = lists.common if ranks[j] >= lists.cut and ranks[j - 1] < lists.cut else lists.suf
        bound += np.concatenate([behind[a:b] for a, b in zip(lo[:j], hi[:j])]) * np.float32(rest[j])
    go = np.flatnonzero(bound >= max(floor - slack, 1e-30))
    rows, bound = rows[go], bound[go]
    if len(rows) > 3 * HEADS:
        check_some(rows, bound)
        rows = rows[np.flatnonzero((bound >= floor - slack) & (sums[rows] > 0))]
    if len(rows):
        check(np.unique(rows))
    while j < m and rest[j] * longest >= floor - slack:
        a, b = lo[j], hi[j]
        if floor > slack and a >= lists.rare:
            b = a + int(np.searchsorted(lists.fall[a - lists.rare:b - lists.rare], np.float32((slack - floor) / rest[j]), "right"))
        bound = lists.weight[a:b] * np.float32(xs[j]) + lists.suf[a:b] * np.float32(rest[j + 1])
        go = np.flatnonzero(bound >= floor - slack)
        rows, bound = lists.rows[a:b][go].astype(np.int64), bound[go]
        go = np.flatnonzero(sums[rows] == 0)
        rows, bound = rows[go], bound[go]
        met.append(rows)
        if len(rows) > 3 * HEADS:
            check_some(rows, bound)
            rows = rows[np.flatnonzero((bound >= floor - slack) & (sums[rows] == 0))]
        if len(rows):
            check(rows)
        read, j = read + b - a, j + 1
    for rows in met:
        sums[rows] = 0.0
    lists.weights[r] = 0.0
    shared, sims = sum(hi) - sum(lo), np.round(sims, SIM_DIGITS)
    best, sims = best[sims > 0], sims[sims > 0]
    by = np.lexsort((lists.order[best], -sims))[:k]
    best, sims = best[by], sims[by]
    before = np.concatenate([[0], np.cumsum(lists.copies[best])])[np.searchsorted(-sims, -sims, "left")]
    return best[before < k], sims[before < k], shared, scored + read


def lexical_index(c: DataFrame, parts: int) -> DataFrame:
    """A written table of classes idx, w, members, _h (their hash) as _part, _row, idx, w, members; written.
    Classes are dealt to parts by hash; a part is bounded. Rows are numbered by their first key."""
    from stancekit.session import materialize

    c = c.withColumn("_part", F.pmod("_h", F.lit(parts)).cast("int"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy("members", "idx", "w")) - 1
    return materialize(c.select("_part", row.alias("_row"), "idx", "w", "members"), "lexical-classes")


def even_keys(spark, groups: int) -> list[int]:
    """A key (a long) for each of ``groups``, so that a shuffle by the key deals the groups evenly over its partitions."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = spark.range(64 * n).select(F.pmod(F.hash("id"), F.lit(n)).alias("p"), "id").groupBy("p").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    ids = {r["p"]: r["ids"] for r in keys.collect()}
    spots = sorted(ids)
    laps = -(-groups // len(spots))
    each = [(spots[g * len(spots) * laps // groups % len(spots)], g * len(spots) * laps // groups // len(spots)) for g in range(groups)]
    free = iter(range(64 * n, 64 * n + groups))
    return [ids[p][lap] if lap < len(ids[p]) else next(free) for p, lap in each]


def lexical_side(rows: DataFrame, keys, names: list[str]) -> DataFrame:
    """(names..., idx, w, _h) of the rows with keys and known terms; equal vectors have equal ``_h``."""
    x = rows.select(*[F.col(n).alias(a) for n, a in zip(keys, names)], "idx", F.col("weight").alias("w")).dropna(subset=[*names, "idx"])
    return x.where(F.size("idx") > 0).withColumn("_h", F.xxhash64("idx", "w"))


def lexical_search(q_rows: DataFrame, c_rows: DataFrame, k: int = 8, keys=("speech_id", "sent_idx"),
                   block_bytes: int = INDEX_BYTES, queries: int = 16) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, rows, asked). found: _q, _part, _row, sim of the k best of each part, and one row per task with a null _q
    that tells the postings its queries scored; rows: as ``lexical_index`` has them; asked: q0.., _q.

    Rows of one vector are one class: a class of the corpus keeps its ``k`` first keys (no more can be among a query's k best), a class of
    queries is searched once. The index is cut by bytes alone: the larger a part, the sooner a query has a floor that spares it most of
    the postings. Cores get work from blocks of queries, ``queries`` or more in each. A task has one block and one part, whose lists it makes itself."""
    from stancekit.session import materialize

    spark, keys = q_rows.sparkSession, list(keys)
    qk, ck = [f"q{j}" for j in range(len(keys))], [f"c{j}" for j in range(len(keys))]
    vector = ["_h", "idx", "w"]

    def written(x: DataFrame, name: str) -> tuple[DataFrame, int, int]:
        x = materialize(x, name)
        n, size = x.agg(F.count(F.lit(1)), F.sum(F.lit(16) * F.size("idx") + 64)).first()
        return x, n, -(-(size or 0) // block_bytes)

    all_q = materialize(lexical_side(q_rows, keys, qk), "lexical-queries")
    q, n, q_blocks = written(all_q.select(*vector).distinct().withColumn("_q", F.monotonically_increasing_id()), "lexical-query-classes")
    first = F.row_number().over(Window.partitionBy(*vector).orderBy(*ck))
    few = lexical_side(c_rows, keys, ck).withColumn("_n", first).where(F.col("_n") <= k)
    c, _, c_parts = written(few.groupBy(*vector).agg(F.sort_array(F.collect_list(F.struct(*ck))).alias("members")), "lexical-rows")
    parts, cores = max(1, c_parts), spark.sparkContext.defaultParallelism
    # the number of blocks by which all cores are at work to the end: groups are alike and take up whole rounds of tasks
    wide = range(max(1, cores // parts), max(1, cores // parts, 3 * cores // parts) + 1)
    blocks = max(1, q_blocks, min(min(wide, key=lambda b: (-(-parts * b // cores) / b, b)), n // queries))
    classes = lexical_index(c, parts)
    rows = classes.select("_part", "_row", "members")
    at = F.array(*[F.lit(x).cast("long") for x in even_keys(spark, blocks * parts)])
    at = F.get(at, F.col("_block") * parts + F.col("_part"))
    dealt_q = q.withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt_q = dealt_q.select(at.alias("_at"), "_q", "idx", "w")
    dealt_c = classes.withColumn("_copies", F.size("members")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt_c = dealt_c.select(at.alias("_at"), "_part", "_row", "_copies", "idx", "w")
    schema = pa.schema([("_q", pa.int64()), ("_part", pa.int32()), ("_row", pa.int32()), ("sim", pa.float64()), ("scored", pa.int64())])

    def flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chunks = [c for c in t.column("idx").chunks if len(c)]
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(np.asarray(c.offsets)) for c in chunks]))])
        w = [c for c in t.column("w").chunks if len(c)]
        return ends, np.concatenate([np.asarray(c.flatten()) for c in chunks]), np.concatenate([np.asarray(c.flatten()) for c in w])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return schema.empty_table()
        index = PostingLists.of_rows(*flat(b))
        row = b.column("_row").to_numpy()[index.number]
        index.order, index.copies, part = row, b.column("_copies").to_numpy()[index.number].astype(np.int64), b.column("_part")[0].as_py()
        ends, idx, w = flat(a)
        who, where, sims, scored = [], [], [], 0
        for i, lo, hi in zip(a.column("_q").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
            r, s, _, y = search_postings(index, index.longest, idx[lo:hi], w[lo:hi], k)
            who.append(np.full(len(r), i))
            where.append(row[r])
            sims.append(s)
            scored += y
        m = sum(map(len, where))
        q = pa.array(np.append(np.concatenate(who).astype(np.int64), 0), mask=np.arange(m + 1) == m)
        columns = [np.full(m + 1, part, np.int32), np.append(np.concatenate(where), -1).astype(np.int32), np.append(np.concatenate(sims), np.nan), np.append(np.zeros(m, np.int64), scored)]
        return pa.Table.from_arrays([q, *map(pa.array, columns)], schema=schema)

    found = dealt_q.groupBy("_at").cogroup(dealt_c.groupBy("_at")).applyInArrow(
        meet, "_q bigint, _part int, _row int, sim double, scored bigint")
    return found, rows, all_q.join(q, vector).select(*qk, "_q")


def knn_lexical(q_rows: DataFrame, c_rows: DataFrame, k: int = 8, keys=("speech_id", "sent_idx"),
                block_bytes: int = INDEX_BYTES) -> DataFrame:
    """Top-k tf-idf cosine neighbours over ``features.tfidf_rows`` (rows are
    L2-normalised, so cosine = dot). Only corpus rows sharing a term are neighbours.

    Exact, through an inverted index of which only rows that can be among a query's k best are scored
    (``search_postings``). Output: (q_<key>..., c_<key>..., rank, sim). Rows with a null key take no part.
    """
    keys = list(keys)
    qk, ck = [f"q{j}" for j in range(len(keys))], [f"c{j}" for j in range(len(keys))]
    found, rows, asked = lexical_search(q_rows, c_rows, k, keys, block_bytes)
    near = found.where("_row >= 0").join(rows, ["_part", "_row"]).select("_q", "sim", F.explode("members").alias("_m")).select("_q", "sim", "_m.*")
    best = ranked(near, ["_q"], ck, k).groupBy("_q").agg(F.collect_list(F.struct("sim", *ck)).alias("_b"))
    # rows may share a key: their neighbours are ranked together
    each = asked.join(best, "_q").select(*qk, F.explode("_b").alias("_e")).select(*qk, "_e.*")
    return ranked(each, qk, ck, k).select(*[F.col(a).alias(f"q_{n}") for a, n in zip(qk, keys)], *[F.col(a).alias(f"c_{n}") for a, n in zip(ck, keys)], "rank", "sim")


def lexical_work(q_rows: DataFrame, c_rows: DataFrame, k: int = 8, keys=("speech_id", "sent_idx"), block_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row: postings that queries and corpus share, and how many of them ``knn_lexical`` scores."""
    found, _, _ = lexical_search(q_rows, c_rows, k, keys, block_bytes)
    counted = lambda rows, n: lexical_side(rows, keys, [f"k{j}" for j in range(len(keys))]).select(F.explode("idx").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias(n))
    shared = counted(q_rows, "_a").join(counted(c_rows, "_b"), "term").agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("shared"))
    return shared.crossJoin(found.where("_row < 0").agg(F.coalesce(F.sum("scored"), F.lit(0)).alias("scored")))     # one row each


# ------------------------------------------------------------ approximate form
def unit_rows(v: pd.Series, dims: int) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype("float64") if len(v) else np.zeros((0, dims))
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


def sphere_cells(x: np.ndarray, cells: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centres (unit rows) of ``cells`` cells of the unit rows ``x``: k-means by inner product; empty cells keep their centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([(x[lo:lo + 4096] @ centres.T).argmax(1) for lo in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def probes_for(ranks: np.ndarray, cells: int, recall: float) -> int:
    """Fewest cells, nearest first, that hold ``recall`` of the true neighbours by two standard errors;
    ``ranks``: for a neighbour of a sampled row the place of its cell in that row's order."""
    found = np.cumsum(np.bincount(ranks, minlength=cells)[:cells]) / max(1, len(ranks))
    sure = found - 2 * np.sqrt(found * (1 - found) / max(1, len(ranks))) >= recall
    return int(np.argmax(sure)) + 1 if sure.any() else cells


def cell_search(qs: DataFrame, cs: DataFrame, k: int, recall: float = 0.9, seed: int = 7, sample: int = 256,
                trained: int = 65536, most_cells: int = 4096, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(q.., c.., sim of the k best of each task, met) for written tables q.., qv and c.., cv: an inverted list per cell of
    the sphere, and for each query the cells whose centres are nearest.

    10 sqrt(n) cells (``most_cells`` at most) are fitted on ``trained`` corpus rows by hash; every row is placed. How many
    cells a query opens is measured: for ``sample`` other rows (a quarter of a small corpus) the true neighbours are found exactly, and
    so many cells are opened that they hold ``recall`` of those. Lists are dealt to parts by cell and a query goes to the parts it opens a
    cell of. One row per task with null keys tells the pairs met."""
    from stancekit.session import materialize

    spark = cs.sparkSession
    qk, ck = [c for c in qs.columns if c != "qv"], [c for c in cs.columns if c != "cv"]
    n, dims = cs.agg(F.count(F.lit(1)), F.max(F.size("cv"))).first()
    by_hash = lambda frame, keys, m: frame.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(m)
    held = min(sample, n // 4)
    few = unit_rows(by_hash(cs, ck, min(n, trained + held)).select("cv").toPandas()["cv"], dims)[held:]     # bounded by ``trained`` and ``sample``
    centres = sphere_cells(few, int(min(most_cells, max(1, 10 * np.sqrt(n)))), seed)

    def nearest(v: pd.Series):
        """(from, cells of each row, nearest first, ties to the lower number) by slices of ``SLICE_CELLS`` numbers."""
        for lo in range(0, len(v), step := max(1, SLICE_CELLS // len(centres))):
            yield lo, np.argsort(-(unit_rows(v[lo:lo + step], dims) @ centres.T), axis=1, kind="stable")

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([(unit_rows(v[lo:lo + 4096], dims) @ centres.T).argmax(1) for lo in range(0, len(v), 4096)]) if len(v) else [], dtype="int32")

    c = materialize(cs.withColumn("_cell", cell("cv")), "cells")
    # rows that the cells were not fitted on, as queries: their true neighbours and the place of their cells
    some = materialize(by_hash(c, ck, held).select(*[F.col(a).alias(f"q{j}") for j, a in enumerate(ck)], F.col("cv").alias("vec")), "cell-sample")
    names = [f"q{j}" for j in range(len(ck))]
    near = blocked_topk(some, c.withColumnRenamed("cv", "vec"), names, ck, ["vec"], k + 1, dense_units)
    near = near.where(~_same(names, ck)).select(*names, *ck).join(some, names).join(c.select(*ck, "_cell"), ck)

    @F.pandas_udf("int")
    def place(v: pd.Series, at: pd.Series) -> pd.Series:
        out, own = np.zeros(len(v), "int32"), at.to_numpy()
        for lo, order in nearest(v):
            out[lo:lo + len(order)] = (order == own[lo:lo + len(order), None]).argmax(1)
        return pd.Series(out)

    ranks = np.array([r[0] for r in near.select(place("vec", "_cell")).collect()], dtype=np.int64)   # at most sample * (k + 1)
    opened = probes_for(ranks, len(centres), recall) if len(ranks) else len(centres)

    size = int(n) * (8 * int(dims or 1) + 64)
    blocks = max(1, -(-int(qs.count()) * (8 * int(dims or 1) + 64) // block_bytes))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks, -(-size // PART_BYTES)), -(-size // block_bytes))

    @F.pandas_udf("array<int>")
    def parts_of(v: pd.Series) -> pd.Series:
        return pd.Series([np.unique(r % parts).astype("int32") for _, order in nearest(v) for r in order[:, :opened]], dtype=object)

    dealt_q = qs.withColumn("_block", F.pmod(F.xxhash64(*qk), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(parts_of("qv")))
    dealt_c = c.withColumn("_part", F.col("_cell") % parts).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    columns = [*qk, *ck, "sim", "met"]

    def meet(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({x: pd.Series([], dtype=object) for x in columns})
        b = b.sort_values(ck, kind="stable").reset_index(drop=True)
        y, at = unit_rows(b["cv"], dims), b["_cell"].to_numpy()
        lists = {j: np.flatnonzero(at == j) for j in np.unique(at)}
        best_s, best_i, met = np.full((len(a), k), -np.inf), np.full((len(a), k), len(b)), 0
        for first, order in nearest(a["qv"]):
            open_ = np.zeros((len(order), len(centres)), bool)
            np.put_along_axis(open_, order[:, :opened], True, axis=1)
            x = unit_rows(a["qv"][first:first + len(order)], dims)
            for j, rows in lists.items():
                who = np.flatnonzero(open_[:, j])
                met += len(rows) * len(who)
                for lo in range(0, len(who), max(1, SCORE_CELLS // len(rows))):
                    w = who[lo:lo + max(1, SCORE_CELLS // len(rows))]
                    s = np.concatenate([best_s[first + w], np.round(x[w] @ y[rows].T, SIM_DIGITS)], axis=1)
                    i = np.concatenate([best_i[first + w], np.broadcast_to(rows, (len(w), len(rows)))], axis=1)
                    top = np.lexsort((i, -s), axis=1)[:, :k]
                    best_s[first + w], best_i[first + w] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        q, col = np.nonzero(np.isfinite(best_s))
        i = best_i[q, col]
        out = {m: pd.Series([*a[m].to_numpy(dtype=object)[q], None], dtype=object) for m in qk}
        out |= {m: pd.Series([*b[m].to_numpy(dtype=object)[i], None], dtype=object) for m in ck}
        return pd.DataFrame(out | {"sim": np.append(best_s[q, col], np.nan), "met": pd.Series([0] * len(q) + [met])})

    types = {**dict(qs.dtypes), **dict(cs.dtypes)}
    schema = ", ".join(f"{m} {types[m]}" for m in [*qk, *ck]) + ", sim double, met bigint"
    return dealt_q.groupBy("_block", "_part").cogroup(dealt_c.groupBy("_block", "_part")).applyInPandas(meet, schema)


def _same(a: list[str], b: list[str]):
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & (F.col(x) == F.col(y))
    return out


def lsh_model(corpus: DataFrame, vec: str, dims: int, bits: int, tables: int, seed: int, sample: int = 20000):
    """Random directions and their medians over a bounded sample of unit vectors, so that each
    bit halves the corpus: ``tables`` keys of ``bits`` bits (AND within a key, OR over tables)."""
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(tables, bits, dims))
    few = corpus.orderBy(F.xxhash64(F.lit(seed), vec)).limit(sample).select(vec).collect()   # bounded by ``sample``
    x = np.array([np.asarray(r[0], dtype="float64") for r in few]).reshape(-1, dims)
    x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
    if not len(x):
        return planes, np.zeros((tables, bits))
    planes = planes / np.linalg.norm(planes, axis=2)[:, :, None]
    return planes, np.median(np.einsum("nd,tbd->tbn", x, planes), axis=2)


def lsh_bits(sims: np.ndarray, shared: np.ndarray, kth: np.ndarray, most: int, tables: int, recall: float) -> tuple[int, float, float]:
    """(bits, cut, share of all pairs met) for the least work that holds ``recall``.

    ``sims`` and ``shared`` are the similarity of true neighbours of a query sample and the longest
    start their keys share in any table, so with keys of b bits a pair is met if ``shared >= b``. Pairs
    are put into ten groups by similarity; ``cut`` is the top of the highest group whose share of
    met pairs is not certain (two standard errors) to reach ``recall``. Queries with a k-th score up to
    ``cut`` are searched exactly, which ``kth`` (the sample's k-th scores) tells the share of.
    """
    best = (0, np.inf, 1.0)
    groups = [g for g in np.array_split(np.argsort(sims, kind="stable"), 10) if len(g)]
    for bits in range(1, most + 1):
        met = [(shared[g] >= bits).mean() for g in groups]
        low = [sims[g[-1]] for g, m in zip(groups, met) if m - 2 * np.sqrt(m * (1 - m) / len(g)) < recall]
        cut = max(low, default=-np.inf)
        share = tables / (1 << bits) + float((kth <= cut).mean())
        if share < best[2]:
            best = (bits, float(cut), share)
    return best


def knn_cosine_lsh(queries: DataFrame, corpus: DataFrame, k: int = 8, qid="qid", cid="cid", vec: str = "embedding",
                   tables: int = 14, bucket_rows: int = 32, least_bits: int = 5, salts: int = 8, seed: int = 7,
                   recall: float = 0.9, sample: int = 256, most_met: float = 0.25, work: list | None = None) -> DataFrame:
    """Approximate form: a bucket key of several projections per table, exact scores of
    the rows that share a bucket, top-k.

    ``recall`` holds at every size: ``sample`` queries are searched exactly and the bits are chosen
    from how long a start of the keys their true neighbours share (``lsh_bits``). Queries that met fewer
    than k rows, or whose k-th score is one at which neighbours are missed too often, are searched
    exactly. Where all this would meet more than ``most_met`` of all pairs (vectors without
    clusters), inverted lists over cells of the sphere are searched instead (``cell_search``), and exactly only queries
    that met fewer than k rows there. A bucket holds ``bucket_rows`` corpus rows or
    more; a hot one is split over ``salts``. ``work`` (a list) is given the share of all pairs met in the lists.
    """
    from stancekit.session import materialize

    q, c = _keys(qid), _keys(cid)
    qk, ck = [f"q{j}" for j in range(len(q))], [f"c{j}" for j in range(len(c))]
    qs = materialize(queries.where(F.col(vec).isNotNull()).select(*[F.col(n).alias(a) for n, a in zip(q, qk)], F.col(vec).cast("array<double>").alias("qv")), "lsh-q")
    cs = materialize(corpus.where(F.col(vec).isNotNull()).select(*[F.col(n).alias(a) for n, a in zip(c, ck)], F.col(vec).cast("array<double>").alias("cv")), "lsh-c")
    stat = cs.agg(F.count(F.lit(1)), F.max(F.size("cv"))).first()
    n, dims = stat[0], stat[1] or 1
    most = max(least_bits, int(np.ceil(np.log2(max(2, n / bucket_rows)))))
    planes, middle = lsh_model(cs, "cv", dims, most, tables, seed)

    def exact(some: DataFrame) -> DataFrame:
        return blocked_topk(some.withColumnRenamed("qv", "vec"), cs.withColumnRenamed("cv", "vec"), qk, ck, ["vec"], k, dense_units).select(*qk, *ck, "rank", "sim")

    def named(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(a).alias(b) for a, b in zip(qk, q)], *[F.col(a).alias(b) for a, b in zip(ck, c)], "rank", "sim")

    def sides(v: pd.Series, bits: int) -> np.ndarray:
        x = np.stack(v.to_numpy()).astype("float64") if len(v) else np.zeros((0, dims))
        x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        return np.einsum("nd,tbd->ntb", x, planes[:, :bits]) > middle[:, :bits]

    @F.pandas_udf("int")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.cumprod(sides(a, most) == sides(b, most), axis=2).sum(2).max(1).astype("int32"))

    # true neighbours of a bounded sample: at most sample * k rows
    few = materialize(qs.orderBy(F.xxhash64(F.lit(seed), *qk), *qk).limit(sample), "lsh-sample")
    pairs = cs.join(F.broadcast(exact(few).join(few, qk)), ck).select("rank", "sim", shared("qv", "cv").alias("shared")).collect()
    rank, sims, start = (np.array([r[j] for r in pairs]) for j in range(3))
    bits, cut, share = lsh_bits(sims, start, sims[rank == min(k, n)], most, tables, recall) if pairs else (0, 0.0, 1.0)
    if share > most_met and n:
        found = materialize(cell_search(qs, cs, k, recall, seed, sample), "cells-found")
        if work is not None:
            work.append((found.agg(F.sum("met")).first()[0] or 0) / max(1, n * qs.count()))
        near = ranked(found.where("sim is not null").drop("met"), qk, ck, k)
        full = near.groupBy(*qk).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min(k, n)).select(*qk)
        return named(near.join(full, qk, "left_semi").select(*qk, *ck, "rank", "sim").unionByName(exact(qs.join(full, qk, "left_anti"))))
    if share > most_met:
        return named(exact(qs))

    @F.pandas_udf("array<long>")
    def buckets(v: pd.Series) -> pd.Series:
        key = (sides(v, bits) * (1 << np.arange(bits))).sum(2) + (np.arange(tables) << 48)
        return pd.Series(list(key))

    cb = cs.select("*", F.explode(buckets("cv")).alias("_b")).withColumn("_s", F.pmod(F.xxhash64(*ck), F.lit(salts)))
    qb = qs.select("*", F.explode(buckets("qv")).alias("_b")).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    met = qb.join(cb, ["_b", "_s"])
    sim = F.round(F.col("_d") / F.greatest(norm(F.col("qv")) * norm(F.col("cv")), F.lit(1e-300)), SIM_DIGITS)
    scored = met.withColumn("_d", dot(F.col("qv"), F.col("cv"))).select(*qk, *ck, sim.alias("sim"))
    near = materialize(ranked(scored.distinct(), qk, ck, k), "lsh-near")
    full = near.groupBy(*qk).agg(F.count(F.lit(1)).alias("_n"), F.min("sim").alias("_k")).where((F.col("_n") >= min(k, n)) & (F.col("_k") > F.lit(cut))).select(*qk)
    out = near.join(full, qk, "left_semi").select(*qk, *ck, "rank", "sim").unionByName(exact(qs.join(full, qk, "left_anti")))
    return named(out)


def retrieved_docs(knn: DataFrame, corpus: DataFrame, qkeys, ckeys, text: str = "sentence",
                   code: str = "class_code", keys=("speech_id", "sent_idx"), salts: int = 16) -> DataFrame:
    """Per query: numbered lines '<rank>. "<sentence>" - Category (<letter>)' in rank order.

    A few corpus rows can be neighbours of most queries, so the join key is salted:
    neighbours are dealt over ``salts``, the corpus rows that occur at all are copied to each.
    """
    from stancekit.functions.labels import letter
    wanted = knn.select(*ckeys).distinct()
    c = corpus.select(*[F.col(a).alias(b) for a, b in zip(keys, ckeys)], text, code).join(wanted, list(ckeys), "left_semi")
    c = c.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    j = knn.withColumn("_salt", F.pmod(F.xxhash64(*qkeys), F.lit(salts))).join(c, [*ckeys, "_salt"])
    line = F.concat(F.col("rank").cast("string"), F.lit('. "'), F.col(text), F.lit('" - Category ('),
                    letter(F.col(code)), F.lit(")"))
    g = j.groupBy(*qkeys).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
    return g.select(*qkeys, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("retrieved"),
                    F.size("_l").alias("n_retrieved"))
