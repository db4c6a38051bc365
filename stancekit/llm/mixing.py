"""Mixing overlapping sources to target weights: a min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of sources are one pattern;
Spark sums their sizes, and only the table of patterns (one row each, at most ``MAX_PATTERNS``)
reaches the driver. There words flow from patterns to the quotas of their sources. Taking a
pattern again costs more the more often it has been taken (a convex cost, in slices of a quarter of its size), so
the cheapest largest flow repeats as little and as evenly as the quotas allow. It is found by the
primal-dual method: one slice more of every pattern at a time, then augmenting paths until none is left.

Each pattern's words are then taken from its documents in seeded order: all of them once for each whole
turn, and the first ones once more for the rest, the one on the border in part. The border is found by
counting words per digit of the order, a digit a pass, so no group of documents is ever sorted or
gathered whole, however many share a source.
"""
from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancekit.llm import common as C

MAX_PATTERNS = 200_000
WEIGHTS = (5, 2, 1)
SLICES = 4           # of a pattern's size; the cost of a word rises from slice to slice
DIGIT = 12           # bits of the order that one pass tells apart
SMALL = 4096         # documents behind one border that are sorted

MEMBERS = "array<string>"


def words(text: str) -> Column:
    """Number of maximal runs of other characters than the six ASCII white spaces (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights=WEIGHTS, share: Fraction = Fraction(3, 2), repeats: int = 2, total: int | None = None) -> dict:
    """Each source's target in words, exact: sources in order (null last) weigh ``weights``, repeating,
    and share ``share`` of ``total`` (all sizes); a target stops at ``repeats`` times its source's size, and the excess
    is shared again by weight until none is above. ``sizes``: source -> words."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest = share * (sum(sizes.values()) if total is None else total)
    open_, out = set(order), {}
    while open_:
        all_ = sum(weight[s] for s in open_)
        full = [s for s in open_ if rest * weight[s] > repeats * sizes[s] * all_]
        if not full:
            out |= {s: Fraction(rest * weight[s]) / all_ for s in open_}
            break
        for s in full:
            out[s] = Fraction(repeats * sizes[s])
            rest -= out[s]
            open_.discard(s)
    return out


def route(sizes: list[int], members: list[tuple], quota: dict, repeats: int = 2, slices: int = SLICES) -> list[dict]:
    """Words of each pattern for each of its sources: a largest flow of least cost.

    Word slice j of a pattern (``slices`` to a size) costs j; quotas are whole words. The network
    is source of all -> patterns -> sources -> sink; augmenting paths from a pattern are found breadth first.
    What one search without success has met can never reach the sink again and is left out from then on."""
    dead: set = set()
    flow: list[dict] = [dict.fromkeys(m, 0) for m in members]
    free = dict(quota)
    users: dict = {}
    for p, m in enumerate(members):
        for s in m:
            users.setdefault(s, set()).add(p)
    for level in range(1, repeats * slices + 1):
        for p, size in enumerate(sizes):
            more = size * level // slices - sum(flow[p].values())
            while more > 0 and ("p", p) not in dead:
                # breadth first: pattern -> its sources -> patterns that could give words of that source back
                came: dict = {("p", p): None}
                queue, end = [("p", p)], None
                for node in queue:
                    if node[0] == "p":
                        for s in members[node[1]]:
                            if ("s", s) not in came and ("s", s) not in dead:
                                came["s", s] = node
                                queue.append(("s", s))
                                if free[s] > 0:
                                    end = ("s", s)
                                    break
                    else:
                        for q in users[node[1]]:
                            if flow[q][node[1]] > 0 and ("p", q) not in came and len(members[q]) > 1:
                                came["p", q] = node
                                queue.append(("p", q))
                    if end:
                        break
                if end is None:
                    dead.update(queue)
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                give = min([more, free[end[1]], *(flow[path[k][1]][path[k - 1][1]] for k in range(2, len(path), 2))])
                for k in range(0, len(path), 2):
                    flow[path[k][1]][path[k + 1][1]] += give
                    if k:
                        flow[path[k][1]][path[k - 1][1]] -= give
                free[end[1]] -= give
                more -= give
    return flow


def digit(k: int) -> Column:
    """Digit ``k`` of the order: the 60 bits of the seeded hash, then those of the row's stamp."""
    half, at = divmod(k, 60 // DIGIT)
    return F.shiftright(F.col("hash" if not half else "stamp"), 60 - DIGIT * (at + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")


def seeded(seed: int, id_col: Column) -> Column:
    """60 bits of MD5 over ``seed:id``, which other engines reproduce (null id: empty)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def take(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """(id, pattern, size, taken) of every row. ``rows``: id, pattern, size, hash, stamp; ``quota``: pattern, turns,
    rest (words of the last turn), at most ``MAX_PATTERNS`` rows.

    A border per pattern narrows by a digit of the order a pass: words are summed per digit (map-side), the digit in which
    the rest runs out is the next border. Once few rows are left there, they are sorted."""
    borders = quota.where("rest > 0").select("pattern", F.col("rest").alias("left"), F.array().cast("array<int>").alias("prefix"))
    depth, n = 0, SMALL + 1
    while depth < 2 * (60 // DIGIT) and n > SMALL:
        inside = rows.join(F.broadcast(borders), "pattern").where(_prefix(depth) == F.col("prefix"))
        by = inside.groupBy("pattern", "prefix", "left", digit(depth).alias("d")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        # at most 2**DIGIT rows a pattern
        hit = by.withColumn("run", F.sum("s").over(Window.partitionBy("pattern").orderBy("d")))
        hit = hit.where((F.col("run") >= F.col("left")) & (F.col("run") - F.col("s") < F.col("left")))
        borders = C.written(hit.select("pattern", (F.col("left") - F.col("run") + F.col("s")).alias("left"),
                                       F.concat("prefix", F.array("d")).alias("prefix"), "n"), "mix-borders")
        n = borders.agg(F.max("n")).first()[0] or 0
        borders = borders.drop("n")
        depth += 1
    x = rows.join(F.broadcast(quota), "pattern").join(
        F.broadcast(borders.select("pattern", F.col("left").alias("_left"), F.col("prefix").alias("_prefix"))), "pattern", "left")
    x = x.withColumn("_at", _prefix(depth))
    on = F.col("_at") == F.col("_prefix")
    base = F.col("turns") * F.col("size")
    sure = x.where(~F.coalesce(on, F.lit(False))).withColumn("taken", base + F.when(F.col("_at") < F.col("_prefix"), F.col("size")).otherwise(F.lit(0)))
    ahead = F.sum("size").over(Window.partitionBy("pattern").orderBy("hash", "stamp").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    edge = x.where(on).withColumn("_before", ahead).withColumn(
        "taken", base + F.least(F.col("size"), F.greatest(F.col("_left") - F.col("_before"), F.lit(0))))
    return sure.select("id", "pattern", "size", "taken").unionByName(edge.select("id", "pattern", "size", "taken"))


def _prefix(depth: int) -> Column:
    return F.array(*[digit(k) for k in range(depth)]).cast("array<int>") if depth else F.array().cast("array<int>")


def mix(docs: DataFrame, members: Column, size: Column, id_col: str = "doc_id", weights=WEIGHTS, share: Fraction = Fraction(3, 2),
        repeats: int = 2, seed: int = 17) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, patterns, sources).

    documents: id, pattern (number), size, taken (words the mix takes, repeats counted; ``repeats`` times the
    size at most). patterns: pattern, members, size, routed (words to each member, in order).
    sources: source, source_size (words of all its documents), target, routed.

    ``members`` is an array of source names per document: order and repeats in it do not matter, null
    names are a source of their own (last in order). A document without any (null or empty) belongs to the null source. A
    document counts in the size of each of its sources; the shared total counts it once. Quotas are targets
    cut to whole words; what a source cannot get because others share its documents stays open. Null sizes are 0, null ids
    and repeated rows are rows of their own (which of two rows with one id is taken first depends on nothing but their place in
    the input), empty tables give empty results. Raises beyond ``MAX_PATTERNS`` patterns.
    """
    spark = docs.sparkSession
    names = F.array_sort(F.array_distinct(members))
    names = F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, F.array(F.lit(None).cast("string"))).otherwise(names)
    rows = C.written(docs.select(F.col(id_col).alias("id"), names.cast(MEMBERS).alias("members"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
                                 seeded(seed, F.col(id_col)).alias("hash"), F.monotonically_increasing_id().alias("stamp")), "mix-rows")
    found = rows.groupBy("members").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found = sorted(((tuple(r["members"]), int(r["size"])) for r in found), key=lambda x: [(n is None, n or "") for n in x[0]])
    sizes: dict = {}
    for m, n in found:
        for s in m:
            sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes, weights, share, repeats, sum(n for _, n in found))
    flow = route([n for _, n in found], [m for m, _ in found], {s: int(t) for s, t in want.items()}, repeats)
    table, quota, got = [], [], dict.fromkeys(sizes, 0)
    for k, ((m, n), f) in enumerate(zip(found, flow)):
        turns, rest = divmod(sum(f.values()), n) if n else (0, 0)
        table.append((k, list(m), n, [f[s] for s in m]))
        quota.append((k, list(m), turns, rest))
        for s in m:
            got[s] += f[s]
    patterns = spark.createDataFrame(table, f"pattern int, members {MEMBERS}, size bigint, routed array<bigint>")
    sources = spark.createDataFrame([(s, sizes[s], float(want[s]), got[s]) for s in sizes], "source string, source_size bigint, target double, routed bigint")
    some = spark.createDataFrame(quota, f"pattern int, members {MEMBERS}, turns bigint, rest bigint")
    numbered = rows.join(F.broadcast(some.select("members", "pattern")), "members").drop("members")
    out = take(numbered, some.drop("members")).withColumnRenamed("id", id_col)
    return out, patterns, sources


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((k - 1) % 3 + 1)::INT] AS weight, 1.5::DOUBLE * (SUM(source_size) OVER ())::DOUBLE AS budget FROM s),
-- in the order of size by weight a first part of the sources stops at twice its size
o AS (SELECT *, budget - coalesce(SUM(2 * source_size) OVER before, 0) AS rest, SUM(weight) OVER () - coalesce(SUM(weight) OVER before, 0) AS open
      FROM w WINDOW before AS (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, min(CASE WHEN rest * weight <= 2 * source_size * open THEN source_size / weight END) OVER () AS edge FROM o),
g AS (SELECT *, max(CASE WHEN rest * weight <= 2 * source_size * open AND source_size / weight = edge THEN rest END) OVER () AS last_rest,
        max(CASE WHEN rest * weight <= 2 * source_size * open AND source_size / weight = edge THEN open END) OVER () AS last_open FROM f),
t AS (SELECT source, source_size, CASE WHEN edge IS NULL OR source_size / weight < edge THEN 2.0 * source_size ELSE last_rest * weight / last_open END::DOUBLE AS target FROM g),
q AS (SELECT *, CAST(floor(target) AS BIGINT) AS quota FROM t),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, CASE WHEN q.source_size = 0 THEN 0 ELSE q.quota // q.source_size END AS turns,
        CASE WHEN q.source_size = 0 THEN 0 ELSE q.quota % q.source_size END AS rest,
        SUM(d.size) OVER (PARTITION BY d.source ORDER BY substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 15), d.doc_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS ahead
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (turns * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM r"""
