"""Linear baseline: TF-IDF vectors, one linear SVM per label, relational scoring.

Vectors come from spark.ml; the fit is dual coordinate ascent over blocks of rows.
The learned weights are a small table (labels x vocabulary, bounded by
``max_features``), so scoring and explanation are broadcast joins.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from stancekit.functions.labels import N_LABELS

KEY = ["speech_id", "sent_idx"]


MAX_TERMS = 1_000_000   # largest vocabulary a driver and a task hold


def collect_vocabulary(vocab: DataFrame, most: int = MAX_TERMS) -> tuple[list[str], list[float]]:
    """Vocabulary to the driver, sorted by term; raises beyond ``most`` terms."""
    rows = vocab.select("term", "idf").orderBy("term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} terms")
    return [r[0] for r in rows], [float(r[1]) for r in rows]


SEPARATOR = "\x01"      # in no term: terms are word characters and spaces


def vectoriser(terms: list[str], input_col: str, out: str):
    """A CountVectorizer model of a given vocabulary; its terms cross to the JVM as one string, not one by one."""
    from pyspark import SparkContext
    from pyspark.ml.feature import CountVectorizerModel

    jvm = SparkContext._active_spark_context._jvm
    names = jvm.java.util.regex.Pattern.compile(SEPARATOR).split(SEPARATOR.join(terms), -1)
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", names)
    return model.setInputCol(input_col).setOutputCol(out)


def tfidf_vectors(df: DataFrame, terms: list[str], idf: list[float], input_col: str = "grams",
                  out: str = "features", keep_counts: str | None = None) -> DataFrame:
    """Sparse tf-idf vectors, L2-normalised; map-only (no shuffle, no UDF).

    ``keep_counts`` names a column for the plain term counts."""
    from pyspark.ml.feature import ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    cv = vectoriser(terms, input_col, "_tf")
    ep = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf")
    nz = Normalizer(p=2.0, inputCol="_tfidf", outputCol=out)
    x = nz.transform(ep.transform(cv.transform(df))).drop("_tfidf")
    return x.withColumnRenamed("_tf", keep_counts) if keep_counts else x.drop("_tf")


BLOCK_ROWS = 131072    # training rows of a block, the unit of a local solve,
BLOCK_CELLS = 1 << 20  # and its terms
PIECE_ROWS = 2048      # rows of a block that stand in one row of a table
BLOCK = "block bigint, label int, ptr array<int>, idx array<int>, val array<double>, y array<double>, cap array<double>, alpha array<double>, move array<double>"


def packed_blocks(vecs: DataFrame, gold: str, features: str, weight: Column, C: float, k: int) -> DataFrame:
    """Training rows as blocks (rows of sparse arrays), each once a label, with their dual variables, all zero; written.

    A block stands in pieces one after the other, so that no table has a row of a block's size: readers, writers and shuffles hold whole
    rows in the JVM, several at a time. The blocks of a partition stand in a file a label, so that labels do not wait for each other.
    y: label by row, +1 or -1; cap: C times the row's weight. A null gold vector or member counts as 0."""
    from stancekit.session import materialize

    v = F.unwrap_udt(F.col(features))
    rows = [vecs.select(v["indices"].alias("idx"), v["values"].alias("val"), F.when(F.coalesce(F.get(F.col(gold), j), F.lit(0)) > 0, 1.0).otherwise(-1.0).alias("y"),
                        (weight * F.lit(float(C))).alias("cap"), F.spark_partition_id().alias("pid"), F.lit(j).alias("label")) for j in range(k)]

    def pack(batches):
        kept, seq = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, min(BLOCK_ROWS, 4096)):
                kept.append(batch.slice(lo, min(BLOCK_ROWS, 4096)))
                if sum(b.num_rows for b in kept) >= BLOCK_ROWS or sum(len(b.column("idx").flatten()) for b in kept) >= BLOCK_CELLS:
                    yield from pieces(kept, seq)
                    kept, seq = [], seq + 1
        if sum(b.num_rows for b in kept):
            yield from pieces(kept, seq)

    def pieces(kept, seq):
        block = (int(kept[0].column("pid")[0].as_py()) << 32) + seq
        for batch in kept:
            for lo in range(0, batch.num_rows, PIECE_ROWS):
                yield one(batch.slice(lo, PIECE_ROWS), block)

    def one(b, block):
        n, idx = b.num_rows, b.column("idx")
        ptr = np.asarray(idx.offsets).astype(np.int32)
        columns = [pa.array(ptr - ptr[0]), idx.flatten(), b.column("val").flatten(), b.column("y"), b.column("cap"), pa.array(np.zeros(n)), pa.array(np.zeros(n))]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), b.column("label").slice(0, 1), *[pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]],
                                          ["block", "label", "ptr", "idx", "val", "y", "cap", "alpha", "move"])

    # the coalesce joins nothing: with a partitioning that Spark doesn't know, a union keeps single partitions apart
    return materialize(reduce(DataFrame.unionByName, [x.mapInArrow(pack, BLOCK).coalesce(1 << 20) for x in rows]), "svm-blocks")


def local_ascent(ptr, idx, val, row, norm, y, cap, alpha, w, sigma: float, epochs: int, seed: int) -> np.ndarray:
    """Dual variables of one block and label after ``epochs`` passes of coordinate ascent.

    Each pass takes, in seeded order, the rows whose variable can move; a step maximises the block's part of the dual, in which
    the block's own changes count ``sigma`` times, since other blocks make like ones meanwhile."""
    # rows are short: plain lists beat array calls here
    rng, w = np.random.default_rng(seed), w.tolist()
    out, ys, caps, norms, ends, js, xs = alpha.tolist(), y.tolist(), cap.tolist(), norm.tolist(), ptr.tolist(), idx.tolist(), val.tolist()
    for _ in range(epochs):
        slack = 1 - y * (np.bincount(row, weights=val * np.array(w)[idx], minlength=len(y)) + w[-1])
        now = np.array(out)
        moving = np.flatnonzero(((slack > 1e-6) & (now < cap)) | ((slack < -1e-6) & (now > 0)))
        if not len(moving):
            break
        for i in rng.permutation(moving).tolist():
            a, b = ends[i], ends[i + 1]
            dot = w[-1]
            for j, x in zip(js[a:b], xs[a:b]):
                dot += w[j] * x
            new = min(caps[i], max(0.0, out[i] + (1 - ys[i] * dot) / (sigma * norms[i])))
            if new != out[i]:
                change = sigma * (new - out[i]) * ys[i]
                out[i] = new
                for j, x in zip(js[a:b], xs[a:b]):
                    w[j] += change * x
                w[-1] += change
    return np.array(out)


def ascent_round(blocks: DataFrame, w: np.ndarray, mean: np.ndarray, share: np.ndarray, sigma: float, epochs: int, seed: int) -> DataFrame:
    """One round over all blocks from the weights ``w`` (labels x terms and a constant). The dual variables first go
    ``share`` (a number a label) of their last moves; new moves come from ``local_ascent``. Behind the blocks, in
    ``at`` and ``by``: what the moves add to the weights (position in the flat matrix), then label by label the hinge loss
    under ``mean``, the sum of the dual variables and that of their moves. Written."""
    from stancekit.session import materialize

    k, size = w.shape

    def run(batches):
        kept, at = [], None
        for batch in batches:
            for r in range(batch.num_rows):
                piece = batch.slice(r, 1)
                now = int(piece.column("block")[0].as_py()), int(piece.column("label")[0].as_py())
                if kept and now != at:
                    yield from solve(kept, *at)
                    kept = []
                kept, at = [*kept, piece], now
        if kept:
            yield from solve(kept, *at)

    def solve(kept, block, j):
        lists = {c: [np.asarray(p.column(c)[0].values) for p in kept] for c in names[2:]}
        long = np.concatenate([np.diff(x) for x in lists["ptr"]])
        ptr = np.concatenate([[0], np.cumsum(long)])
        idx, val, y, cap, alpha, move = (np.concatenate(lists[c]) for c in names[3:])
        n = len(cap)
        row = np.repeat(np.arange(n, dtype=np.int32), long)
        norm = np.bincount(row, weights=val * val, minlength=n) + 1
        old = np.clip(alpha + share[j] * move, 0.0, cap)
        hinge = float(cap @ np.maximum(0.0, 1 - y * (np.bincount(row, weights=val * mean[j][idx], minlength=n) + mean[j][-1])))
        step = local_ascent(ptr, idx, val, row, norm, y, cap, old, w[j], sigma, epochs, seed + block % 65536) - old
        change = step * y
        sums = np.bincount(idx, weights=val * change[row], minlength=size - 1)
        terms = np.flatnonzero(np.bincount(idx, minlength=size - 1))
        at = np.concatenate([j * size + terms, [(j + 1) * size - 1], k * size + j + k * np.arange(3)]).astype(np.int64)
        by = np.concatenate([sums[terms], [change.sum(), hinge, old.sum(), step.sum()]])
        lo = 0
        for i, p in enumerate(kept):                     # the sums stand with the first piece
            hi = lo + len(lists["cap"][i])
            yield pa.RecordBatch.from_arrays(
                [p.column(c) for c in names[:7]]
                + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (old[lo:hi], step[lo:hi], at[:0] if i else at, by[:0] if i else by)],
                [*names, "at", "by"])
            lo = hi

    names = ["block", "label", "ptr", "idx", "val", "y", "cap", "alpha", "move"]
    return materialize(blocks.select(*names).mapInArrow(run, BLOCK + ", at array<bigint>, by array<double>"), "svm-round")


def train_linear_svm(vecs: DataFrame, terms: list[str], gold: str = "gold_vec", features: str = "features",
                     weight_col: str | None = None, C: float = 1.0, max_iter: int = 50,
                     k: int = N_LABELS, gap: float = 0.02, epochs: int = 5, report: list | None = None) -> tuple[DataFrame, DataFrame]:
    """One hinge-loss linear SVM per label: min 1/2 |w|^2 + C sum of weight * max(0, 1 - y (w x + b)), b one more weight.

    Dual coordinate ascent by blocks: in a round every block improves its own dual variables for all labels in place,
    against the common weights; the moves of all blocks are then taken together, as far along as raises the dual most. A round is one pass over the rows without a
    shuffle of them, and is written with its dual variables, so a lost executor repeats tasks of one round at most.
    The result is a running mean of the rounds' weights, whose loss swings less. Its primal objective and the dual one of the
    variables bound the optimum from both sides: rounds end
    when their gap is at most ``gap`` of the primal for every label, or after ``max_iter``. ``report`` is given, per label,
    (primal, dual) of the result. ``features`` are sparse vectors, as the vectoriser makes them.

    Returns (coef(term, label, weight), bias(label, bias)).
    """
    spark: SparkSession = vecs.sparkSession
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    # as few blocks as their size allows: what one block holds is solved as a whole
    blocks = packed_blocks(vecs.coalesce(max(1, -(-vecs.count() // BLOCK_ROWS))), gold, features, weight, C, k)
    parts = blocks.where("label = 0").select("block").distinct().count()
    sigma = max(1.0, parts / 2)                # how often a block counts its own changes
    epochs = epochs if parts > 1 else 2 * epochs
    w, share, best, low = np.zeros((k, len(terms) + 1)), np.zeros(k), None, np.zeros(k)
    mean = w
    for t in range(max_iter + 1):
        blocks = ascent_round(blocks, w, mean, share, sigma, epochs, 1000 * t)
        sums = blocks.select(F.explode(F.arrays_zip("at", "by")).alias("e")).groupBy("e.at").agg(F.sum("e.by").alias("by")).toPandas()
        flat = np.zeros(w.size + 3 * k)                       # labels x terms, and three numbers a label
        flat[sums["at"].to_numpy(dtype=np.int64)] = sums["by"].to_numpy()
        move = flat[:w.size].reshape(w.shape)
        hinge, alpha, gain = flat[w.size:].reshape(3, k)
        norm = (w * w).sum(1) / 2
        primal = (mean * mean).sum(1) / 2 + hinge
        low = np.maximum(low, alpha - norm)
        best = [(p, x.copy()) if best is None or p < best[j][0] else best[j] for j, (p, x) in enumerate(zip(primal, mean))]
        if all(p - d <= gap * max(p, 1e-12) for (p, _), d in zip(best, low)):
            break
        # the dual is a parabola along all moves together: its top, or the whole way if the top lies beyond
        square = (move * move).sum(1)
        share = np.clip(np.divide(gain - (w * move).sum(1), square, out=np.ones(k), where=square > 0), 0.0, 1.0)
        w = w + share[:, None] * move
        mean = mean + (w - mean) * (4 / (t + 4))              # later rounds weigh more
    if report is not None:
        report += [(float(p), float(d)) for (p, _), d in zip(best, low)]
    w = np.stack([x for _, x in best])
    coef_rows = [(t, j, float(x)) for j in range(k) for t, x in zip(terms, w[j])]
    coef = spark.createDataFrame(coef_rows, "term string, label int, weight double")
    bias = spark.createDataFrame([(j, float(w[j][-1])) for j in range(k)], "label int, bias double")
    return coef, bias


def collect_coef(coef: DataFrame, most: int = MAX_TERMS):
    """(terms, labels, weights, known) of the coefficients, labels x terms; raises beyond ``most`` terms a label and where a
    term has two weights for a label."""
    rows = coef.where(F.col("term").isNotNull() & F.col("label").isNotNull()).select("term", "label", "weight").limit(N_LABELS * most + 1).toPandas()
    if len(rows) > N_LABELS * most:
        raise ValueError(f"there are more than {N_LABELS * most} coefficients")
    if rows.duplicated(["term", "label"]).any():
        raise ValueError("a term has more than one weight for a label")
    terms, at = np.unique(rows["term"].to_numpy(dtype=object), return_inverse=True)
    labels, j = np.unique(rows["label"].to_numpy(dtype=np.int64), return_inverse=True)
    weights, known = np.zeros((len(labels), len(terms))), np.zeros((len(labels), len(terms)), dtype=bool)
    weights[j, at], known[j, at] = rows["weight"].to_numpy(dtype=np.float64), rows["weight"].notna().to_numpy()
    return pa.array(terms.tolist(), pa.string()), labels, weights, known


def flat_terms(batch, names):
    """Of a batch with aligned arrays ``terms`` and ``weight``: the terms one after the other, the row, the place in ``names`` (-1:
    none) and the weight of each."""
    import pyarrow.compute as pc

    column = batch.column("terms")
    row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    at = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy(zero_copy_only=False)
    return flat, row, at, batch.column("weight").flatten().to_numpy(zero_copy_only=False)


def score_linear(tfidf: DataFrame, rows: DataFrame, coef: DataFrame, bias: DataFrame,
                 keys=KEY, k: int = N_LABELS) -> DataFrame:
    """(keys..., label, margin, pred): sum of weight * value plus bias, pred = margin > 0.

    ``tfidf`` is long (keys..., term, weight) or by row (keys..., terms, weight: aligned arrays, as ``tfidf_rows`` gives them).
    By row the products are added up in the row, so one number a label leaves it instead of one a term and label.
    Rows without any known term still get the bias: every row contributes a
    zero per label to the same aggregate (one shuffle, no outer join).
    """
    if "terms" in tfidf.columns:
        return _margins(row_sums(tfidf, coef, keys), rows, bias, keys, k)
    return score_linear_long(tfidf, rows, coef, bias, keys, k)


def row_sums(tfidf_rows: DataFrame, coef: DataFrame, keys=KEY) -> DataFrame:
    """(keys..., label, _c): per row and label the sum of coefficient * value over the row's known terms."""
    keys = list(keys)
    names, labels, weights, known = collect_coef(coef)
    weights = np.where(known, weights, 0.0)

    def run(batches):
        for batch in batches:
            _, row, at, value = flat_terms(batch, names)
            row, at, value = row[at >= 0], at[at >= 0], value[at >= 0]
            for label, w in zip(labels, weights):
                sums = np.bincount(row, weights=value * w[at], minlength=batch.num_rows).astype(np.float64)   # of nothing: integers
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(np.full(batch.num_rows, label, dtype=np.int32)), pa.array(sums)], [*keys, "label", "_c"])

    x = tfidf_rows.select(*keys, "terms", "weight")
    return x.mapInArrow(run, StructType([*x.schema.fields[:len(keys)], StructField("label", IntegerType()), StructField("_c", DoubleType())]))


def _margins(contrib, rows, bias, keys, k):
    zeros = rows.select(*keys, F.explode(F.array(*[F.lit(j) for j in range(k)])).alias("label"),
                        F.lit(0.0).alias("_c"))
    sums = contrib.unionByName(zeros).groupBy(*keys, "label").agg(F.sum("_c").alias("_s"))
    out = sums.join(F.broadcast(bias), "label").withColumn("margin", F.col("_s") + F.col("bias"))
    return out.select(*keys, "label", "margin", (F.col("margin") > 0).cast("int").alias("pred"))


def linear_contributions(tfidf_long: DataFrame, coef: DataFrame, keys=KEY) -> DataFrame:
    """(keys..., term, label, contribution = coef * tf-idf value)."""
    c = coef.withColumnRenamed("weight", "_coef")
    return tfidf_long.join(F.broadcast(c), "term").select(
        *keys, "term", "label", (F.col("weight") * F.col("_coef")).alias("contribution"))


def row_relevance(rows: DataFrame, coef: DataFrame) -> DataFrame:
    """``rows`` (..., class_id, terms, weight: aligned arrays) with coefficient * value as ``relevance`` instead of the weight, the
    terms those that the class has a coefficient of. Map-only."""
    names, labels, weights, known = collect_coef(coef)
    keep = [f for f in rows.schema.fields if f.name not in ("terms", "weight")]
    kept = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            flat, row, at, value = flat_terms(batch, names)
            cls = batch.column("class_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            j = np.searchsorted(labels, cls)
            ok = (j < len(labels)) & (np.append(labels, -1)[j] == cls)
            stay = np.flatnonzero((at >= 0) & ok[row])
            stay = stay[known[j[row[stay]], at[stay]]]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[stay], minlength=batch.num_rows))]).astype(np.int32))
            found = weights[j[row[stay]], at[stay]] * value[stay]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(ends, flat.take(pa.array(stay))),
                                              pa.ListArray.from_arrays(ends, pa.array(found))], [*kept, "terms", "relevance"])

    x = rows.select(*kept, "terms", "weight")
    return x.mapInArrow(run, StructType([*keep, StructField("terms", ArrayType(StringType())), StructField("relevance", ArrayType(DoubleType()))]))


def score_linear_long(tfidf_long: DataFrame, rows: DataFrame, coef: DataFrame, bias: DataFrame,
                      keys=KEY, k: int = N_LABELS) -> DataFrame:
    keys = list(keys)
    contrib = linear_contributions(tfidf_long, coef, keys).select(*keys, "label", F.col("contribution").alias("_c"))
    return _margins(contrib, rows, bias, keys, k)


def predictions(margins: DataFrame, keys=KEY, k: int = N_LABELS) -> DataFrame:
    """Long margins -> one row per key with ``logits`` and ``pred_vec`` arrays."""
    keys = list(keys)
    g = margins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("label", "margin", "pred"))).alias("_m"))
    return g.select(*keys, F.transform("_m", lambda s: s["margin"]).alias("logits"),
                    F.transform("_m", lambda s: s["pred"]).alias("pred_vec"))


def top_terms(coef: DataFrame, n: int = 10) -> DataFrame:
    """n highest and n lowest weights per label: (label, direction, rank, term, weight).

    One pass over the coefficient table (bounded by labels x vocabulary):
    both ranks come from windows over the same input, then one filter.
    """
    w_hi = Window.partitionBy("label").orderBy(F.col("weight").desc(), "term")
    w_lo = Window.partitionBy("label").orderBy(F.col("weight").asc(), "term")
    r = coef.select("label", "term", "weight", F.row_number().over(w_hi).alias("_hi"),
                    F.row_number().over(w_lo).alias("_lo")).where((F.col("_hi") <= n) | (F.col("_lo") <= n))
    sides = F.array(F.struct(F.lit("positive").alias("direction"), F.col("_hi").alias("rank")),
                    F.struct(F.lit("negative").alias("direction"), F.col("_lo").alias("rank")))
    x = r.select("label", "term", "weight", F.explode(sides).alias("_s"))
    return x.where(F.col("_s.rank") <= n).select("label", F.col("_s.direction").alias("direction"),
                                                  F.col("_s.rank").alias("rank"), "term", "weight")
