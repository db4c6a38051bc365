"""TF-IDF features over n-grams, kept as a long (row, term, weight) table.

Upsampled copies are carried as a weight column instead of physical rows:
document frequency, corpus term counts and the document total all count
``copies``, which equals fitting on the duplicated rows without writing them.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.functions.text import tokenize
from stancekit.session import spread

KEY = ["speech_id", "sent_idx"]


def _weight(weight_col: str | None) -> Column:
    return F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")


def with_grams(df: DataFrame, text_col: str = "sentence", out: str = "grams", lo: int = 1, hi: int = 3) -> DataFrame:
    """Add the lo..hi-grams of the lower-cased tokens as an array column.

    Tokens are extracted once; spark.ml ``NGram`` (compiled sliding window)
    builds the longer grams in the same 'a b c' form as ``functions.text.ngrams``.
    """
    return grams_of(df.withColumn("_tok", tokenize(F.col(text_col))), "_tok", out, lo, hi)


def grams_of(df: DataFrame, tokens: str, out: str = "grams", lo: int = 1, hi: int = 3) -> DataFrame:
    """``with_grams`` of a column of tokens, which it replaces."""
    from pyspark.ml.feature import NGram

    x, cols = df, []
    for n in range(lo, hi + 1):
        if n == 1:
            cols.append(tokens)
        else:
            x = NGram(n=n, inputCol=tokens, outputCol=f"_g{n}").transform(x)
            cols.append(f"_g{n}")
    return x.withColumn(out, F.concat(*cols)).drop(*{tokens, *cols})


def counted(grams: str) -> Column:
    """Array column of grams -> array<struct<term, tf>> by term, counted in the row.

    The sorted array is bound once by an outer ``transform``, so the work is that of the sort.
    """
    def runs(s):
        starts = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return F.struct(s.alias("s"), starts.alias("at"))

    def entries(x):
        return F.transform(x["at"], lambda st, j: F.struct(
            F.get(x["s"], st).alias("term"),
            (F.coalesce(F.get(x["at"], j + 1), F.size(x["s"])) - st).cast("long").alias("tf")))

    sorted_once = F.transform(F.array(F.sort_array(grams)), runs)
    return F.flatten(F.transform(sorted_once, entries))


def term_counts(df: DataFrame, keys=KEY, text_col: str = "sentence", lo: int = 1, hi: int = 3,
                extra: list[str] | None = None) -> DataFrame:
    """(keys..., term, tf): n-gram frequency per row, counted inside the row (no shuffle)."""
    extra = extra or []
    grams = with_grams(spread(df.select(*keys, *extra, text_col), *keys), text_col, "_grams", lo, hi)
    return counted_rows(grams, [*keys, *extra])


def counted_rows(grams: DataFrame, keep: list[str]) -> DataFrame:
    rows = grams.select(*keep, F.explode(counted("_grams")).alias("_e"))
    return rows.select(*keep, "_e.term", "_e.tf")


BUCKETS = 1 << 22
WIDE = 4           # buckets counted exactly at first, per feature asked for
SLICE_TOKENS = 1 << 19   # tokens that a task holds as numbers at a time; a longer row is taken alone


def token_slices(batches, column: str, weight: str):
    """Slices of rows as numbers: (words, code, hashed, row, left, w). ``words`` are the slice's distinct tokens; per token its
    place there, its hash, its row and how many tokens of the row stand from it on; ``w`` is the weight by row."""
    import pandas as pd

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
            part, sizes = batch.slice(lo, hi - lo), np.diff(ends[lo:hi], prepend=before)
            lo = hi
            coded = part.column(column).flatten().dictionary_encode()
            if len(coded):
                left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(coded))
                words, code = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy().astype(np.int64)
                hashed = pd.util.hash_array(words, categorize=False)[code]
                yield words, code, hashed, np.repeat(np.arange(len(sizes)), sizes), left, part.column(weight).to_numpy()


def gram_buckets(hashed: np.ndarray, at: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Hash bucket of the n-gram of tokens from each place ``at``: equal n-grams, equal bucket, in every task."""
    x = hashed[at]
    for m in range(1, n):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashed[at + m]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def _weighed(rows: DataFrame, column: str, weight_col: str | None) -> DataFrame:
    return rows.select(F.col(column), _weight(weight_col).alias("_w")).where(F.col(column).isNotNull() & F.col("_w").isNotNull())


def plausible(rows: DataFrame, weight_col: str | None = None, min_df: int = 20, column: str = "_grams", lo: int = 1, hi: int = 1) -> DataFrame:
    """(_bucket, _n): the hash buckets, of ``BUCKETS``, whose weighted occurrences reach ``min_df``, counted over the
    lo..hi-grams of the array ``column`` (its entries alone where ``hi`` is 1).

    A term's document frequency is at most its bucket's sum, so a bucket below the limit holds no
    term of the vocabulary. A task holds one number a bucket and sends at most ``BUCKETS`` pairs of numbers, however many
    distinct n-grams it meets; no n-gram is built as a string."""
    from stancekit.session import materialize

    buckets = BUCKETS

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for _, _, hashed, row, left, w in token_slices(batches, column, "_w"):
            for n in range(lo, hi + 1):
                at = np.flatnonzero(left >= n)
                np.add.at(total, gram_buckets(hashed, at, n, buckets), w[row[at]])
        met = np.flatnonzero(total)
        for i in range(0, len(met), 1 << 16):
            some = met[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["_bucket", "_n"])

    counts = _weighed(rows, column, weight_col).mapInArrow(count, "_bucket int, _n long")
    sums = counts.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    return materialize(sums.where(F.col("_n") >= min_df), "vocabulary-sketch")


def bucket_terms(rows: DataFrame, some: DataFrame, weight_col: str | None = None, column: str = "_grams", lo: int = 1, hi: int = 1) -> DataFrame:
    """(term, tf, _w): how often, by weight, a row holds a term ``tf`` times, for the terms whose bucket is in ``some`` (_bucket),
    added up in slices of rows; a term comes once a slice and ``tf``. Terms are the lo..hi-grams that ``plausible`` counts.

    The buckets travel as one bit each, at most ``BUCKETS``. Counting is by exact codes of the tokens, so two terms of one bucket stay apart."""
    buckets = BUCKETS
    bits = np.zeros(buckets, dtype=bool)
    bits[some.toPandas()["_bucket"].to_numpy(dtype=np.int64)] = True
    bits = np.packbits(bits)

    def count(batches):
        asked = np.unpackbits(bits, count=buckets).astype(bool)
        for words, code, hashed, row, left, w in token_slices(batches, column, "_w"):
            for n in range(lo, hi + 1):
                at = np.flatnonzero(left >= n)
                at = at[asked[gram_buckets(hashed, at, n, buckets)]]
                if not len(at):
                    continue
                gram = code[at]
                for m in range(1, n):       # numbered anew by every token added: stays below 2^63
                    gram = np.unique(gram, return_inverse=True)[1] * len(words) + code[at + m]
                _, first, gram = np.unique(gram, return_index=True, return_inverse=True)
                pairs, tf = np.unique(gram * (row[-1] + 1) + row[at], return_counts=True)
                gram, by = pairs // (row[-1] + 1), w[pairs % (row[-1] + 1)]
                most = int(tf.max()) + 1
                kinds, place = np.unique(gram * most + tf, return_inverse=True)
                sums = np.zeros(len(kinds), dtype=np.int64)
                np.add.at(sums, place, by)
                start = at[first]
                terms = words[code[start]]
                for m in range(1, n):
                    terms = terms + " " + words[code[start + m]]
                yield pa.RecordBatch.from_arrays([pa.array(terms[kinds // most], pa.string()), pa.array(kinds % most), pa.array(sums)], ["term", "tf", "_w"])

    return _weighed(rows, column, weight_col).mapInArrow(count, "term string, tf long, _w long")


def document_total(df: DataFrame, weight_col: str | None = None) -> Column:
    """Number of documents (copies included) as a scalar subquery column."""
    return df.agg(F.sum(_weight(weight_col)).alias("n")).scalar()


def vocabulary(terms: DataFrame, n_docs: Column, min_df: int = 20, max_df: float = 0.5,
               max_features: int = 10000, weight_col: str | None = None) -> DataFrame:
    """Terms with min_df <= df <= max_df * n, then the max_features most frequent.

    Ranking is by total count, ties by term. The term shuffle is a partial
    (map-side combined) aggregate, so a stop term cannot skew it. Output is
    bounded by ``max_features`` rows, which is what makes it safe to broadcast.
    """
    w = _weight(weight_col)
    stats = terms.groupBy("term").agg(
        F.sum(w).alias("df"),
        F.sum(F.col("tf") * w).alias("ctf"),
    )
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs))
    top = kept.orderBy(F.col("ctf").desc(), F.col("term")).limit(max_features)
    return top.withColumn("idf", idf(F.col("df"), n_docs))


def idf(df_col: Column, n_docs: Column) -> Column:
    """Smoothed idf: ln((1 + n) / (1 + df)) + 1."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df_col)) + F.lit(1.0)


def tfidf_rows(df: DataFrame, vocab: DataFrame, keys=KEY, text_col: str = "sentence", lo: int = 1, hi: int = 3) -> DataFrame:
    """(keys..., idx, terms, tf, weight): one row per input row, its known terms as aligned
    arrays (positions in the vocabulary by term, terms, counts, L2-normalised tf * idf).

    Map-only: the vocabulary (at most ``max_features`` terms) travels in the
    vectoriser and as one value in the plan, no exploded row crosses the network.
    """
    from stancekit.operators.linear import SEPARATOR, collect_vocabulary, tfidf_vectors

    terms, idf_values = collect_vocabulary(vocab)
    grams = with_grams(spread(df.select(*keys, text_col), *keys), text_col, "_grams", lo, hi)
    if not terms:
        none = [F.array().cast(t).alias(n) for n, t in (("idx", "array<int>"), ("terms", "array<string>"), ("tf", "array<bigint>"), ("weight", "array<double>"))]
        return grams.select(*keys, *none)
    x = tfidf_vectors(grams, terms, idf_values, "_grams", "_w", keep_counts="_n")
    x = x.select(*keys, F.unwrap_udt("_n").alias("_n"), F.unwrap_udt("_w").alias("_w"))
    # the dictionary is one value, split once when the plan is made: no expression a term
    names = F.split(F.lit(SEPARATOR.join(terms)), SEPARATOR, -1)
    return x.select(*keys, F.col("_n.indices").alias("idx"),
                    F.transform(F.col("_n.indices"), lambda i: F.get(names, i)).alias("terms"),
                    F.transform(F.col("_n.values"), lambda v: v.cast("long")).alias("tf"), F.col("_w.values").alias("weight"))


def tfidf(df: DataFrame, vocab: DataFrame, keys=KEY, text_col: str = "sentence", lo: int = 1, hi: int = 3) -> DataFrame:
    """(keys..., term, tf, weight): tf * idf, L2-normalised per row; map-only."""
    x = tfidf_rows(df, vocab, keys, text_col, lo, hi)
    e = x.select(*keys, F.explode(F.arrays_zip("terms", "tf", "weight")).alias("_e"))
    return e.select(*keys, F.col("_e.terms").alias("term"), "_e.tf", "_e.weight")


def fit_vocabulary(train: DataFrame, keys=KEY, text_col: str = "sentence", weight_col: str | None = None,
                   min_df: int = 20, max_df: float = 0.5, max_features: int = 10000, lo: int = 1, hi: int = 3) -> DataFrame:
    """The vocabulary with idf, written once (at most ``max_features`` rows): the many
    plans that read it (vectors, scoring, retrieval) do not repeat the corpus pass.

    Two passes: a sketch (``plausible``) sums the occurrences by hash bucket, which bounds the count and the document
    frequency of every term in a bucket; then rows are counted by slices and only terms of the largest buckets, ``WIDE`` a
    feature, are built as strings and go into the term aggregate. If the last term so chosen is counted at least as often as the least of these
    buckets, no other bucket holds a term of the vocabulary. Else the second pass is made again over all buckets that
    can hold one. Most distinct n-grams are rare, so most never cross the network as strings, however many there are.
    """
    from stancekit.session import materialize

    extra = [weight_col] if weight_col else []
    # cut once: both passes read tokens
    tokens = materialize(spread(train.select(*keys, *extra, text_col), *keys).select(*extra, tokenize(F.col(text_col)).alias("_tok")), "vocabulary-tokens")
    able = plausible(tokens, weight_col, min_df, "_tok", lo, hi)
    n_docs = document_total(tokens, weight_col)

    def over(least: int) -> DataFrame:
        some = able.where(F.col("_n") >= least).select("_bucket")                     # at most BUCKETS rows
        kept = bucket_terms(tokens, some, weight_col, "_tok", lo, hi)
        return materialize(vocabulary(kept, n_docs, min_df, max_df, max_features, "_w"), "vocabulary")

    n, least = able.orderBy(F.col("_n").desc()).limit(WIDE * max_features).agg(F.count(F.lit(1)), F.min("_n")).first()
    if n < WIDE * max_features or least <= min_df:
        return over(min_df)
    vocab = over(least)
    n, last = vocab.agg(F.count(F.lit(1)), F.min("ctf")).first()
    sure = max(min_df, last) if n == max_features and n else min_df
    return vocab if sure >= least else over(sure)
