"""Attribution of predictions to terms, tokens and words.

For a linear model relevance is exactly weight x input, so it is a join.
For neural models the input is a token table with gradients computed
elsewhere. Merging works inside a row's arrays, in time linear in the tokens and
without an exchange: token starts are found first, then the arrays are cut
once. The two left-to-right rules that are not associative (hyphens,
symbols) are regular: one letter per token is written into a string, and a
regular expression's matches, leftmost and without overlap, are the merged runs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["speech_id", "sent_idx"]
# --- fixed values ---
BPE_MARK = "Ġ"
PIECE_MARKS = ("##", "_")
OPEN_SYMBOLS = ["(", "$", "€", '"', "'"]
CLOSE_SYMBOLS = [")", "%", '"', "'"]
# contraction rules per tokenizer family: pieces split in two (first keeps the score)
SPLIT_TWO_CHARS = {"roberta": [").", "),", ".,"], "gpt2": [").", "),", ".,"], "t5": [").", "),", ".,", "”."]}
SPLIT_LAST_CHAR = {"roberta": ["didn", "don", "Don"], "gpt2": ["didn", "don", "Don", "ĠDon"],
                   "t5": ["didn", "don", "Don", "▁Don"]}
SPLIT_CANNOT = ["cannot"]  # -> 'can', 'not'
T5_NUMBER_PUNCT = "^▁*[0-9]+[.,]"       # split off the last character
T5_PAREN_NUMBER = "^▁\\([0-9]+\\)"      # split as [:2], [2:-1], [-1]
T5_DOLLAR_NUMBER = "^▁\\$[0-9]+"        # split as [:2], [2:]
# --- end of fixed values ---


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# ------------------------------------------------------------ linear models
def relevance_linear(tfidf: DataFrame, coef: DataFrame, explained: DataFrame, keys=KEY, by_row: bool = False) -> DataFrame:
    """(keys..., class_id, term, relevance = coef * value) for every explained class.

    ``tfidf`` is long (keys..., term, weight) or by row (keys..., terms, weight: aligned arrays, as ``tfidf_rows`` gives them). By
    row, rows meet their classes before they are cut into terms; ``by_row`` leaves them whole: (keys..., class_id, terms, relevance)."""
    keys = list(keys)
    if "terms" in tfidf.columns:
        from stancekit.operators.linear import row_relevance

        x = row_relevance(explained.select(*keys, "class_id").join(tfidf.select(*keys, "terms", "weight"), keys), coef)
        if by_row:
            return x
        e = x.select(*keys, "class_id", F.explode(F.arrays_zip("terms", "relevance")).alias("_e"))
        return e.select(*keys, "class_id", F.col("_e.terms").alias("term"), F.col("_e.relevance").alias("relevance"))
    c = F.broadcast(coef.select("term", F.col("label").alias("class_id"), F.col("weight").alias("_w")))
    j = tfidf.join(explained.select(*keys, "class_id"), keys).join(c, ["term", "class_id"])
    return j.select(*keys, "class_id", "term", (F.col("weight") * F.col("_w")).alias("relevance"))


def conservation(relevance: DataFrame, explained: DataFrame, keys=KEY) -> DataFrame:
    """Per (row, class): summed relevance against the class logit; gap = logit - sum.

    ``explained`` carries the logit of each class to explain; both sides are added up in
    one aggregate, so a row without a known term keeps its logit and no join is needed."""
    keys = list(keys)
    parts = relevance.select(*keys, "class_id", F.col("relevance").alias("_r"), F.lit(None).cast("double").alias("_l")).unionByName(
        explained.select(*keys, "class_id", F.lit(0.0).alias("_r"), F.col("logit").alias("_l")))
    sums = parts.groupBy(*keys, "class_id").agg(F.sum("_r").alias("sum_relevance"), F.max("_l").alias("logit"))
    return sums.where(F.col("logit").isNotNull()).withColumn("gap", F.col("logit") - F.col("sum_relevance"))


def conservation_summary(cons: DataFrame, expected_gap: float = 0.0) -> DataFrame:
    return cons.agg(F.count(F.lit(1)).alias("n"),
                    F.max(F.abs(F.col("gap") - F.lit(expected_gap))).alias("max_gap_error"),
                    F.corr("sum_relevance", "logit").alias("corr"))


# ------------------------------------------------------------ token tables
def relevance_grad_input(grad, inp) -> Column:
    """Sum over dimensions of gradient x input."""
    return F.aggregate(F.zip_with(_c(grad), _c(inp), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def relevance_grad_l1(grad) -> Column:
    """L1 norm of the gradient."""
    return F.aggregate(F.transform(_c(grad), lambda x: F.abs(x)), F.lit(0.0), lambda acc, v: acc + v)


def select_logit(logits, class_id) -> Column:
    return F.get(_c(logits), _c(class_id).cast("int"))


def margin_to_runner_up(logits) -> Column:
    """Top logit minus the strongest other one."""
    s = F.sort_array(_c(logits), asc=False)
    return F.get(s, 0) - F.get(s, 1)


def argmax(logits) -> Column:
    """Position of the largest logit (lowest on ties)."""
    return F.array_position(_c(logits), F.array_max(_c(logits))) - 1


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a lambda's argument)."""
    return F.get(F.transform(F.array(value), body), 0)


def token_arrays(tokens: DataFrame, keys=KEY) -> DataFrame:
    """Long token rows -> (keys..., toks, scores) arrays in position order (one sentence per group)."""
    keys = list(keys)
    g = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "score"))).alias("_t"))
    return g.select(*keys, F.transform("_t", lambda x: x["token"]).alias("toks"),
                    F.transform("_t", lambda x: x["score"]).alias("scores"))


def merged_rows(arrays: DataFrame, merged: Column, keys=KEY, word: str = "word") -> DataFrame:
    """(keys..., word_idx, word, score) rows of a merge over arrays; map-only."""
    x = arrays.select(*list(keys), F.posexplode(merged).alias("word_idx", "_w"))
    return x.select(*list(keys), "word_idx", F.col("_w.token").alias(word), F.col("_w.score").alias("score"))


def _cut(toks: Column, scores: Column, starts: Column, score, text=None) -> Column:
    """Arrays cut at the ``starts`` (ascending positions): array<struct<token, score>>.

    ``score`` turns an array of scores into one; ``text`` (start, end, size, joined) may change a word."""
    def words(x):
        n = F.size(x["t"])

        def word(a, j):
            end = F.coalesce(F.get(x["at"], j + 1), n)
            joined = F.array_join(F.slice(x["t"], a + 1, end - a), "")
            return F.struct((text(a, end, n, joined) if text else joined).alias("token"),
                            score(F.slice(x["s"], a + 1, end - a)).cast("double").alias("score"))
        return F.transform(x["at"], word)

    return bound(F.struct(toks.alias("t"), scores.alias("s"), starts.alias("at")), words)


def _where(flags: Column) -> Column:
    """Positions at which an array of booleans is true."""
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())


def _sum(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)


def words_max(toks, scores, mark: str = BPE_MARK) -> Column:
    """Merge marked pieces into words; score = max of the pieces.

    The first and the last token stand alone; a word starts at position 1 or
    at a piece carrying ``mark``; the mark is removed from merged words.
    """
    t, s = _c(toks), _c(scores)
    starts = bound(t, lambda x: _where(F.transform(x, lambda w, i: (i <= 1) | (i == F.size(x) - 1) | w.startswith(mark))))
    return _cut(t, s, starts, F.array_max, lambda a, end, n, w: F.when((a == 0) | (end == n), w).otherwise(F.replace(w, F.lit(mark), F.lit(""))))


def words_sum(toks, scores, marks=PIECE_MARKS) -> Column:
    """Merge continuation pieces ('##' or '_' prefixed) into words; score = sum."""
    t, s = _c(toks), _c(scores)

    def joins(w):
        c = F.lit(False)
        for m in marks:
            c = c | w.startswith(m)
        return c

    def bare(w):
        out = w
        for m in reversed(marks):
            out = F.when(w.startswith(m), F.substring(w, len(m) + 1, 1 << 30)).otherwise(out)
        return out

    return _cut(F.transform(t, bare), s, _where(F.transform(t, lambda w, i: (i == 0) | ~joins(w))), _sum)


def merge_words_max(tokens: DataFrame, keys=KEY, mark: str = BPE_MARK) -> DataFrame:
    """``words_max`` over a long token table: (keys..., word_idx, word, score)."""
    return merged_rows(token_arrays(tokens, keys), words_max("toks", "scores", mark), keys)


def merge_words_sum(tokens: DataFrame, keys=KEY, marks=PIECE_MARKS) -> DataFrame:
    """``words_sum`` over a long token table: (keys..., word_idx, word, score)."""
    return merged_rows(token_arrays(tokens, keys), words_sum("toks", "scores", marks), keys)


def _regular(toks: Column, scores: Column, letter, pattern: str, replacement: str) -> Column:
    """Merge runs that a regular expression over one letter per token matches; the
    replacement turns a run's first letter into 's', the mark of a start."""
    letters = F.array_join(F.transform(toks, letter), "")
    marks = F.regexp_extract_all(F.regexp_replace(letters, pattern, replacement), F.lit("."), 0)
    return _cut(toks, scores, _where(F.transform(marks, lambda m: m == "s")), _sum)


def merge_hyphens(toks, scores) -> Column:
    """'x', '-', 'y' become one token with summed score; left to right, no overlap."""
    return _regular(_c(toks), _c(scores), lambda w: F.when(w == "-", "h").otherwise("x"), ".(h.)?", "s$1")


def merge_symbols(toks, scores) -> Column:
    """Glue an opening symbol to the next token and a closing one to the previous."""
    both = [x for x in OPEN_SYMBOLS if x in CLOSE_SYMBOLS]
    letter = lambda w: (F.when(w.isin(*both), "B").when(w.isin(*OPEN_SYMBOLS), "O")
                        .when(w.isin(*CLOSE_SYMBOLS), "C").otherwise("x"))
    return _regular(_c(toks), _c(scores), letter, "[OB](.[CB]?)|[xC]([CB]?)|.", "s$1$2")


def split_contractions(token, family: str = "roberta") -> Column:
    """One piece -> array of (token, keeps_score) pieces by the family's rules."""
    x = _c(token)

    def pieces(*parts):
        return F.array(*[F.struct(p.alias("token"), F.lit(i == 0).alias("first")) for i, p in enumerate(parts)])

    n = F.length(x)
    two = SPLIT_TWO_CHARS.get(family, [])
    last = SPLIT_LAST_CHAR.get(family, [])
    expr = F.when(x.isin(*two), pieces(F.substring(x, 1, 1), F.substring(x, 2, 1 << 30))) if two else None

    def add(e, cond, val):
        return F.when(cond, val) if e is None else e.when(cond, val)
    if family == "t5":
        expr = add(expr, x.rlike(T5_NUMBER_PUNCT), pieces(F.substring(x, 1, n - 1), F.substring(x, n, 1)))
        expr = add(expr, x.rlike(T5_PAREN_NUMBER), pieces(F.substring(x, 1, 2), F.substring(x, 3, n - 3), F.substring(x, n, 1)))
        expr = add(expr, x.rlike(T5_DOLLAR_NUMBER), pieces(F.substring(x, 1, 2), F.substring(x, 3, 1 << 30)))
    if last:
        expr = add(expr, x.isin(*last), pieces(F.substring(x, 1, n - 1), F.substring(x, n, 1)))
    expr = add(expr, x.isin(*SPLIT_CANNOT), pieces(F.substring(x, 1, 3), F.substring(x, 4, 1 << 30)))
    return expr.otherwise(pieces(x))


def split_contraction_rows(tokens: DataFrame, family: str = "roberta", keys=KEY) -> DataFrame:
    """Token rows -> split rows (keys, pos, sub, token, score); later parts score 0."""
    keys = list(keys)
    x = tokens.select(*keys, "pos", "score", F.posexplode(split_contractions(F.col("token"), family)).alias("sub", "_p"))
    return x.select(*keys, "pos", "sub", F.col("_p.token").alias("token"),
                    F.when(F.col("_p.first"), F.col("score")).otherwise(F.lit(0.0)).alias("score"))


def normalize_relevance(df: DataFrame, by, score: str = "score", out: str = "norm_score") -> DataFrame:
    """Divide by the largest absolute score of the row (0 stays 0)."""
    m = F.max(F.abs(F.col(score))).over(Window.partitionBy(*by))
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(score), m), F.lit(0.0)))


def word_relevance_summary(df: DataFrame, word: str = "term", cls: str = "class_id", rel: str = "relevance",
                           n: int = 20) -> DataFrame:
    """Per class the n words of largest total relevance, with mean and count.

    The word aggregate is partial (map-side); the per-class top-n is a
    limited window, so no class ever lands whole in one task.
    """
    g = df.groupBy(cls, word).agg(F.sum(rel).alias("total"), F.avg(rel).alias("mean"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(cls).orderBy(F.col("total").desc(), word)
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# ------------------------------------------------------------ pieces to words
NORMALIZE = "[^a-zA-Z0-9.]"   # fixed value: characters compared when aligning


def _starts(lengths: Column) -> Column:
    """The sum of the lengths before each entry. Linear: entry i is written length + 1 times,
    and where its first copy stands, i copies too many stand before it."""
    copies = F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n + 1)))
    return bound(copies, lambda c: F.filter(
        F.transform(c, lambda i, e: F.when((e == 0) | (F.get(c, e - 1) != i), e - i)), lambda v: v.isNotNull()))


def _owners(lengths: Column) -> Column:
    """For each character of the joined entries the entry that holds it."""
    return F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n)))


def align_words(pieces, scores, words, agg: str = "max") -> Column:
    """Pieces of one sentence mapped onto its words: array<struct<word_idx, word, text, score,
    aligned>> by word; map-only, linear in the characters but for one sort of the pieces.

    Both sides are normalised to ``[a-zA-Z0-9.]``; running lengths give character offsets. A
    piece belongs to the word whose span holds its start. Pieces without
    normalised text meet empty words at the same offset in order, otherwise they join the word
    ending there. A piece without such a word goes to the nearest one (the last empty word
    at its offset, else the first word; no word at all: index null) and that word is not aligned, so no
    score is lost. Null arrays are empty; null pieces and words are empty texts; null scores
    are left out (all null: null).
    """
    if agg not in ("max", "sum"):
        raise ValueError("agg is 'max' or 'sum'")
    bare = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), NORMALIZE, "")
    paired = bound(
        F.struct(F.coalesce(_c(pieces), F.array().cast("array<string>")).alias("p"),
                 F.coalesce(_c(scores).cast("array<double>"), F.array().cast("array<double>")).alias("s"),
                 F.coalesce(_c(words), F.array().cast("array<string>")).alias("w")),
        lambda x: F.struct(F.slice(x["p"], 1, F.least(F.size(x["p"]), F.size(x["s"]))).alias("p"), x["s"].alias("s"), x["w"].alias("w"),
                           F.transform(x["w"], bare).alias("bare")))

    def rows(x):
        lengths = F.struct(F.transform(x["p"], lambda t: F.length(bare(t))).alias("p"),
                           F.transform(x["bare"], lambda t: F.length(t)).alias("w"))
        offsets = bound(lengths, lambda n: F.struct(
            n["p"].alias("np"), n["w"].alias("nw"), _starts(n["p"]).alias("p"), _starts(n["w"]).alias("w"),
            _owners(n["p"]).alias("op"), _owners(n["w"]).alias("ow")))
        ordered = F.sort_array(bound(offsets, lambda o: F.transform(o["np"], lambda n, i: place(x, o, n, i))))
        cuts = bound(ordered, lambda z: F.struct(z.alias("z"), _where(
            F.transform(z, lambda v, k: (k == 0) | ~F.get(z, k - 1)["word"].eqNullSafe(v["word"]))).alias("at")))
        return bound(cuts, lambda c: F.transform(c["at"], lambda a, j: bound(
            F.slice(c["z"], a + 1, F.coalesce(F.get(c["at"], j + 1), F.size(c["z"])) - a), lambda g: word(x, g))))

    def place(x, o, n, i):
        """The word of piece i: the entries that start at its offset follow the owner of the character before."""
        at, chars = F.get(o["p"], i), F.size(o["ow"])
        after = lambda owners: F.when(at > 0, F.get(owners, at - 1) + 1).otherwise(0)
        same = after(o["ow"]) + i - after(o["op"])
        meets = F.coalesce((n == 0) & (F.get(o["nw"], same) == 0) & (F.get(o["w"], same) == at), F.lit(False))
        start = F.when(n > 0, at).otherwise(F.greatest(at - 1, F.lit(0)))
        nearest = F.when(F.size(x["w"]) > 0, F.when(at == 0, F.size(x["w"]) - 1).otherwise(0))
        return F.struct(F.when(meets, same).when(chars > 0, F.get(o["ow"], F.least(start, chars - 1))).otherwise(nearest).alias("word"),
                        i.alias("i"), (~meets & (chars == 0)).alias("lost"))

    def word(x, g):
        w = F.get(g, 0)["word"]
        text = F.array_join(F.transform(g, lambda v: F.coalesce(F.get(x["p"], v["i"]), F.lit(""))), "")
        got = F.filter(F.transform(g, lambda v: F.get(x["s"], v["i"])), lambda v: v.isNotNull())
        score = F.array_max(got) if agg == "max" else bound(got, lambda v: F.when(F.size(v) > 0, _sum(v)))
        return bound(text, lambda t: F.struct(
            w.cast("bigint").alias("word_idx"), F.get(x["w"], w).alias("word"), t.alias("text"), score.alias("score"),
            F.coalesce(~F.exists(g, lambda v: v["lost"]) & (bare(t) == F.get(x["bare"], w)), F.lit(False)).alias("aligned")))

    return bound(paired, rows)


def align_to_words(pieces: DataFrame, words: DataFrame, agg: str = "max", keys=KEY) -> DataFrame:
    """``align_words`` over long tables.

    pieces: (keys..., pos, piece, score) without special tokens or markers;
    words: (keys..., word_idx, word), numbered from 0. Each side is gathered per sentence and
    joined on its key. Output: (keys..., word_idx, word, text, score, aligned).
    """
    keys = list(keys)
    p = token_arrays(pieces.withColumnRenamed("piece", "token"), keys)
    w = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("word_idx", "word"))).alias("_w"))
    w = w.select(*keys, F.transform("_w", lambda x: x["word"]).alias("words"))
    return aligned_rows(p.join(w, keys, "left"), agg, keys)


def aligned_rows(arrays: DataFrame, agg: str = "max", keys=KEY) -> DataFrame:
    """Rows of ``align_words`` for a table with toks, scores and words arrays."""
    keys = list(keys)
    x = arrays.select(*keys, F.explode(align_words("toks", "scores", "words", agg)).alias("_a"))
    return x.select(*keys, "_a.word_idx", "_a.word", "_a.text", "_a.score", "_a.aligned")
