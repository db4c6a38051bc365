"""String and array expressions over sentences."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
# a sentence ends after '.', '!' or '?' followed by spaces or newlines
SENTENCE_BREAK = r"(?<=[.!?])[ \n]+"
# vectoriser token: a run of two or more letters, digits or underscores
TOKEN_PATTERN = r"([\p{L}\p{N}_]{2,})"
# three or more newlines collapse to two
NEWLINE_RUN = "\n{3,}"
# --- end of fixed values ---


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def split_sentences(text) -> Column:
    """Text -> array of trimmed, non-empty sentences (break after . ! ?)."""
    parts = F.split(_c(text), SENTENCE_BREAK, -1)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def words(s) -> Column:
    """Space-split units; empty pieces count (like str.split(' '))."""
    return F.split(_c(s), " ", -1)


def word_count(s) -> Column:
    return F.size(words(s))


def truncate_words(s, n: int = 48) -> Column:
    """Keep the first n space-split words when the sentence is longer."""
    w = words(s)
    return F.when(F.size(w) > n, F.array_join(F.slice(w, 1, n), " ")).otherwise(_c(s))


def tokenize(s) -> Column:
    """Lower-cased runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(_c(s)), F.lit(TOKEN_PATTERN), 1)


def ngrams(tokens, lo: int = 1, hi: int = 3) -> Column:
    """All lo..hi-grams of a token array, joined by a space (n-grams in order).

    Built from shifted slices with ``zip_with``; the token array is only an
    argument, never re-evaluated per element.
    """
    t = _c(tokens)
    size = F.size(t)
    grams = {1: t}
    for n in range(2, hi + 1):
        m = F.greatest(size - n + 1, F.lit(0))
        grams[n] = F.zip_with(F.slice(grams[n - 1], 1, m), F.slice(t, n, m),
                              lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(*[grams[n] for n in range(lo, hi + 1)])


def collapse_newlines(s) -> Column:
    return F.regexp_replace(_c(s), NEWLINE_RUN, "\n\n")


def inject_before(s, marker: str, text: str) -> Column:
    """Insert ``text`` before every occurrence of ``marker`` (plain replace)."""
    return F.replace(_c(s), F.lit(marker), F.lit(text + marker))


def tsv_text(s) -> Column:
    """Text as stored in one TSV field: tabs and line breaks become spaces."""
    return F.regexp_replace(_c(s), "[\t\r\n]", " ")
