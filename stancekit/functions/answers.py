"""Model answers: stored text and parsing back to a label."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---
# letters searched in this order; the first one contained wins (not the leftmost)
LETTER_MARKS = [(" (a)", "a"), (" (b)", "b"), (" (c)", "c"), (" (d)", "d")]
# second stage, case-insensitive class-name search; 'both' is tested first
KEYWORDS = [("both", "d"), ("no populism", "a"), ("elitism", "b"), ("people", "c")]
# --- end of fixed values ---

# our own wording of the answer opening; it ends where the letter goes
ANSWER_OPENING = "The sentence belongs to category ("


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def answer_prefix(generated, opening: str = ANSWER_OPENING) -> Column:
    """Stored answer = fixed opening + generated text."""
    return F.concat(F.lit(opening), _c(generated))


def parse_letter(response) -> Column:
    r = _c(response)
    expr = None
    for mark, lab in LETTER_MARKS:
        cond = F.contains(r, F.lit(mark))
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


def parse_keyword(response) -> Column:
    r = F.lower(_c(response))
    expr = None
    for kw, lab in KEYWORDS:
        cond = F.contains(r, F.lit(kw))
        expr = F.when(cond, lab) if expr is None else expr.when(cond, lab)
    return expr


def parse_answer(response) -> Column:
    """Letter a..d from the answer, or null when nothing is found."""
    return F.coalesce(parse_letter(response), parse_keyword(response))
