"""Pieces mapped onto words in plain Python: what ``align_words`` is held against."""
from __future__ import annotations

import bisect
import re

from stancekit.operators.attribution import NORMALIZE


def align_row(pieces: list[str], scores: list[float], words: list[str], agg: str = "max") -> list[dict]:
    """Pieces of one sentence mapped onto its words, in one pass over both.

    Both sides are normalised to ``[a-zA-Z0-9.]``; running lengths give character offsets. A
    piece belongs to the word whose span holds its start. Pieces without
    normalised text meet empty words at the same offset in order, otherwise they join the word
    ending there. A piece without such a word goes to the nearest one (the last empty word
    at its offset, else the first word; no word at all: index None) and that word is not aligned, so no
    score is lost.
    """
    bare = [re.sub(NORMALIZE, "", w or "") for w in words]
    at, starts, holders, empties = 0, [], [], {}
    for i, w in enumerate(bare):
        if w:
            starts.append(at)
            holders.append(i)
            at += len(w)
        else:
            empties.setdefault(at, []).append(i)
    out: dict = {}
    used: dict[int, int] = {}
    lost = set()
    at = 0
    for piece, score in zip(pieces, scores):
        n = len(re.sub(NORMALIZE, "", piece or ""))
        where = at if n else max(at - 1, 0)
        k = bisect.bisect_right(starts, where) - 1
        here = empties.get(at, [])
        if not n and used.get(at, 0) < len(here):
            word = here[used.get(at, 0)]
            used[at] = used.get(at, 0) + 1
        elif k >= 0:
            word = holders[k]
        else:
            word = here[-1] if here else (0 if words else None)
            lost.add(word)
        out.setdefault(word, []).append((piece or "", score))
        at += n
    rows = []
    for word in sorted(out, key=lambda i: -1 if i is None else i):
        text = "".join(p for p, _ in out[word])
        got = [s for _, s in out[word] if s is not None]
        target = None if word is None else words[word]
        rows.append({"word_idx": word, "word": target, "text": text,
                     "score": (max(got) if agg == "max" else float(sum(got))) if got else None,
                     "aligned": word not in lost and word is not None and re.sub(NORMALIZE, "", text) == bare[word]})
    return rows
