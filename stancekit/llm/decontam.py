"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are put into classes by size (u/2 < shingles <= u, u a power of two). For
each class a document is read in windows of 2u shingles, u apart, so that any copy
of an item lies whole in some window of like size, however long the document: the
overlap of item and window is then at least 0.19 of their union when 0.8 of
the item is there. A window is a candidate if one of ``hashes`` minima equals the
item's (a miss: below 2e-6). Candidates are verified by exact containment: the share
of the item's distinct word shingles that the whole document has. An item of fewer words
than a shingle is one shingle, all its words: classes of their own, one a number of words,
looked up in the document's shingles of that many words.

The items are the small side: they go to the tasks in blocks of at most ``block_words``
words (a longer item alone), one block after the other. For each block the documents pass once, row by row, without a
shuffle; what a pass finds or keeps is written before the next block is read, so neither
the driver nor a task holds more than one block.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancekit.llm import common as C
from stancekit.llm.features import _joined

SHINGLE, LEAST, HASHES, BLOCK_WORDS = 5, 0.8, 64, 1_000_000
_WORD = C.byte_class(C.ALNUM)
MATCH = "array<struct<item_id:bigint,shared:int,total:int>>"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and the rows they are of."""
    starts, ends, first = C.spans(data, offsets, _WORD)
    return C.span_hashes(data, starts, ends), np.repeat(np.arange(len(offsets) - 1), np.diff(first))


def folded(text: str | None) -> str:
    return pc.utf8_lower(pa.scalar(text or "")).as_py()


def word_shingles(text: str | None, n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Distinct n-word shingles: words are runs of anything but ASCII signs and spaces, in lower case."""
    raw = np.frombuffer(folded(text).encode(), np.uint8)
    starts, ends, _ = C.spans(raw, np.array([0, len(raw)]), _WORD)
    b = raw.tobytes()
    w = [b[s:e].decode() for s, e in zip(starts, ends)]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


@dataclass
class Items:
    """One block of test items, ready to be searched for."""
    ids: list
    sets: list[set]
    hashes: list[np.ndarray]
    width: list[int]                                         # words in a shingle: n, or all words of a shorter item
    mult: np.ndarray
    classes: dict[int, list] = field(default_factory=dict)   # u -> per hash: (values, item numbers, bit table)
    short: dict[int, tuple] = field(default_factory=dict)    # words -> (hashes, item numbers)

    @classmethod
    def of(cls, rows: list[tuple], n: int, hashes: int, seed: int) -> "Items":
        mult = np.random.default_rng(seed).integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        out = cls([], [], [], [], mult)
        for key, text in rows:
            raw = np.frombuffer(folded(text).encode(), np.uint8)
            h, row = _words(raw, np.array([0, len(raw)]))
            if len(h):
                out.ids.append(key)
                out.width.append(min(n, len(h)))
                out.sets.append(word_shingles(text, out.width[-1]))
                out.hashes.append(np.unique(_joined(h, row, out.width[-1], out.width[-1])[0]))
        width = np.array(out.width, np.int64)
        for m in np.unique(width[width < n]):
            who = np.flatnonzero(width == m)
            values = np.array([out.hashes[k][0] for k in who], np.uint64)
            order = np.argsort(values, kind="stable")
            out.short[int(m)] = (values[order], who[order])
        size = np.array([1 << int(np.ceil(np.log2(len(g)))) if m == n else 0 for g, m in zip(out.hashes, out.width)], np.int64)
        for u in np.unique(size[size > 0]):
            who = np.flatnonzero(size == u)
            per = []
            for a in mult:
                low = np.array([(out.hashes[k] * a).min() for k in who], np.uint64)
                order = np.argsort(low, kind="stable")
                bits = np.zeros(1 << 16, bool)
                bits[(low & np.uint64(0xFFFF)).astype(np.int64)] = True
                per.append((low[order], who[order], bits))
            out.classes[int(u)] = per
        return out

    def short_candidates(self, h: np.ndarray, row: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs of items that are one shingle; equal hashes, not yet equal words."""
        found: set[tuple[int, int]] = set()
        for m, (values, who) in self.short.items():
            g, grow = _joined(h, row, m, m)
            lo, hi = np.searchsorted(values, g, "left"), np.searchsorted(values, g, "right")
            for at in np.flatnonzero(hi > lo):
                found.update((int(grow[at]), int(k)) for k in who[lo[at]:hi[at]])
        return found

    def candidates(self, g: np.ndarray, grow: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that share a minimum in some window."""
        found: set[tuple[int, int]] = set()
        if not len(g):
            return found
        first = np.flatnonzero(np.concatenate([[True], grow[1:] != grow[:-1]]))
        pos = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        sizes = sorted(self.classes)
        levels = []                                  # starts of the blocks of each class, within those of the class before
        at, row, place = None, grow, pos
        for k, u in enumerate(sizes):
            step = u if k == 0 else u // sizes[k - 1]
            at = np.flatnonzero(place % step == 0)
            row = row[at]
            place = place[at] // step
            levels.append((at, row))
        for i, a in enumerate(self.mult):
            low = g * a
            for u, (at, row) in zip(sizes, levels):
                low = np.minimum.reduceat(low, at)
                win = low.copy()
                win[:-1] = np.where(row[1:] == row[:-1], np.minimum(low[1:], low[:-1]), low[:-1])
                values, who, bits = self.classes[u][i]
                for w in np.flatnonzero(bits[(win & np.uint64(0xFFFF)).astype(np.int64)]):
                    lo, hi = np.searchsorted(values, win[w], "left"), np.searchsorted(values, win[w], "right")
                    found.update((int(row[w]), int(k)) for k in who[lo:hi])
        return found

    def search(self, column, n: int, least: float) -> list[list[dict]]:
        """Per row the items whose containment is at least ``least``."""
        out: list[list[dict]] = [[] for _ in range(len(column))]
        lower = pc.utf8_lower(column.cast(pa.large_string()))
        data, offsets = C.utf8(lower)
        for lo, hi in C.row_blocks(offsets):
            d, off = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            h, row = _words(d, off)
            g, grow = _joined(h, row, n, n)
            seen: dict[int, np.ndarray] = {}
            exact: dict[tuple[int, int], set] = {}
            for r, k in sorted(self.candidates(g, grow) | self.short_candidates(h, row)):
                m = self.width[k]
                if m == n:
                    if r not in seen:
                        a, b = np.searchsorted(grow, [r, r + 1])
                        seen[r] = np.unique(g[a:b])
                    if np.isin(self.hashes[k], seen[r], assume_unique=True).sum() < least * len(self.sets[k]):
                        continue                     # equal hashes can only add to the count
                if (r, m) not in exact:
                    exact[r, m] = word_shingles(d[off[r]:off[r + 1]].tobytes().decode(), m)
                shared = len(self.sets[k] & exact[r, m])
                if shared >= least * len(self.sets[k]):
                    out[lo + r].append({"item_id": self.ids[k], "shared": shared, "total": len(self.sets[k])})
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int):
    """(block, whether it is the last): items in blocks of bounded size, read as they are asked for."""
    block, words = [], 0
    for r in items.select(F.col(id_col).cast("long"), text_col).orderBy(id_col, text_col).toLocalIterator():
        size = len((r[1] or "").split())
        if block and words + size > block_words:
            yield block, False
            block, words = [], 0
        block.append((r[0], r[1]))
        words += size
    if block:
        yield block, True


def searching(block: Items, n: int, least: float):
    """The search for one block of items as a function of a text column."""

    @F.arrow_udf(MATCH)
    def search(column: pa.Array) -> pa.Array:
        return pa.array(block.search(column, n, least), pa.list_(pa.struct(
            [("item_id", pa.int64()), ("shared", pa.int32()), ("total", pa.int32())])))

    return search


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", id_col: str = "item_id",
                 text_col: str = "text", n: int = SHINGLE, least: float = LEAST, hashes: int = HASHES,
                 block_words: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """One row per (document, item contained): id, item_id, shared and total shingles, containment.

    Null and empty texts contain nothing; an item without a word (null, empty) is contained in
    nothing, one of fewer than ``n`` words where all of them follow each other; equal items each match;
    repeated documents stay rows of their own; other columns, whatever their names, play no part; no items or no
    documents: no rows.
    """
    x = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text"))
    none = x.select("id", F.from_json(F.lit("[]"), MATCH).alias("m")).where(F.lit(False))
    hits = none
    for block, last in item_blocks(items, id_col, text_col, block_words):
        # called nondeterministic so that a hit is searched once, not for the filter and again for its rows
        found = searching(Items.of(block, n, hashes, seed), n, least).asNondeterministic()
        hit = x.select("id", found("text").alias("m")).where(F.size("m") > 0)
        hit = hit if last else C.written(hit, "item-hits")
        hits = hit if hits is none else hits.unionByName(hit)
    return hits.select("id", F.explode("m").alias("m")).select(
        F.col("id").alias(doc_id), "m.item_id", "m.shared", "m.total", (F.col("m.shared") / F.col("m.total")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, doc_text: str = "text", id_col: str = "item_id", text_col: str = "text",
          n: int = SHINGLE, least: float = LEAST, hashes: int = HASHES, block_words: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """The documents that contain no test item, with all their columns and repeated rows. What is
    contained is as for ``contaminated``; a block of items sees what the blocks before it left."""
    for block, last in item_blocks(items, id_col, text_col, block_words):
        found = searching(Items.of(block, n, hashes, seed), n, least)
        docs = docs.where(F.size(found(F.col(doc_text))) == 0)
        docs = docs if last else C.written(docs, "clean-of-block")
    return docs


#: Exact containment of the same shingles, by brute force; items below five words as one shingle.
ORACLE = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') FROM benchmark),
grams AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
total AS (SELECT id, count(*) AS n FROM grams WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*)::INTEGER AS shared, any_value(t.n)::INTEGER AS total, count(*) / any_value(t.n) AS containment
FROM grams b JOIN grams d ON b.kind = 'b' AND d.kind = 'd' AND b.g = d.g JOIN total t ON t.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(t.n)
UNION ALL
SELECT d.id, s.id, 1::INTEGER, 1::INTEGER, 1.0
FROM (SELECT id, len(w) AS m, array_to_string(w, ' ') AS g FROM words WHERE kind = 'b' AND len(w) BETWEEN 1 AND 4) s
JOIN (SELECT DISTINCT id, m, array_to_string(w[i:i + m - 1], ' ') AS g
      FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i
            FROM (SELECT id, w FROM words WHERE kind = 'd') JOIN (SELECT DISTINCT len(w) AS m FROM words WHERE kind = 'b' AND len(w) BETWEEN 1 AND 4) ON true)) d
ON d.m = s.m AND d.g = s.g
"""
