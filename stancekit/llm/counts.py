"""Edit-aware token counts: a segment tree per document.

A text is cut into segments of about ``CHUNKS`` chunks; a chunk border is a place no
pre-token can cross (see encoder.py), so the ids of a text are those of its segments. The
tree holds character and token sums in heap order (node 1 is the root, the segments are
the last ``width`` nodes). An edit re-encodes the segments from the one that holds the character before
it to the one that holds the character after it (and the next, if that character is a newline
at the segment's end), puts the result into the first of them, empties the others and updates the sums above.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.llm import common as C
from stancekit.llm.encoder import ChunkEncoder, arrow_text, chunk_starts, encoder

CHUNKS = 16
TREE = "width int, tree_chars array<int>, tree_tokens array<int>"
EDITS = "array<struct<start:bigint,removed:bigint,inserted:string>>"


def heap(leaves: np.ndarray) -> np.ndarray:
    """Sums in heap order over a power of two of leaves; node 0 is unused."""
    width = 1 << max(0, int(len(leaves) - 1).bit_length()) if len(leaves) else 1
    tree = np.zeros(2 * width, np.int64)
    tree[width:width + len(leaves)] = leaves
    k = width
    while k > 1:
        tree[k // 2:k] = tree[k:2 * k:2] + tree[k + 1:2 * k:2]
        k //= 2
    return tree


def update(tree: np.ndarray, leaf: int, value: int) -> None:
    node = len(tree) // 2 + leaf
    delta = value - tree[node]
    while node and delta:
        tree[node] += delta
        node //= 2


def locate(tree: np.ndarray, position: int) -> tuple[int, int]:
    """The leaf that holds a character position, and the characters before that leaf."""
    node, before, width = 1, 0, len(tree) // 2
    while node < width:
        node *= 2
        if position - before >= tree[node]:
            before += int(tree[node])
            node += 1
    return node - width, before


def segments(text: str, chunks: int = CHUNKS) -> list[str]:
    """The text cut at every ``chunks``-th chunk border."""
    raw = text.encode()
    starts = chunk_starts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[::chunks]
    return [raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw)])]


def count_tokens(enc: ChunkEncoder, texts: list[str]) -> np.ndarray:
    return np.diff(enc.ids(arrow_text(texts))[1])


class Document:
    """A text with its tree; ``encoded`` counts the characters encoded by edits."""

    def __init__(self, enc: ChunkEncoder, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.text, self.chars, self.tokens, self.encoded, self.span = text, chars, tokens, 0, None
        # special tokens may span chunk borders: such texts are counted whole
        self.special = [s for s in enc.special if s]

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def layout(self) -> list[str]:
        """The segments of a new tree."""
        return [self.text] if any(s in self.text for s in self.special) else segments(self.text) or [""]

    def open(self, start: int, removed: int, inserted: str) -> list[str]:
        """Replace ``removed`` characters from ``start`` (both clamped to the text); returns what
        has to be encoded: the region, or all segments if the tree is to be built anew."""
        n = len(self.text)
        start = min(max(0, start), n)
        end = min(n, start + max(0, removed))
        self.span = None
        if start == end and not inserted:
            return []
        width = len(self.chars) // 2
        first, a = locate(self.chars, max(0, start - 1))
        last, b = locate(self.chars, end) if end < n else (width - 1, n - int(self.chars[-1]))
        if first > last:
            first, a = last, b
        stop = b + int(self.chars[width + last])
        if stop == end + 1 and stop < n and self.text[end] == "\n":
            # a border behind a lone newline also depends on the character before that newline
            last, b = locate(self.chars, stop)
            stop = b + int(self.chars[width + last])
        region = self.text[a:start] + inserted + self.text[end:stop]
        self.text = self.text[:a] + region + self.text[stop:]
        near = self.text[max(0, a - 64):a + len(region) + 64]
        # a segment that outgrows the others would make later edits in it dear
        if any(s in near for s in self.special) or len(region) > 64 * max(64, n // width):
            self.encoded += len(self.text)
            self.span = (0, -1, 0)
            return self.layout()
        self.encoded += len(region)
        self.span = (first, last, len(region))
        return [region]

    def close(self, parts: list[str], counted: np.ndarray) -> None:
        """Puts the counts of what ``open`` returned into the tree."""
        if self.span is None:
            return
        first, last, size = self.span
        if last < first:
            self.chars, self.tokens = heap(np.array([len(p) for p in parts])), heap(counted)
            return
        for leaf in range(first + 1, last + 1):
            update(self.chars, leaf, 0)
            update(self.tokens, leaf, 0)
        update(self.chars, first, size)
        update(self.tokens, first, int(counted[0]))


def edit_all(enc: ChunkEncoder, docs: list[Document], edits: list[list[dict]]) -> None:
    """The k-th edits of all documents are encoded together, then the next."""
    for k in range(max(map(len, edits), default=0)):
        work = []
        for doc, todo in zip(docs, edits):
            e = todo[k] if k < len(todo) else None
            if e is not None:
                work.append((doc, doc.open(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")))
        n = count_tokens(enc, [p for _, parts in work for p in parts])
        at = 0
        for doc, parts in work:
            doc.close(parts, n[at:at + len(parts)])
            at += len(parts)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """id, text, n_tokens and the tree of every row (null text: empty). Map-only."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column("text").to_pylist()]
                cut = [[t] if any(s in t for s in enc.special) else segments(t) or [""] for t in texts]
                n = count_tokens(enc, [s for c in cut for s in c])
                at = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
                chars = [heap(np.array([len(s) for s in c])) for c in cut]
                tokens = [heap(n[a:b]) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), arrow_text(texts).cast(pa.string()), pa.array([int(t[1]) for t in tokens], pa.int64()),
                     pa.array([len(t) // 2 for t in chars], pa.int32()), _lists(chars), _lists(tokens)],
                    ["id", "text", "n_tokens", "width", "tree_chars", "tree_tokens"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, text string, n_tokens bigint, {TREE}")
    return out.withColumnRenamed("id", id_col)


def slices(column: pa.Array, most: int = 64) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch of at most ``most`` rows and about 1 MB of text: what is worked on at once.
    Freed buffers go back to the system behind each batch, so a worker stays as small as a range."""
    offsets = C.utf8(column)[1]
    for lo, hi in C.row_blocks(offsets):
        yield from ((at, min(at + most, hi)) for at in range(lo, hi, most))
    pa.default_memory_pool().release_unused()


def _views(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as arrays of longs of their own."""
    offs, flat = np.asarray(column.offsets), np.asarray(column.values)
    return [flat[a:b].astype(np.int64) for a, b in zip(offs[:-1], offs[1:])]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(rows).astype(np.int32)))


def apply_edits(trees: DataFrame, edits: str = "edits", id_col: str = "doc_id", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Apply each row's ``edits`` (array of start, removed, inserted, in order, in code points of
    the text as the edits before left it) and return the new text, tree and counts:
    id, text, n_before, n_tokens, n_edits, chars_encoded and the tree.

    Null edits: none; null members of an edit: zero or empty. Map-only; a document's edits are
    part of its row.
    """
    kind = trees.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                docs = [Document(enc, t or "", c, k) for t, c, k in zip(
                    part.column("text").to_pylist(), _views(part.column("tree_chars")), _views(part.column("tree_tokens")))]
                todo = [e or [] for e in part.column("edits").to_pylist()]
                edit_all(enc, docs, todo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([d.text for d in docs], pa.string()), part.column("n_tokens"), pa.array([d.total for d in docs], pa.int64()),
                     pa.array([len(e) for e in todo], pa.int32()), pa.array([d.encoded for d in docs], pa.int64()),
                     pa.array([len(d.chars) // 2 for d in docs], pa.int32()), _lists([d.chars for d in docs]), _lists([d.tokens for d in docs])],
                    ["id", "text", "n_before", "n_tokens", "n_edits", "chars_encoded", "width", "tree_chars", "tree_tokens"])

    x = trees.select(F.col(id_col).alias("id"), "text", "n_tokens", "tree_chars", "tree_tokens", F.col(edits).cast(EDITS).alias("edits"))
    out = x.mapInArrow(run, f"id {kind}, text string, n_before bigint, n_tokens bigint, n_edits int, chars_encoded bigint, {TREE}")
    return out.withColumnRenamed("id", id_col)


def derived_edits(id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> Column:
    """An edit list for every document from its own text: at ``n`` hashed places up to 40 characters go
    and up to 60 from another place of the text come in."""
    size = F.length(text_col)
    def place(k):  # noqa: E306
        return F.pmod(F.xxhash64(F.lit(k), id_col, size), size + 1)
    return F.array(*[F.struct(
        place(3 * k).alias("start"), F.pmod(F.xxhash64(F.lit(3 * k + 1), id_col), F.lit(41)).alias("removed"),
        F.substring(F.col(text_col), place(3 * k + 2).cast("int") + 1, 60).alias("inserted")) for k in range(n)])


def brute_count(text: str, tokenizer: str = "byte_bpe_50k.json") -> int:
    """The whole text through the library; the tests hold the trees against it."""
    return len(encoder(tokenizer).whole(text))

