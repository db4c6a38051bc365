"""Whole-text token ids through the ``tokenizers`` library, each distinct chunk once.

A text is cut where no pre-token can cross: before a space or newline that
follows a non-space, behind a lone newline, and between a letter and ASCII
punctuation other than the apostrophe. The ids of a text are then the ids of its chunks in order, so a
worker encodes each distinct chunk once and looks up the rest. A text with a
special token's opening characters, or a tokenizer with another layout, goes
whole to the library.
"""
from __future__ import annotations

import json
import os

import numpy as np
import public_tokenizers
import pyarrow as pa

from stancekit.llm import common as C

LONGEST = 48          # bytes; longer chunks are encoded without being kept
KEPT = 1_000_000      # chunks a worker keeps (about 40 MB); beyond it the table starts anew

_LETTER = C.byte_class(C.ALNUM[10:], high=False)
_SPACE = C.byte_class(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ", high=False)
_PUNCT = C.byte_class(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", high=False)
_OPEN: dict[str, "ChunkEncoder"] = {}


def chunk_starts(d: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which a chunk starts (row starts included)."""
    n = len(d)
    if not n:
        return np.zeros(0, np.int64)
    p = np.zeros((5, n), np.uint8)      # the byte itself and the four before it
    for k in range(5):
        p[k, k:] = d[:max(0, n - k)]
    one, two, three, four = p[1], p[2], p[3], p[4]
    high = one >= 0x80
    solid = ~high & ~_SPACE[one]
    # no white space among two-byte characters from C3 on, three-byte ones from E0 and E4 on, four-byte ones
    solid |= high & ((two >= 0xC3) & (two <= 0xDF))
    solid |= high & (two >= 0x80) & (two < 0xC0) & ((three == 0xE0) | (three >= 0xE4) & (three <= 0xEF))
    solid |= high & (two >= 0x80) & (two < 0xC0) & (three >= 0x80) & (three < 0xC0) & (four >= 0xF0)
    latin = high & (two == 0xC3) & (one != 0x97) & (one != 0xB7)
    cut = ((d == 32) | (d == 10)) & solid
    lone = np.zeros(n, bool)                 # this byte follows a newline that itself follows a non-space
    lone[1:] = ((d == 10) & solid)[:-1]
    cut |= lone & (d < 0x80) & ~_SPACE[d] | lone & (d >= 0xC3) & (d <= 0xDF)
    cut |= _PUNCT[d] & (_LETTER[one] | latin)
    row = offsets[:-1][np.diff(offsets) > 0]
    cut[row] = True
    return np.flatnonzero(cut)


class ChunkEncoder:
    """ids(column) -> (flat uint32 ids, row offsets)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        self.special = {a["content"]: a["id"] for a in layout["added_tokens"]}
        self.mark, self.mark_id = next(iter(self.special.items()), ("", -1))
        # the chunk rule is proved for byte-level pre-tokenizers only
        self.chunked = bool(self.special) and "ByteLevel" in json.dumps(layout["pre_tokenizer"])
        self.mark, self.mark_id = ("\n", 198) if layout["normalizer"] is None and self._newline() else (self.mark, self.mark_id)
        self.reset()

    def _newline(self) -> bool:
        return self.tok.encode("a\n b", add_special_tokens=False).ids[1:2] == [198]

    def reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        nl = np.array([10], np.uint8)
        ids = self.whole("\n")
        self._grow(C.span_hashes(nl, np.array([0]), np.array([1])), np.array([len(ids)]), ids)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids per chunk and all ids, of chunks that hold no mark, through one call for many.

        A chunk that opens with white space of its own (U+00A0 behind a newline is one token)
        may swallow the mark: then a mark is missing, and the part is halved until that chunk stands alone."""
        sizes, pool = [], []
        todo = [texts[lo:lo + 4096] for lo in range(0, len(texts), 4096)][::-1]
        while todo:
            part = todo.pop()
            if len(part) == 1:
                ids, cut = self.whole(part[0]), np.zeros(0, np.int64)
            else:
                ids = np.array(self.tok.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
                cut = np.flatnonzero(ids == self.mark_id)
            if len(cut) != len(part) - 1:
                half = len(part) // 2
                todo += [part[half:], part[:half]]
                continue
            sizes.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
            pool.append(np.delete(ids, cut))
        return np.concatenate(sizes), np.concatenate(pool)

    def ids(self, column) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = C.utf8(column)
        flat, lens = [], []
        for lo, hi in C.row_blocks(offsets):
            f, n = self._block(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            flat.append(f)
            lens.append(n)
        lens = np.concatenate(lens) if lens else np.zeros(0, np.int64)
        return (np.concatenate(flat) if flat else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)

    def _block(self, d: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = d.tobytes()
        if not self.chunked or any(s.encode() in raw for s in self.special):
            got = [self.whole(raw[a:b].decode()) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.concatenate(got) if got else np.zeros(0, np.uint32), np.array([len(x) for x in got], np.int64)
        flat, n, starts = self.chunks(d, offsets)
        per = np.concatenate([[0], np.cumsum(n)])
        return flat, np.diff(per[np.searchsorted(starts, offsets)])

    def chunks(self, d: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, ids per chunk, chunk starts of a block without special tokens."""
        starts = chunk_starts(d, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), starts
        ends = np.append(starts[1:], len(d))
        h = C.span_hashes(d, starts, ends)
        # chunks that are long or hold the mark pass through the library one by one
        alone = ends - starts > LONGEST
        if self.mark == "\n":
            lines = np.concatenate([[0], np.cumsum(d == 10)])
            alone |= (lines[ends] > lines[starts]) & (ends - starts > 1)
        lone = np.flatnonzero(alone)
        known = np.flatnonzero(~alone)
        uniq, first, inverse = np.unique(h[known], return_index=True, return_inverse=True)
        if len(self.keys) > KEPT:
            self.reset()
        slot = np.searchsorted(self.keys, uniq)
        found = slot < len(self.keys)
        found[found] = self.keys[slot[found]] == uniq[found]
        raw = d.tobytes()
        if not found.all():
            new = known[first[~found]]
            got = self._many([raw[a:b].decode() for a, b in zip(starts[new], ends[new])])
            self._grow(uniq[~found], *got)
            slot = np.searchsorted(self.keys, uniq)
        at, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[known], size[known] = self.at[slot][inverse], self.size[slot][inverse]
        pool = self.pool
        if len(lone):
            got = [self.whole(raw[a:b].decode()) for a, b in zip(starts[lone], ends[lone])]
            size[lone] = [len(x) for x in got]
            at[lone] = len(pool) + np.cumsum(size[lone]) - size[lone]
            pool = np.concatenate([pool, *got])
        end = np.cumsum(size)
        take = np.arange(end[-1]) + np.repeat(at - (end - size), size)
        return pool[take], size, starts

    def _grow(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Adds ascending keys that are not there yet."""
        place = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, place, len(self.pool) + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)
        self.keys = np.insert(self.keys, place, keys)
        self.pool = np.concatenate([self.pool, ids])


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and file; a bare name is a public tokenizer."""
    if path not in _OPEN:
        _OPEN[path] = ChunkEncoder(path if os.sep in path else public_tokenizers.path(path))
    return _OPEN[path]


def arrow_text(texts: list[str]) -> pa.Array:
    return pa.array(texts, pa.large_string())
