"""Vector bin packing of token sequences under three limits at once.

A sequence may hold at most ``max_tokens`` ids, ``max_segments`` pieces and
``max_loss`` loss-bearing ids. Each example is cut into full sequences and a
rest; rests are placed by the dot-product heuristic: the open sequence takes
the fitting rest whose demand vector has the largest dot product with the
capacity left, both as shares of the limits. When nothing fits, a rest is cut
to fill the gap (``cut=True``), so only limits other than tokens, and the last
sequence of a task, leave padding.

Map-only: each task packs its own rows in windows of ``window`` rests, so memory
does not grow with the input, no key can be hot, and a lost task repeats its
own rows only (it needs the same rows in the same order, as a file scan gives).
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancekit.llm.encoder import encoder

END_ID = 0
LIMITS = {"max_tokens": 1024, "max_segments": 512, "max_loss": 1024}


def fill(length: np.ndarray, prompt: np.ndarray, limits: tuple[int, int, int], cut: bool = True, keep: int = 0):
    """Place rests into sequences; yields lists of (item, start, end).

    ``length`` ids per rest, of which the first ``prompt`` bear no loss. Stops
    when at most ``keep`` rests are left and says what is left by a final
    (None, starts) pair: starts[i] is where rest i goes on (its length if used up).
    """
    cap = np.array(limits, float)
    at = np.zeros(len(length), np.int64)
    demand = np.stack([length, np.ones_like(length), np.maximum(0, length - prompt)], 1).astype(float)
    share = demand / cap
    live = length > 0
    left = int(live.sum())
    while left > keep:
        room, seq = cap.copy(), []
        while True:
            fits = live & (demand <= room).all(1)
            k = int(np.argmax(np.where(fits, share @ (room / cap), -1.0)))
            if fits[k]:
                seq.append((k, int(at[k]), int(length[k])))
                room -= demand[k]
                at[k], live[k] = length[k], False
                left -= 1
                continue
            if cut and left and room[0] >= 1 and room[1] >= 1 and (room[2] >= 1 or not seq):
                k = int(np.argmax(np.where(live, demand[:, 0], -1.0)))
                free = max(0, int(prompt[k] - at[k]))           # ids that bear no loss come first
                take = int(min(room[0], free + room[2], length[k] - at[k]))
                if take > 0:
                    seq.append((k, int(at[k]), int(at[k] + take)))
                    at[k] += take
                    if at[k] == length[k]:
                        live[k] = False
                        left -= 1
                    demand[k, 0] = length[k] - at[k]
                    demand[k, 2] = max(0, length[k] - max(at[k], prompt[k]))
                    share[k] = demand[k] / cap
            break
        if not seq:
            raise ValueError("an example does not fit the limits and may not be cut")
        yield seq
    yield None, at


class Packer:
    """Keeps rests between batches and lays out sequences."""

    def __init__(self, limits: tuple[int, int, int], cut: bool, window: int, base: int):
        self.limits, self.cut, self.window, self.next = limits, cut, window, base
        self.rest: list[tuple[tuple, int, int, int]] = []   # (row, start, ids, prompt)
        self.out: list[tuple] = []                          # (row, start, length, sequence, offset)

    def add(self, row: tuple, n: int, prompt: int) -> None:
        """A row of n ids; the first ``prompt`` bear no loss."""
        most, _, loss = self.limits
        start = 0
        while self.cut and n - start >= most:
            free = max(0, prompt - start)
            take = min(most, free + loss)
            self.out.append((row, start, take, self.next, 0))
            self.next += 1
            start += take
        if n > start:
            self.rest.append((row, start, n - start, max(0, prompt - start)))
        if len(self.rest) >= 2 * self.window:
            self.settle(self.window)

    def settle(self, keep: int = 0) -> None:
        rest = self.rest
        n = np.array([r[2] for r in rest], np.int64)
        p = np.array([min(r[3], r[2]) for r in rest], np.int64)
        for seq in fill(n, p, self.limits, self.cut, keep):
            if seq[0] is None:
                at = seq[1]
                self.rest = [(r[0], r[1] + int(a), r[2] - int(a), max(0, r[3] - int(a))) for r, a in zip(rest, at) if a < r[2]]
                return
            offset = 0
            for k, a, b in seq:
                self.out.append((rest[k][0], rest[k][1] + a, b - a, self.next, offset))
                offset += b - a
            self.next += 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None,
         tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, max_tokens: int = LIMITS["max_tokens"],
         max_segments: int = LIMITS["max_segments"], max_loss: int = LIMITS["max_loss"], cut: bool = True,
         window: int = 512, payload: str = "ids") -> DataFrame:
    """Encode texts, append ``end_id`` and pack: one row per piece.

    ``prompt_col`` holds texts that precede the text and bear no loss (instruction
    data); without it only the first id of a document, which nothing precedes,
    bears none. Returns id, start, length, doc_tokens, sequence_id, offset,
    loss_tokens and the piece's ``ids`` (or ``ids_crc32`` with payload="crc32").
    Null texts and prompts are empty (the row is its end id alone); a null id, equal ids
    and repeated rows stay rows of their own; other columns are ignored; an empty table
    gives an empty result.
    """
    limits = (max_tokens, max_segments, max_loss)
    if min(limits) < 1:
        raise ValueError("limits must be positive")
    x = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                    *([F.col(prompt_col).alias("prompt")] if prompt_col else []))
    kind = docs.schema[id_col].dataType.simpleString()
    body = "ids array<int>" if payload == "ids" else "ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = Packer(limits, cut, window, TaskContext.get().partitionId() << 32)
        held: dict[int, np.ndarray] = {}       # ids of rows that still have a rest
        serial = 0

        def emit():
            out, packer.out = packer.out, []
            if not out:
                return None
            parts = [held[r[0]][s:s + n] for r, s, n, _, _ in out]
            cols = {
                id_col: pa.array([r[1] for r, *_ in out], batch_type),
                "start": pa.array([o[1] for o in out], pa.int64()),
                "length": pa.array([o[2] for o in out], pa.int64()),
                "doc_tokens": pa.array([r[2] for r, *_ in out], pa.int64()),
                "sequence_id": pa.array([o[3] for o in out], pa.int64()),
                "offset": pa.array([o[4] for o in out], pa.int64()),
                "loss_tokens": pa.array([max(0, s + n - max(s, r[3])) for r, s, n, _, _ in out], pa.int64()),
            }
            if payload == "ids":
                offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                cols["ids"] = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(parts).astype(np.int32)))
            else:
                cols["ids_crc32"] = pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())
            live = {r[0][0] for r in packer.rest}
            for k in [k for k in held if k not in live]:
                del held[k]
            return pa.RecordBatch.from_pydict(cols)

        batch_type = None
        for batch in batches:
            batch_type = batch.schema.field("id").type
            keys = batch.column("id").to_pylist()
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                flat, offs = enc.ids(part.column("text"))
                if prompt_col:
                    pre, po = enc.ids(part.column("prompt"))
                for i in range(part.num_rows):
                    ids = np.append(flat[offs[i]:offs[i + 1]], np.uint32(end_id))
                    free = 1
                    if prompt_col:
                        ids = np.concatenate([pre[po[i]:po[i + 1]], ids])
                        free = int(po[i + 1] - po[i])
                    held[serial] = ids
                    packer.add((serial, keys[lo + i], len(ids), free), len(ids), free)
                    serial += 1
                done = emit()
                if done is not None:
                    yield done
        packer.settle()
        done = emit() if batch_type is not None else None
        if done is not None:
            yield done

    schema = f"`{id_col}` {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint, {body}"
    return x.mapInArrow(run, schema)
