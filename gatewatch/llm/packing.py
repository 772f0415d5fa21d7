"""Packing of token sequences by minimum bin slack.

A task keeps what remains of its documents in a pool. For each window the longest piece goes in first; then a
subset-sum pass over the multiset of remaining lengths, as bits of an integer, finds the fullest sum that
fits, and walking back through its steps gives how many pieces of each length make it. If even the fullest
sum leaves slack, one more piece is cut to fill it. So windows are full, and most documents stay whole.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents
from .pieces import sliced
from .token_pool import SLICE_BYTES, token_pool

#: Windows whose tokens a task keeps to choose from.
POOL_WINDOWS = 64
#: Bits of a sequence's number within its task; the task's number stands above them.
_TASK_SHIFT = 40
#: Rows of result in one Arrow batch.
_OUT_ROWS = 5_000


def fullest(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """How many pieces of each length together come closest to ``room`` without passing it.

    Bit s of ``reach`` says that some choice sums to s. Counts are split into 1, 2, 4, ... and a rest, so that
    each step either takes its lot or not; the last sum is walked back through the steps.
    """
    mask = (1 << room + 1) - 1
    reach, steps = 1, []
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        left, lot = min(count, room // length), 1
        while left > 0 and not reach >> room:
            lot = min(lot, left)
            steps.append((k, lot, reach))
            reach |= reach << length * lot & mask
            left, lot = left - lot, lot * 2
        if reach >> room:
            break
    used, at = [0] * len(lengths), reach.bit_length() - 1
    for k, lot, before in reversed(steps):
        if not before >> at & 1:
            used[k] += lot
            at -= lot * lengths[k]
    return used


class Packer:
    """Packs pieces ``(document, start, ids)`` into windows: lists of pieces, in their order."""

    def __init__(self, capacity: int, pool_windows: int = POOL_WINDOWS):
        self.capacity, self.enough = capacity, capacity * pool_windows
        self.pool: list[deque] = [deque() for _ in range(capacity + 1)]
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.tokens = 0

    def _put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.pool[n].append(piece)
        self.count[n] += 1
        self.tokens += n

    def _take(self, n: int) -> tuple:
        self.count[n] -= 1
        self.tokens -= n
        return self.pool[n].popleft()

    def add(self, document, ids: np.ndarray) -> Iterator[list[tuple]]:
        """Windows that are complete now. Documents beyond a window fill whole ones first."""
        whole = len(ids) // self.capacity * self.capacity
        for a in range(0, whole, self.capacity):
            yield [(document, a, ids[a : a + self.capacity])]
        if whole < len(ids):
            self._put((document, whole, ids[whole:].copy()))
        while self.tokens >= self.enough:
            yield self._window()

    def _window(self) -> list[tuple]:
        out = [self._take(int(np.flatnonzero(self.count)[-1]))]
        room = self.capacity - len(out[0][2])
        lengths = np.flatnonzero(self.count[: room + 1])[::-1]
        for n, used in zip(lengths.tolist(), fullest(lengths.tolist(), self.count[lengths].tolist(), room), strict=True):
            out += [self._take(n) for _ in range(used)]
            room -= n * used
        if room and self.tokens:
            document, start, ids = self._take(int(np.flatnonzero(self.count)[-1]))
            out.append((document, start, ids[:room]))
            self._put((document, start + room, ids[room:]))
        return out

    def finish(self) -> Iterator[list[tuple]]:
        """The rest. What does not fill a window is cut at powers of two, which need no padding."""
        while self.tokens >= self.capacity:
            yield self._window()
        rest = deque(self._take(n) for n in np.flatnonzero(self.count)[::-1].tolist() for _ in range(self.count[n]))
        total = sum(len(ids) for _, _, ids in rest)
        for bit in range(total.bit_length() - 1, -1, -1):
            if not total >> bit & 1:
                continue
            out, room = [], 1 << bit
            while room:
                document, start, ids = rest.popleft()
                out.append((document, start, ids[:room]))
                if len(ids) > room:
                    rest.appendleft((document, start + room, ids[room:]))
                room -= len(out[-1][2])
            yield out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of the tokenized documents, packed into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; each id lies in exactly one piece. Returns one row per piece: the
    document's id, ``start`` (ids of the document before it), ``length``, ``ids_crc32`` (of the ids as
    little-endian 32-bit numbers), ``doc_tokens``, ``sequence_id``, ``offset`` (its place in the sequence) and,
    ``with_ids``, ``ids``. Other columns of ``docs`` do not pass.

    All sequences are full but the last few of each task, whose lengths are powers of two. No row leaves its
    task, so a rerun over the same input partitions gives the same sequences; other partitions give others.
    A null or empty text is ``end_id`` alone, null and repeated ids are documents like all others, repeated
    rows are packed once each, an empty table has no pieces, and texts of any length are packed whole.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    shape = rows.select(id_col, *[F.lit(0).cast("long").alias(c) for c in longs], *([F.array(F.lit(0)).alias("ids")] if with_ids else []))
    schema = shape.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, packer = token_pool(tokenizer_path, "lower", False), Packer(capacity)
        first, made, kind = TaskContext.get().partitionId() << _TASK_SHIFT, 0, None
        held: list[tuple] = []

        def keep(window: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for (document, total), start, ids in window:
                held.append((document, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, first + made, offset, *([ids] if with_ids else [])))
                offset += len(ids)
            made += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if with_ids:
                ends = np.cumsum([0, *map(len, columns[7])])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(columns[7]), pa.int32())))
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for part in batches:
            kind = part.schema.field(0).type
            for a, b in sliced(part.column(1), SLICE_BYTES):
                flat, counts = pool.encode(part.column(1).slice(a, b - a))
                ends = np.cumsum(counts)
                for document, n, end in zip(part.column(0).slice(a, b - a).to_pylist(), counts.tolist(), ends.tolist(), strict=True):
                    for window in packer.add((document, n + 1), np.append(flat[end - n : end], np.int32(end_id))):
                        keep(window)
                    if len(held) >= _OUT_ROWS:
                        yield batch()
        for window in packer.finish():
            keep(window)
        if held:
            yield batch()

    return rows.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of whole sequences, from pieces with their ids. A group has at most a window's tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_packing(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path or default_tokenizer(), end_id=2, with_ids=False)
