"""Operator 2: best-fit decreasing packing of tokenised documents into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marigrid.llm.bpe import encoder
from marigrid.llm.common import small_batches

WINDOW = 2048
#: Documents whose pieces are packed together in a task; the last windows of such a run are its only loose ones.
RUN = 65_536
END_ID = 1

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of which capacities occur."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        stack = self.windows[room]
        stack.append(window)
        if len(stack) == 1:
            i = self.leaves + room
            while i and not self.any[i]:
                self.any[i] = 1
                i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The (room, window) with the least room that is at least ``need``."""
        i = self.leaves + need
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.leaves
        window = self.windows[room].pop()
        if not self.windows[room]:
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return room, window


def best_fit(lengths: Iterable[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: each item's window and offset, and each window's fill. Every length is 1 to ``capacity``."""
    lengths = list(lengths)
    window, offset, fill = [0] * len(lengths), [0] * len(lengths), []
    tree = OpenWindows(capacity)
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        found = tree.take(n)
        room, w = found or (capacity, len(fill))
        if found is None:
            fill.append(0)
        window[i], offset[i] = w, fill[w]
        fill[w] += n
        if room > n:
            tree.put(room - n, w)
    return window, offset, fill


def _packed(docs: list[tuple], capacity: int, base: int) -> tuple[pa.RecordBatch, int]:
    """docs: (doc_id, start, length, crc, tokens) of pieces."""
    window, offset, fill = best_fit([d[2] for d in docs], capacity)
    cols = list(zip(*docs, strict=True))
    seq = np.asarray(window, np.int64)
    used = np.asarray(fill, np.int64)
    # a fill that is a power of two stays as it is
    padded = np.where((used & (used - 1)) == 0, used, capacity)[seq]
    arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array(seq + base), pa.array(offset, pa.int64()), pa.array(padded)]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SCHEMA.split(", ")]), len(fill)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, each placed in a sequence of at most ``window`` ids.

    A document is its ids and ``end_id``. It is first cut into full windows; the rest goes by best-fit decreasing
    into the tightest open window. Every task packs what it reads, in runs of ``RUN`` documents, so nothing is
    shuffled; sequence ids are unique over tasks. Null or empty texts are a document of one id. Null ids stay
    null, repeated rows are packed as often as they occur, and no rows give no rows.
    """
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(vocabulary), np.asarray([end_id], "<u4").tobytes()
        base, pieces, seen = TaskContext.get().partitionId() << 36, [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + tail
                n = len(ids) // 4
                for start in range(0, n, window):
                    end = min(n, start + window)
                    pieces.append((doc, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), n))
                seen += 1
                if seen % RUN == 0:
                    out, made = _packed(pieces, window, base)
                    base, pieces = base + made, []
                    yield out
        if pieces:
            yield _packed(pieces, window, base)[0]

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, SCHEMA)
