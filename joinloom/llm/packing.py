"""Packing of token sequences into windows by best-fit decreasing.

A document (its ids and one end id) longer than a window is first cut into full windows and a rest. Rests
and shorter documents are dealt out evenly, at most about ``per_task`` to a task, so that memory is bounded
whatever the corpus; each task places them longest first, each into the open window that leaves the least
room. Open windows are found by a segment tree indexed by remaining capacity.

Null text is a document of the end id alone; null ids stay null; repeated rows are packed each; an empty
table gives no pieces. Other columns of the input are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import stored

_CUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = f"{_CUT}, sequence_id bigint, offset bigint"


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over capacities, each leaf a stack of windows."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, which: int) -> None:
        self.stacks[capacity].append(which)
        i = capacity + self.size
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest window with room for ``least``: (capacity, window), removed from the tree."""
        tree, i = self.tree, least + self.size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            tree[i] -= 1
            i >>= 1
        return capacity, self.stacks[capacity].pop()


class BestFit:
    """Places lengths, given longest first, into windows."""

    def __init__(self, window: int):
        self.window, self.open, self.windows = window, OpenWindows(window), 0

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset)"""
        capacity, which = self.open.take(length) or (self.window, self.windows)
        self.windows += which == self.windows
        if capacity > length:
            self.open.add(capacity - length, which)
        return which, self.window - capacity


def cut_documents(docs: DataFrame, path: str, window: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """A row for each piece: whole windows of overlong documents, and what is left."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows, kept = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = e.ids(text or "") + end
                n = len(ids) // 4
                for a in range(0, n, window):
                    part = ids[4 * a : 4 * min(n, a + window)]
                    rows.append((doc, a, len(part) // 4, zlib.crc32(part), n))
                    if with_ids:
                        kept.append(part)
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if with_ids else [])], names=[*names, *["ids"] * with_ids])

    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(cut, _CUT + ", ids binary" * with_ids)


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", per_task: int = 100_000, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` and their places; ``with_ids`` adds each piece's ids (little-endian unsigned 32-bit)."""
    pieces = stored(cut_documents(docs, path, window, end_id, id_col, text_col, with_ids).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    tasks = -(-pieces.count() // per_task) or 1
    schema = PACKED + ", ids binary" * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(window), TaskContext.get().partitionId() << 40
        for b in batches:
            places = [fit.place(n) for n in b.column("length").to_pylist()]
            columns = [b.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            columns += [pa.array([base + w for w, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + ([b.column("ids")] if with_ids else []), names=[f.split()[0] for f in schema.split(", ")])

    dealt = pieces.repartition(tasks, "piece").sortWithinPartitions(F.desc("length"), "piece").drop("piece")
    return dealt.mapInArrow(place, schema)
