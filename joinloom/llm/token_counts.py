"""Token counts with overlap resynchronisation for huge documents.

A document of up to ``huge`` code points is encoded as a whole. A longer one is cut into chunks that
overlap, dealt out over the cluster and encoded with offsets. Two neighbouring chunks are spliced at a
common stable boundary within their overlap: a place between a character that is no white space and one
that is, which no token of either chunk crosses. There both vocabularies begin a new word whatever
stands further left or right, so the tokens on both sides are those of the whole text. Where an overlap
has no such place, the document's chunks and overlaps are widened eightfold, in the end to the whole text.

Null text counts as empty (0 tokens); a null id stays null; repeated rows give repeated results; an empty
table gives an empty one. Other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import stored, width

COUNTED = "doc_id bigint, n_bytes bigint, n_tokens bigint"
_PIECES = "row bigint, chunk bigint, chunks bigint, at bigint, next_at bigint, piece string"
_SPLICED = "row bigint, n_tokens bigint"


def cut(text: str, step: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of each chunk; neighbours share ``overlap`` code points."""
    if len(text) <= step + overlap:
        return [(0, len(text))]
    begins = list(range(0, len(text) - overlap, step))
    return [(a, min(len(text), a + step + overlap)) for a in begins]


def boundaries(piece: str, offsets: list[tuple[int, int]], begin: int, end: int) -> dict[int, int]:
    """Stable places of piece[begin:end] and the number of tokens that end at or before each."""
    ends = np.array([b for _, b in offsets], np.int64)
    begins = np.array([a for a, _ in offsets], np.int64)
    found = {}
    for p in range(max(1, begin), end):
        if piece[p].isspace() and not piece[p - 1].isspace():
            n = int(np.searchsorted(ends, p, "right"))
            if n == len(begins) or begins[n] >= p:
                found[p] = n
    return found


def splice(chunks: list[tuple[int, int, dict[int, int]]]) -> int | None:
    """Tokens of the whole text from (place, number of tokens, stable places) of its chunks in order; None if two don't align."""
    total, done = 0, 0
    for k, (at, n, here) in enumerate(chunks):
        if k + 1 == len(chunks):
            return total + n - done
        to, _, there = chunks[k + 1]
        common = [p for p in sorted(here) if p + at - to in there]
        if not common:
            return None
        total += here[common[0]] - done
        done = there[common[0] + at - to]
    return 0


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", huge: int = 32_768, step: int = 16_384, overlap: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of each row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = [len(e.ids(t)) // 4 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = F.octet_length("text").cast("bigint").alias("n_bytes")
    small = docs.where(F.length("text") <= huge).select("doc_id", "text", sized).mapInArrow(whole, COUNTED)
    long = stored(docs.where(F.length("text") > huge).select("doc_id", "text", sized).withColumn("row", F.monotonically_increasing_id()), "huge")
    if long.isEmpty():
        return small
    counts, left = None, long
    while True:
        spliced = stored(_spliced(left, path, step, overlap), "spliced")
        good = spliced.where("n_tokens is not null")
        counts = good if counts is None else counts.unionByName(good)
        left = left.join(spliced.where("n_tokens is null").select("row"), "row", "left_semi")
        if spliced.where("n_tokens is null").isEmpty():
            return small.unionByName(long.join(counts, "row").select("doc_id", "n_bytes", "n_tokens"))
        step, overlap = 8 * step, 8 * overlap


def _spliced(long: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """row, n_tokens; null where some chunks don't align."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = cut(text, step, overlap)
                for k, (a, z) in enumerate(spans):
                    after = spans[k + 1][0] if k + 1 < len(spans) else None
                    yield pa.RecordBatch.from_pylist([{"row": row, "chunk": k, "chunks": len(spans), "at": a, "next_at": after, "piece": text[a:z]}], schema=schema)

    schema = pa.schema([(n, pa.string() if n == "piece" else pa.int64()) for n in ("row", "chunk", "chunks", "at", "next_at", "piece")])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path).library
        for b in batches:
            for r in b.to_pylist():
                e = library.encode(r["piece"], add_special_tokens=False)
                marks = boundaries(r["piece"], e.offsets, 1, overlap) if r["chunk"] else {}
                if r["next_at"] is not None:
                    marks |= boundaries(r["piece"], e.offsets, r["next_at"] - r["at"], len(r["piece"]))
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "chunk": r["chunk"], "at": r["at"], "n": len(e.ids), "places": list(marks), "tokens": list(marks.values())}], schema=marked)

    marked = pa.schema([*((n, pa.int64()) for n in ("row", "chunk", "at", "n")), *((n, pa.list_(pa.int64())) for n in ("places", "tokens"))])

    def whole(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["chunk"])
        n = splice([(r["at"], r["n"], dict(zip(r["places"], r["tokens"], strict=True))) for r in rows])
        return pa.table({"row": pa.array([rows[0]["row"]], pa.int64()), "n_tokens": pa.array([n], pa.int64())})

    chunks = long.select("row", "text").mapInArrow(pieces, _PIECES).repartition(width(long), "row", "chunk")
    marks = chunks.mapInArrow(encoded, "row bigint, chunk bigint, at bigint, n bigint, places array<bigint>, tokens array<bigint>")
    return marks.groupBy("row").applyInArrow(whole, _SPLICED)
