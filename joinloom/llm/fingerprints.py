"""Order MinHash fingerprints of whole texts.

A text's elements are its k-mers of code points, each numbered by its occurrence. Each of ``m`` hash functions takes the ``l``
elements of least hash; their k-mers are put back into text order and the tuple is hashed to a component.
Equal components at equal places estimate a likeness that falls with edit distance, moved passages included.

A text shorter than k is one k-mer; the empty text (null counts as empty) has a fingerprint of zeros. With fewer than
``l`` elements a tuple holds all there are. Documents follow each other by (doc_id, text), null ids first; repeated rows each have a row of their own;
a single document is followed by itself; an empty table gives an empty one. Other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, mix, width

EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PLACE_BITS = 24


class OrderMinHash:
    def __init__(self, k: int = 6, l: int = 2, m: int = 32):  # noqa: E741
        self.k, self.l, self.m = k, l, m
        self.factors = mix(np.arange(1, m + 1, dtype=np.uint64) * U64(0x2545F4914F6CDD1D)) | U64(1)
        self.salt = mix(np.arange(m, dtype=np.uint64))

    def sketch(self, text: str) -> np.ndarray:
        """m components of 32 bits."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(self.m, np.uint32)
        k = min(self.k, len(points))
        n = len(points) - k + 1
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = h * U64(0x9E3779B97F4A7C15) + points[j : j + n]
        h = mix(h) & ~U64((1 << _PLACE_BITS) - 1)
        # Ordered by k-mer, then place: the occurrence is the rank within the k-mer.
        if n < 1 << _PLACE_BITS:
            key = np.sort(h | np.arange(n, dtype=np.uint64))
            place = (key & U64((1 << _PLACE_BITS) - 1)).astype(np.int64)
            h = key & ~U64((1 << _PLACE_BITS) - 1)
        else:
            place = np.argsort(h, kind="stable")
            h = h[place]
        new = np.ones(n, bool)
        new[1:] = h[1:] != h[:-1]
        at = np.arange(n)
        occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
        e = mix(h + occurrence.astype(np.uint64)) if not new.all() else mix(h)
        taken = np.zeros((self.m, self.l), np.int64)
        block = max(1, min(self.m, (1 << 20) // n))
        for a in range(0, self.m, block):
            x = e[None, :] * self.factors[a : a + block, None]
            rows = np.arange(len(x))
            for t in range(self.l):
                taken[a : a + block, t] = best = x.argmin(axis=1)
                if t + 1 < min(self.l, n):
                    x[rows, best] = U64(0xFFFFFFFFFFFFFFFF)
        taken = np.take_along_axis(taken, np.argsort(place[taken], axis=1, kind="stable"), axis=1)
        out = self.salt.copy()
        for t in range(self.l):
            out = mix(out * U64(0x100000001B3) ^ h[taken[:, t]])
        return (out >> U64(32)).astype(np.uint32)

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        return float((a == b).mean())


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = 6, l: int = 2, m: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: E741
    """``doc_id, fingerprint``"""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = OrderMinHash(k, l, m)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_of(hasher.sketch(t or "")) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(made, "doc_id bigint, fingerprint string")


def against_neighbours(docs: DataFrame, k: int = 6, l: int = 2, m: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: E741
    """Fingerprints of each text and of its edited text, and likenesses to the edited and to the next document's text.

    Rows are dealt by ranges of ids; the first row of each range is also sent to the end of the range before, so
    that no range needs another.
    """
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(least)).alias("key"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    parts = width(docs)
    bounds = sorted({int(b) for b in docs.select(F.col(id_col).cast("bigint").alias("key")).approxQuantile("key", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    key = F.col("key")
    part = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= key)) if bounds else F.lit(0)
    firsts = [tuple(r) for r in rows.select(part.alias("part"), "key").groupBy("part").agg(F.min("key")).orderBy("part").collect()]  # a row for each part
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    own = F.struct(part.cast("int").alias("part"), F.lit(0).alias("tail"))
    if before:
        to = F.create_map(*(x for f, p in before.items() for x in (F.lit(f), F.lit(p))))
        goes = F.when(key.isin(list(before)), F.array(own, F.struct(F.try_element_at(to, key).cast("int").alias("part"), F.lit(1).alias("tail")))).otherwise(F.array(own))
    else:
        goes = F.array(own)
    dealt = rows.select("key", "doc_id", "text", F.inline(goes)).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("tail", "key", "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, last = OrderMinHash(k, l, m), None
        for b in batches:
            out = []
            for doc, text, tail in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("tail").to_pylist(), strict=True):
                if tail and last is None:
                    break
                sketch = hasher.sketch(text)
                if last is not None:
                    d, t, s = last
                    cut = len(t) // 4
                    edited = t[: len(t) - cut] + text[:cut]
                    e = hasher.sketch(edited)
                    out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(s), text_of(e), hasher.likeness(s, e), hasher.likeness(s, sketch)))
                last = None if tail else (doc, text, sketch)
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return dealt.mapInArrow(compared, EDITED)
