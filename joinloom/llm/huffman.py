"""Token ids stored by canonical, length-limited Huffman coding with block-wise decoding.

Format, a folder of Parquet tables:

- ``codebook``: id, length. Codes are canonical: ordered by (length, id), most significant bit first.
- ``data``: documents in ascending id order through the files in name order: doc_id, part (the file's number), start (ids
  before the document in its part), n_tokens, checkpoints (little-endian uint32: bit offset of every block of ``BLOCK``
  ids; blocks decode independently), payload (the bits, padded to whole bytes).
- ``parts``: part, base (ids of all parts before).

Code lengths come from counts over the whole corpus by the package-merge algorithm; a code has at most
``LONGEST`` bits, so decoding is one look-up in a table of 2**LONGEST entries for each id, done for many blocks in step.

Null text is an empty document (the end id alone). Null doc ids come first; rows of one id keep the order in which
they were read. An empty table gives an empty data table. Other columns of the input are left out.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import forget, shared_dir, stored, width

LONGEST, BLOCK = 20, 256
#: Ids coded or decoded at once.
SLICE = 1 << 19


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids don't fit codes of {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    is_leaf: list[np.ndarray] = []
    items = leaves
    for level in range(longest):
        if level:
            pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
            items = np.concatenate([leaves, pairs])
            order = np.argsort(items, kind="stable")
            items = items[order]
            is_leaf.append(order < len(leaves))
        else:
            is_leaf.append(np.ones(len(leaves), bool))
    take, each = 2 * (len(used) - 1), np.zeros(len(used), np.uint8)
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())
        each[:n] += 1
        take = 2 * (take - n)
    lengths[used] = each
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, in its lowest ``length`` bits."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        space = np.uint64(1) << (np.uint64(LONGEST) - lengths[order].astype(np.uint64))
        first = np.cumsum(space) - space
        codes[order] = first >> (np.uint64(LONGEST) - lengths[order].astype(np.uint64))
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each LONGEST bits the id whose code begins them, and the code's length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    space = 1 << (LONGEST - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << LONGEST, np.uint32), np.zeros(1 << LONGEST, np.uint8)
    n = int(space.sum())
    ids[:n], bits[:n] = np.repeat(order, space), np.repeat(lengths[order], space)
    return ids, bits


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, canonical_codes(lengths)

    def encode(self, documents: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        """(checkpoints, payload) of each document's ids."""
        sizes = np.array([len(d) for d in documents], np.int64)
        ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
        if not len(ids):
            return [(b"", b"")] * len(documents)
        bits = self.lengths[ids].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(bits)])
        first = np.concatenate([[0], np.cumsum(sizes)])
        whole = -(-(upto[first[1:]] - upto[first[:-1]]) // 32) * 4  # bytes of each, in words of 32 bits
        begin = np.concatenate([[0], np.cumsum(whole)])
        inside = upto[:-1] - np.repeat(upto[first[:-1]], sizes)
        at = inside + np.repeat(8 * begin[:-1], sizes)
        word, shift = at >> 5, (64 - (at & 31) - bits).astype(np.uint64)
        value = self.codes[ids] << shift
        heads = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        out = np.zeros(int(begin[-1]) // 4 + 1, np.uint64)
        out[word[heads]] += np.add.reduceat(value >> np.uint64(32), heads)
        out[word[heads] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), heads)
        raw = out.astype(">u4").tobytes()
        ends = -(-(upto[first[1:]] - upto[first[:-1]]) // 8)
        return [
            (inside[a:z:BLOCK].astype("<u4").tobytes(), raw[b : b + e])
            for a, z, b, e in zip(first[:-1].tolist(), first[1:].tolist(), begin[:-1].tolist(), ends.tolist(), strict=True)
        ]


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.ids, self.bits = decode_table(lengths)

    def decode(self, documents: list[tuple[int, bytes, bytes]]) -> list[np.ndarray]:
        """The ids of documents given as (number of ids, checkpoints, payload): their blocks are read in step."""
        sizes = np.array([n for n, _, _ in documents], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(b"".join(p for _, _, p in documents) + bytes(8), np.uint8).astype(np.uint32)
        four = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        begin = np.cumsum([0, *(len(p) for _, _, p in documents)])
        blocks = -(-sizes // BLOCK)
        at = np.concatenate([np.frombuffer(c, "<u4") for _, c, _ in documents]).astype(np.int64) + np.repeat(8 * begin[:-1], blocks)
        number = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        to = np.repeat(first[:-1], blocks) + number * BLOCK
        left = np.minimum(BLOCK, np.repeat(sizes, blocks) - number * BLOCK)
        order = np.argsort(-left, kind="stable")
        at, to, left = at[order], to[order], left[order]
        out = np.zeros(int(first[-1]), np.uint32)
        active = np.searchsorted(-left, -np.arange(BLOCK), "left")  # blocks with more than so many ids
        for step in range(BLOCK):
            n = active[step]
            if not n:
                break
            here = at[:n]
            ahead = (four[here >> 3] >> (32 - LONGEST - (here & 7)).astype(np.uint32)) & np.uint32((1 << LONGEST) - 1)
            out[to[:n] + step] = self.ids[ahead]
            at[:n] += self.bits[ahead]
        return [out[a:z] for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > SLICE:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


@functools.lru_cache(1)
def _decoder(lengths: bytes) -> Decoder:
    return Decoder(np.frombuffer(lengths, np.uint8))


@functools.lru_cache(1)
def _coder(lengths: bytes) -> Coder:
    return Coder(np.frombuffer(lengths, np.uint8))


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes and writes the ids of every text and the end id; gives the folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/joinloom-ids-{uuid.uuid4().hex}"
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, end = encoder(path), np.array([end_id], "<u4").tobytes()
        # Two bytes an id where the vocabulary allows.
        small = max(e.library.get_vocab_size(), end_id + 1) <= 1 << 16
        for b in batches:
            ids = [e.ids(t or "") + end for t in b.column(1).to_pylist()]
            n = pa.array([len(i) // 4 for i in ids], pa.int64())
            if small:
                ids = [np.frombuffer(i, "<u4").astype("<u2").tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    def arrays(b: pa.RecordBatch) -> list[np.ndarray]:
        sizes = b.column("n_tokens").to_pylist()
        return [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4") for n, x in zip(sizes, b.column("ids").to_pylist(), strict=True)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for a, z in _slices(b.column("n_tokens").to_pylist()):
                n = np.bincount(np.concatenate(arrays(b.slice(a, z - a))))
                total = np.pad(total, (0, max(0, len(n) - len(total))))
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    ids = stored(docs.mapInArrow(tokens, "doc_id bigint, n_tokens bigint, ids binary"), "tokens")
    # One row for each id of the vocabulary at most.
    found = ids.mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    book = lengths.tobytes()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(book)
        for b in batches:
            for a, z in _slices(b.column("n_tokens").to_pylist()):
                part = b.slice(a, z - a)
                pairs = coder.encode(arrays(part))
                columns = [part.column("doc_id"), part.column("n_tokens"), pa.array([c for c, _ in pairs], pa.binary()), pa.array([p for _, p in pairs], pa.binary()), part.column("row")]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "checkpoints", "payload", "row"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            start = before + np.cumsum(n) - n
            before += int(n.sum())
            columns = [b.column("doc_id"), pa.array(np.full(len(n), part), pa.int64()), pa.array(start, pa.int64()), *(b.column(c) for c in ("n_tokens", "checkpoints", "payload"))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start", "n_tokens", "checkpoints", "payload"])

    parts = width(docs)
    bounds = sorted(set(ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    # The number of bounds at or below the id: documents of one id meet in one part, ids ascend from part to part.
    below = F.size(F.filter(F.array(*(F.lit(int(b)) for b in bounds)), lambda b: b <= F.coalesce("doc_id", F.lit(-(1 << 63))))) if bounds else F.lit(0)
    rows = ids.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "n_tokens", "ids", "row")
    out = rows.mapInArrow(coded, "doc_id bigint, n_tokens bigint, checkpoints binary, payload binary, row bigint")
    out = out.repartitionById(len(bounds) + 1, below.cast("int")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "row").drop("row")
    out.mapInArrow(placed, "doc_id bigint, part bigint, start bigint, n_tokens bigint, checkpoints binary, payload binary").write.parquet(f"{folder}/data")
    forget(ids)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(used, pa.int64()), "length": pa.array(lengths[used], pa.int32())})).coalesce(1).write.parquet(f"{folder}/codebook")
    totals = spark.read.parquet(f"{folder}/data").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each part
    base = np.cumsum([0, *(r["n"] for r in totals)])[:-1]
    table = pa.table({"part": pa.array([r["part"] for r in totals], pa.int64()), "base": pa.array(base, pa.int64())})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{folder}/parts")
    return folder


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` as decoded; ``with_ids`` adds the ids (little-endian uint32)."""
    book = spark.read.parquet(f"{folder}/codebook").toPandas()  # a row for each id of the vocabulary at most
    lengths = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, np.uint8)
    lengths[book["id"].to_numpy()] = book["length"].to_numpy()
    lengths = lengths.tobytes()
    names = ["doc_id", "part", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(lengths)
        for b in batches:
            for a, z in _slices(b.column("n_tokens").to_pylist()):
                part = b.slice(a, z - a)
                given = zip(*(part.column(c).to_pylist() for c in ("n_tokens", "checkpoints", "payload")), strict=True)
                ids = [i.astype("<u4").tobytes() for i in decoder.decode(list(given))]
                columns = [*(part.column(c) for c in ("doc_id", "part", "start", "n_tokens")), pa.array(map(zlib.crc32, ids), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), names=names)

    rows = spark.read.parquet(f"{folder}/data").mapInArrow(decoded, "doc_id bigint, part bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
    # A row for each file of the format.
    rows = rows.join(F.broadcast(spark.read.parquet(f"{folder}/parts")), "part")
    return rows.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
