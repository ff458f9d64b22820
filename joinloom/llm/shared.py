"""Helpers that several operators share: shared storage, Arrow batches, word arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_GOLD, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that belong to no alphanumeric word: ASCII other than digits and letters.
_ASCII_MARK = np.zeros(256, bool)
_ASCII_MARK[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
SEPARATORS = {"space": _ASCII_SPACE, "mark": _ASCII_MARK}
#: Text bytes handled at once; temporary arrays take about 40 times as much.
SLICE_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; set to a new local one only where unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="joinloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut in its lineage that outlives any executor."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/joinloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def forget(df: DataFrame) -> None:
    """Removes the files of a frame that stored() gave and that is needed no more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def width(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}" in taken:
        name = f"_{name}"
    return f"__{name}"


def crc_of_id(doc_id: str | None = "doc_id"):
    """crc32 of the id written as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def offsets_of(texts: pa.Array) -> np.ndarray:
    """Byte offsets of a large_string array's rows, one more than rows."""
    at = texts.buffers()[1]
    if at is None or not len(texts):
        return np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` text bytes; a longer text has a range of its own."""
    ends = offsets_of(texts)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def large_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings with 64-bit offsets and no nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.large_string()).fill_null("")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + _GOLD
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, U64(0xD6E8FEB86659FD93))
    p[:1] = 1
    return np.multiply.accumulate(p)


_POWERS = _powers(256)


class Words:
    """The words of a slice of texts as arrays.

    ``hashes``: 64-bit word hashes in text order; ``doc``: the row of each; ``first``: the number of
    words before each row's (one more entry than rows).
    """

    def __init__(self, texts: pa.Array, separators: str):
        global _POWERS
        offsets = offsets_of(texts)
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n, rows = len(raw), len(offsets) - 1
        inside = ~SEPARATORS[separators][low := _LOWER[raw]]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = offsets[:-1][(offsets[:-1] < n)]
        begins[cut] = inside[cut]
        self.low = low
        self.starts = np.flatnonzero(begins)
        ends = np.zeros(n, bool)
        if n:
            ends[:-1] = inside[:-1] & (~inside[1:] | begins[1:])
            ends[-1] = inside[-1]
        self.ends = np.flatnonzero(ends) + 1
        lengths = self.ends - self.starts
        if len(lengths) and (most := int(lengths.max())) > len(_POWERS):
            _POWERS = _powers(2 * most)
        if len(self.starts):
            body = low[inside]
            at = np.cumsum(lengths) - lengths
            place = np.arange(len(body)) - np.repeat(at, lengths)
            sums = np.add.reduceat((body.astype(np.uint64) + U64(1)) * _POWERS[place], at)
            self.hashes = mix(sums ^ (lengths.astype(np.uint64) << U64(56)))
        else:
            self.hashes = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))

    def word(self, i: int) -> str:
        return self.low[self.starts[i] : self.ends[i]].tobytes().decode()


def words_of(text: str | None, separators: str) -> list[str]:
    """The same words by regular expression, for short lists and tests."""
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+" if separators == "space" else "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def word_hashes(words: Iterable[str]) -> np.ndarray:
    """Hashes of single words, equal to those of Words."""
    words = list(words)
    return Words(pa.array(words, pa.large_string()), "space").hashes if words else np.zeros(0, np.uint64)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1])
