"""Fold pipelines, such as softmax attention and kernel smoothers, tile by tile.

The plain plan makes a row for each pair of keys and feature, then one for each pair. Here queries, and keys with values, are packed into
tiles. Queries are dealt into strips, a few for each core; a task holds one strip of queries with its running results (for shifted weights
maximum, sum and weighted sum, as in an online softmax), and the tiles of keys and values pass by it in order, a chunk at a time. So tiles are
copied once for each strip, not for each pair, no partial result is ever sent, and what is sent grows with the input as long as strips fit
``STRIP_BYTES``. Strips that a condition leaves nothing get no copy. A relation that is queries, keys or values at once is packed once, and
keys that are their own values travel once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import Expression, lit
from ..ir import Condition, Fold, Pipeline, Weight
from .dense import _kept

#: Rows of a tile, and tiles that make a chunk at most (fewer where they hold BLOCK rows).
BLOCK, FAN_IN = 512, 32
#: Strips for each core, rows of a tile of queries at least, and bytes of a strip's queries and results at most.
PER_CORE, LEAST, STRIP_BYTES = 3, 64, 64 << 20
#: Largest absolute value of inputs for which scores and weighted sums stay finite in any order.
LARGEST = 1e120
#: Sum of squares up to which squared distances of exponential weights are expanded.
EXPANDED = 500.0
#: Largest absolute score up to which exponentials are summed without a shift: no sum overflows, and none of them underflows.
UNSHIFTED = 300.0
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


class Shape:
    """Dimensions of a pipeline by part: batch, kept, summed, feature (None: pairs have one row), and the values' own."""

    def __init__(self, batch: list[str], kept: str, summed: str, feature: str | None, own: str):
        self.batch, self.kept, self.summed, self.feature, self.own = batch, kept, summed, feature, own


def shape_of(p: Pipeline) -> Shape | None:
    f: Fold = p.producer
    if len(f.operands) != 2 or len(p.summed) != 1 or any(d.null_safe for d in f.dimensions):
        return None
    a, b, out, v = f.dims_of(0), f.dims_of(1), set(f.outputs), set(p.values.keys)
    batch = sorted(a & b & out)
    kept, summed, feature, own = (a - b) & out, (b - a) & out, (a & b) - out, v - out
    if len(kept) != 1 or summed != set(p.summed) or len(feature) > 1 or len(own) != 1 or v != {*batch, *summed, *own} or (a | b) - out - feature:
        return None
    if f.value is None and (not feature or not all(o.factor for o in f.operands)):
        return None
    if any({c.left, c.right} != kept | summed for c in f.conditions):
        return None
    return Shape(batch, min(kept), min(summed), min(feature) if feature else None, min(own))


class Extent(NamedTuple):
    """The number of inner keys, the largest row key, and whether 32-bit floats hold all values exactly."""

    inner: int
    last: int
    floats: bool


def _extent(df: DataFrame, keys: dict[str, str], row: str, inner: str | None, values: Sequence[str]) -> Extent | None:
    """The extent, if all keys are integers from 0 on, those of rows are dense (the largest is at most 4 times their number and
    4096), values are finite and moderate, and rows are a multiple of the number of inner keys: one aggregate without a shuffle."""
    types = dict(df.dtypes)
    if any(types[c] not in _INTEGERS for c in keys.values()) or any(types[c] != "double" for c in values):
        return None
    bad = [F.count_if(~F.coalesce(F.abs(F.col(c)) <= LARGEST, F.lit(False))) for c in values] + [F.count_if(~F.coalesce(F.col(c) >= 0, F.lit(False))) for c in keys.values()]
    long = [F.count_if(F.col(c).cast("float").cast("double") != F.col(c)) for c in values]
    n, top, last, *wrong = df.agg(F.count("*"), F.max(F.col(keys[inner])) if inner else F.lit(0), F.max(F.col(keys[row])), *bad, *long).first()
    wrong, cut = wrong[: len(bad)], wrong[len(bad) :]
    return Extent(top + 1, last, not any(cut)) if n and not any(wrong) and n % (top + 1) == 0 and last < 4 * (n // (top + 1)) + 4096 else None


def _packed(df: DataFrame, batch: list[str], row: str, inner: str | None, values: list[str], block: int, size: int, dtype: str) -> DataFrame:
    """Tiles: batch keys b<i>, block, ids of rows in order, and a matrix of size columns for each value; no ids and no matrix where a
    row lacks or repeats an inner key."""
    rows = df.select(*(F.col(c).cast("bigint").alias(f"b{i}") for i, c in enumerate(batch)), F.col(row).cast("bigint").alias("id"), (F.col(inner) if inner else F.lit(0)).cast("bigint").alias("at"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))
    rows = rows.withColumn("block", F.expr(f"id div {block}"))
    keys = [*(f"b{i}" for i in range(len(batch))), "block"]
    schema = pa.schema([*((k, pa.int64()) for k in keys), ("ids", pa.binary()), ("tile", pa.binary())])

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        ids, which = np.unique(t["id"].to_numpy(), return_inverse=True)
        out = {"ids": [b""], "tile": [b""]}
        cells = which * size + t["at"].to_numpy()
        if len(t) == len(ids) * size and len(np.unique(cells)) == len(t):
            tile = np.zeros((len(values), len(t)), dtype)
            for i in range(len(values)):
                tile[i, cells] = t[f"v{i}"].to_numpy()
            out = {"ids": [ids.astype("<i8").tobytes()], "tile": [tile.tobytes()]}
        return pa.table({**{k: [v.as_py()] for k, v in zip(keys, key, strict=True)}, **out}, schema=schema)

    return rows.groupBy(*keys).applyInArrow(pack, ", ".join(f"{k} bigint" for k in keys) + ", ids binary, tile binary")


def _alike(batch: list[str], a: DataFrame, at: tuple, b: DataFrame, to: tuple) -> bool:
    """Whether two sides are the same cells of one relation, so that their tiles are the same."""
    (x, row, inner, c), (y, other, within, d) = at, to
    return [x[n] for n in batch] == [y[n] for n in batch] and (x[row], x.get(inner), c) == (y[other], y.get(within), d) and (a is b or a.sameSemantics(b))


def _squared(value: Expression | None) -> bool:
    """Whether the value is the square of the difference of one column of either side."""
    if value is None or value.op != "power" or value.args[1] != lit(2) or value.args[0].op != "-":
        return False
    return sorted(x.args[0] for x in value.args[0].args if x.op == "col") == [0, 1]


def _scores(fold: Fold, q: np.ndarray, k: np.ndarray, columns: list[list[str]], most: float = 0.0, room: np.ndarray | None = None) -> np.ndarray:
    """Scores of all pairs. most: largest sum of squares of a query and a key for which a sum of squared differences may come from a product of
    matrices, with errors of about 1e-15 times it. room: cells that products may take, as fresh ones cost more than what fills them."""
    out = None if room is None else room[: q.shape[1] * k.shape[1]].reshape(q.shape[1], k.shape[1])
    if fold.value is None:
        return np.matmul(q[0], k[0].T, out=out)
    if most and _squared(fold.value):
        a, b = (np.einsum("ij,ij->i", x[0], x[0]) for x in (q, k))
        if a.max(initial=0.0) + b.max(initial=0.0) <= most:
            out = np.matmul(q[0], -2 * k[0].T, out=out)
            out += a[:, None]
            out += b
            return np.maximum(out, 0.0, out=out)
    out = np.zeros((q.shape[1], k.shape[1]))
    for d in range(q.shape[2]):
        out += fold.value.evaluate(lambda i, n: q[columns[0].index(n), :, d][:, None] if i == 0 else k[columns[1].index(n), :, d][None, :])  # noqa: B023
    return out


def _factor(w: Weight) -> float:
    """What scales a score's absolute value."""
    by = w.scale.by
    return 1.0 if by is None else abs(by) if not w.scale.divides else 1 / abs(by) if by else float("inf")


def _most(w: Weight) -> float:
    """For _scores: weights that are exponentials keep 12 digits or more up to it; others may be as steep as they like where scores are near 0."""
    factor = _factor(w)
    return 0.0 if w.of is not None or not factor < float("inf") else EXPANDED / max(1.0, factor)


def _longest(x: np.ndarray) -> float:
    """The largest length of a row."""
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0.0)))


def _mask(conditions: Sequence[Condition], x: str, xs: np.ndarray, ys: np.ndarray) -> np.ndarray | bool:
    """Pairs that are kept; True or False where the least and largest keys tell that all or none are."""
    ends = [_kept((c,), x, np.array([xs.min(), xs.max()]), np.array([ys.min(), ys.max()])) for c in conditions]
    return True if all(e.all() for e in ends) else _kept(tuple(conditions), x, xs, ys) if all(e.any() for e in ends) else False


def _weights(w: Weight, s: np.ndarray, keep: np.ndarray | bool, shifted: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Weights, 0 where not kept, and each row's shift (None: all are 0). Scores are overwritten."""
    with np.errstate(all="ignore"):
        if w.of is not None:
            x = np.broadcast_to(w.of.evaluate(lambda i, n: s), s.shape)
            return x if keep is True else np.where(keep, x, 0.0), None
        if w.scale.by is not None:
            s = np.divide(s, w.scale.by, out=s) if w.scale.divides else np.multiply(s, w.scale.by, out=s)
        if keep is not True:
            s[~keep] = -np.inf
        if not shifted:
            return np.exp(s, out=s), None
        shift = s.max(axis=1, initial=-np.inf)
        s -= np.where(np.isfinite(shift), shift, 0.0)[:, None]
        return np.exp(s, out=s), shift


def merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(shift, number of pairs, sum, weighted sum) of several parts of the same rows."""
    shift = np.max([p[0] for p in parts], axis=0)
    n, z, a = np.zeros_like(parts[0][1]), np.zeros_like(parts[0][2]), np.zeros_like(parts[0][3])
    for s, m, x, y in parts:
        by = np.exp(np.where(m > 0, s - np.where(np.isfinite(shift), shift, 0.0), 0.0))
        n, z, a = n + m, z + np.where(m > 0, x * by, 0.0), a + np.where((m > 0)[:, None], y * by[:, None], 0.0)
    return shift, n, z, a


def _with_shift(part: list) -> tuple[np.ndarray, ...]:
    shift, n, *sums = part
    return np.where(n > 0, 0.0, -np.inf) if shift is None else shift, n, *sums


class Strip:
    """A strip of queries with its running results; keys and values pass by."""

    def __init__(self, p: Pipeline, kept: str, columns: list[list[str]], block: int):
        self.p, self.kept, self.columns, self.block = p, kept, columns, block
        self.most, self.factor = _most(p.weight), _factor(p.weight)
        self.shifted = p.weight.of is None and p.weight.shifted
        # A quotient of sums is the same for any shift.
        self.any_shift = self.shifted and p.normalizer is not None and p.producer.value is None
        self.room = np.empty(0)
        self.tiles: list[tuple[np.ndarray, np.ndarray]] = []
        self.chunks: list[list] = []
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def _gathered(self, tiles: list[tuple[np.ndarray, ...]]) -> Iterator[list[tuple[np.ndarray, ...]]]:
        """Tiles by chunk: a quarter of a block of queries, so that their scores stay in the cache."""
        some: list[tuple[np.ndarray, ...]] = []
        for t in tiles:
            some.append(t)
            if 4 * sum(len(x[0]) for x in some) >= self.block:
                yield some
                some = []
        if some:
            yield some

    def queries(self, ids: np.ndarray, q: np.ndarray) -> None:
        self.tiles.append((ids, q))

    def keys(self, ids: np.ndarray, k: np.ndarray, v: np.ndarray) -> None:
        self.waiting.append((ids, k, v))
        if len(self.waiting) >= FAN_IN or sum(len(x[0]) for x in self.waiting) >= self.block:
            self._pass()

    def _pass(self) -> None:
        if not self.chunks:
            for some in self._gathered(self.tiles):
                q = np.concatenate([t[1] for t in some], axis=1).astype(float)
                self.chunks.append([np.concatenate([t[0] for t in some]), q, None, _longest(q[0]) if self.any_shift else None])
            self.tiles = []
        f, (ids, k, v) = self.p.producer, zip(*self.waiting, strict=True)
        ids, k, v = np.concatenate(ids), np.concatenate(k, axis=1).astype(float), np.concatenate(v).astype(float)
        self.waiting = []
        longest = self.factor * _longest(k[0]) if self.any_shift else None
        if (cells := max((len(chunk[0]) for chunk in self.chunks), default=0) * len(ids)) > len(self.room):
            self.room = np.empty(cells)
        for chunk in self.chunks:
            keep = _mask(f.conditions, self.kept, chunk[0], ids)
            if keep is False:
                continue
            shifted = self.shifted and not (self.any_shift and chunk[3] * longest <= UNSHIFTED)
            w, shift = _weights(self.p.weight, _scores(f, chunk[1], k, self.columns, self.most, self.room), keep, shifted)
            with np.errstate(all="ignore"):
                part = [shift, np.full(len(w), len(ids)) if keep is True else keep.sum(axis=1), w.sum(axis=1), w @ v]
                if chunk[2] is None:
                    chunk[2] = part
                elif shift is None and chunk[2][0] is None:
                    for done, more in zip(chunk[2][1:], part[1:], strict=True):
                        done += more
                else:
                    chunk[2] = list(merge([_with_shift(chunk[2]), _with_shift(part)]))

    def results(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids that any pair reached, and a row of results for each."""
        if self.waiting:
            self._pass()
        for ids, _, done, _ in self.chunks:
            if done is not None:
                _, n, z, a = done
                at = np.flatnonzero(n > 0)
                with np.errstate(all="ignore"):
                    yield ids[at], a[at] / z[at][:, None] if self.p.normalizer else a[at]


def attention(p: Pipeline, frames: Sequence[DataFrame], values: DataFrame, value: str = "v", block: int = BLOCK, strips: int | None = None) -> DataFrame | None:
    """The rows of lower_pipeline(), or None where inputs aren't complete, finite and moderate integers-keyed arrays: one small job each tells.

    strips: their number at most where they fit STRIP_BYTES; else a few for each core.
    """
    s = shape_of(p)
    if s is None:
        return None
    f = p.producer
    (oq, ok), (q, k) = f.operands, frames
    columns = [[oq.factor], [ok.factor]] if f.value is None else [sorted(n for i, n in f.value.columns() if i == side) for side in (0, 1)]
    cells = [(o.keys, row, inner, c) for o, row, inner, c in ((oq, s.kept, s.feature, columns[0]), (ok, s.summed, s.feature, columns[1]), (p.values, s.summed, s.own, [p.values.factor]))]
    twins = _alike(s.batch, q, cells[0], k, cells[1]), _alike(s.batch, k, cells[1], values, cells[2])
    of_queries = _extent(q, *cells[0])
    of_keys = of_queries if twins[0] else _extent(k, *cells[1])
    of_values = of_keys if twins[1] else _extent(values, *cells[2])
    if of_queries is None or of_keys is None or of_values is None or of_queries.inner != of_keys.inner:
        return None
    features, width = of_queries.inner, of_values.inner
    tq, tk, tv = ("<f4" if e.floats else "<f8" for e in (of_queries, of_keys, of_values))
    count, rows = strips or PER_CORE * max(8, q.sparkSession.sparkContext.defaultParallelism), of_queries.last + 1
    own = min(max(1, block // 4), max(LEAST, -(-rows // count)))
    most = max(1, STRIP_BYTES // (8 * (features * len(columns[0]) + 2 * width + 4)) // own)
    each = min(most, max(1, -(-rows // own // count)))  # tiles of a strip
    count = -(-rows // (own * each))
    wide = own if twins[0] else block

    def tiles_of(df: DataFrame, at: tuple, rows: int, size: int, dtype: str) -> DataFrame:
        """Made once and kept: what follows reads them several times."""
        by, row, inner, c = at
        return _packed(df, [by[d] for d in s.batch], by[row], by.get(inner), c, rows, size, dtype).persist(StorageLevel.MEMORY_AND_DISK)

    queries = tiles_of(q, cells[0], own, features, tq)
    keys = queries if twins[0] else tiles_of(k, cells[1], wide, features, tk)
    vals = keys if twins[1] else tiles_of(values, cells[2], wide, width, tv)
    b = [f"b{i}" for i in range(len(s.batch))]
    wrong = [tiles.where("ids = X''") for tiles in ([queries] if twins[0] and twins[1] else [queries, keys] if twins[1] else [queries])]
    if not twins[1]:
        wrong.append(keys.select(*b, "block", F.col("ids").alias("ki")).join(vals.select(*b, "block", F.col("ids").alias("vi")), [*b, "block"], "full").where("NOT (ki <=> vi) OR ki = X''"))
    if any(not found.isEmpty() for found in wrong):
        for tiles in (queries, keys, vals):
            tiles.unpersist()
        return None

    def meets(strip: Column) -> Column:
        """Whether conditions keep any pair of the strip and the tile of keys."""
        found = F.lit(True)
        for c in f.conditions:
            low = lambda d: strip * (own * each) if d == s.kept else F.col("block") * wide
            high = lambda d: low(d) + ((own * each if d == s.kept else wide) - 1)
            left, right = (low(c.left), high(c.right) + c.offset) if c.op[0] == "<" else (high(c.left), low(c.right) + c.offset)
            found &= {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[c.op]
        return found

    every = F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))
    tiles = keys.withColumnRenamed("tile", "k")
    tiles = tiles.withColumn("v", F.lit(b"")) if twins[1] else tiles.join(vals.select(*b, "block", F.col("tile").alias("v")), [*b, "block"])
    tiles = tiles.select(F.explode(F.filter(every, meets)).alias("strip"), *b, F.lit(1).alias("side"), "block", "ids", "k", "v")
    queries = queries.select(F.expr(f"block div {each}").alias("strip"), *b, F.lit(0).alias("side"), "block", "ids", F.col("tile").alias("k"), F.lit(b"").alias("v"))
    met = queries.union(tiles).repartitionById(count, F.col("strip").cast("int")).sortWithinPartitions("strip", *b, "side", "block")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, strip = None, None

        def done() -> Iterator[pa.RecordBatch]:
            for ids, v in strip.results():
                fixed = [pa.array(np.full(v.size, x), pa.int64()) for x in at[1:]]
                found = pa.array(np.repeat(ids, width), pa.int64()), pa.array(np.tile(np.arange(width), len(ids)), pa.int64()), pa.array(v.ravel(), pa.float64())
                yield pa.RecordBatch.from_arrays([*fixed, *found], names=[*b, "t", "c", "v"])

        for batch in batches:
            heads = zip(*(batch.column(n).to_pylist() for n in ("side", "strip", *b)), strict=True)
            for i, (side, *key) in enumerate(heads):
                if key != at:
                    if strip:
                        yield from done()
                    at, strip = key, Strip(p, s.kept, columns, block)
                ids, x, v = (batch.column(n)[i].as_buffer() for n in ("ids", "k", "v"))
                ids = np.frombuffer(ids, "<i8")
                if side:
                    x = np.frombuffer(x, tk).reshape(len(columns[1]), len(ids), features)
                    strip.keys(ids, x, x[0] if twins[1] else np.frombuffer(v, tv).reshape(len(ids), width))
                else:
                    strip.queries(ids, np.frombuffer(x, tq).reshape(len(columns[0]), len(ids), features))
        if strip:
            yield from done()

    out = met.mapInArrow(weigh, "".join(f"{x} bigint, " for x in b) + "t bigint, c bigint, v double")
    kept_type, own_type = dict(q.dtypes)[oq.keys[s.kept]], dict(values.dtypes)[p.values.keys[s.own]]
    types = {d: dict(q.dtypes)[oq.keys[d]] for d in s.batch}
    by = {**{d: F.col(x).cast(types[d]) for d, x in zip(s.batch, b, strict=True)}, s.kept: F.col("t").cast(kept_type), s.own: F.col("c").cast(own_type)}
    return out.select(*(by[d].alias(d) for d in (*p.kept, s.own)), F.col("v").alias(value))
