"""Two-operand products over sparse integer keys, range by range of the summed dimension.

Where many joined rows fall on few groups, the plain plan sends or spills most of them before their sums. Here both operands meet by range of
the summed key; a task multiplies one range as matrices over the keys that occur in it, and one row for each group of a range is left to sum.
Taken only where that is at most half of the joined rows, which is counted, and where ranges are of bounded size. Rows keep SQL's
meaning as in ``dense``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ir import Fold
from .dense import BLOCK, multiply, roles

#: Rows of a range on average and at most, groups of a range at most, and joined rows from which ranges are considered.
ROWS, MOST_ROWS, MOST_CELLS, JOINED = 1 << 18, 1 << 21, 1 << 23, 1 << 22
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _sides(fold: Fold, frames: Sequence[DataFrame], width: int = 1) -> list[DataFrame]:
    """Either operand as range r, summed key z, own key x, value v; a NULL of the summed key joins nothing."""
    _, (x,), (y,), (z,) = roles(fold)
    return [
        df.select(F.expr(f"`{o.keys[z]}` div {width}").alias("r"), F.col(o.keys[z]).cast("bigint").alias("z"), F.col(o.keys[d]).cast("bigint").alias("x"), F.col(o.factor).alias("v")).where("z IS NOT NULL")
        for o, df, d in zip(fold.operands, frames, (x, y), strict=True)
    ]


def range_width(fold: Fold, frames: Sequence[DataFrame]) -> int | None:
    """Summed keys of a range if ranges pay, else None: one small job an operand, and one that counts joined rows and groups by range."""
    r = roles(fold)
    if r is None or r[0] or fold.conditions:
        return None
    z, span, rows = r[3][0], 0, []
    for o, df in zip(fold.operands, frames, strict=True):
        if any(dict(df.dtypes)[c] not in _INTEGERS for c in o.keys.values()) or dict(df.dtypes)[o.factor] != "double":
            return None
        own = next(c for d, c in o.keys.items() if d != z)
        n, full, low, high = df.agg(F.count("*"), F.count(own), F.min(o.keys[z]), F.max(o.keys[z])).first()
        if full < n or low is None:
            return None
        span, rows = max(span, high - low + 1), [*rows, n]
    if rows[0] * rows[1] < JOINED:
        return None
    width = max(1, span * ROWS // max(rows))
    left, right = (side.withColumn("side", F.lit(i)) for i, side in enumerate(_sides(fold, frames, width)))
    both = left.union(right)
    of = lambda i, c: F.when(F.col("side") == i, F.col(c))
    joined = both.groupBy("r", "z").agg(F.count(of(0, "z")).alias("l"), F.count(of(1, "z")).alias("m")).groupBy("r").agg(F.sum(F.col("l") * F.col("m")).alias("joined"), F.greatest(F.sum("l"), F.sum("m")).alias("rows"))
    groups = both.groupBy("r").agg((F.approx_count_distinct(of(0, "x")) * F.approx_count_distinct(of(1, "x"))).alias("cells"))
    total, most_rows, cells, most_cells = joined.join(groups, "r").agg(F.sum("joined"), F.max("rows"), F.sum("cells"), F.max("cells")).first()
    return width if total >= JOINED and 2 * cells <= total and most_rows <= MOST_ROWS and most_cells <= MOST_CELLS else None


def _matrix(x: np.ndarray, z: np.ndarray, v: np.ndarray, full: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    at = x * m + z
    values, state = np.bincount(at, np.where(full, v, 0.0), n * m), np.zeros(n * m, np.uint8)
    state[at] = 1
    state[at[full]] = 3
    return values.reshape(n, m), state.reshape(n, m)


def ranged_fold(fold: Fold, frames: Sequence[DataFrame], width: int, value: str = "v") -> DataFrame:
    """The rows of lower(fold, frames); see range_width() for when."""
    _, (x,), (y,), _ = roles(fold)

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = []
        for t in (left, right):  # in the order of summed keys: the same bits however rows came
            zs, xs = t["z"].to_numpy(), t["x"].to_numpy()
            v, full = t["v"].to_numpy(zero_copy_only=False), ~t["v"].is_null().to_numpy(zero_copy_only=False)
            by = np.lexsort((v, xs, zs))
            ids, at = np.unique(xs[by], return_inverse=True)
            sides.append((ids, at, zs[by], v[by], full[by]))
        keys = np.intersect1d(sides[0][2], sides[1][2])
        n, m = (len(s[0]) for s in sides)
        total, flags = np.zeros((n, m)), np.zeros((n, m), np.uint8)
        for some in (keys[i : i + BLOCK] for i in range(0, len(keys), BLOCK)):
            ab = []
            for ids, at, zs, v, full in sides:
                part = slice(np.searchsorted(zs, some[0]), np.searchsorted(zs, some[-1], "right"))
                col = np.minimum(np.searchsorted(some, zs[part]), len(some) - 1)
                met = some[col] == zs[part]
                ab.append(_matrix(at[part][met], col[met], v[part][met], full[part][met], len(ids), len(some)))
            (a, sa), (b, sb) = ab
            out, reached, valued = multiply(a, b, sa, sb, np.matmul)
            with np.errstate(all="ignore"):
                total += out
            flags |= reached | (valued.astype(np.uint8) << 1)
        i, j = np.nonzero(flags & 1)
        return pa.table({"x": pa.array(sides[0][0][i], pa.int64()), "y": pa.array(sides[1][0][j], pa.int64()), "v": pa.array(total[i, j], pa.float64(), mask=(flags[i, j] & 2) == 0)})

    spark = frames[0].sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    left, right = (side.repartition(parts, "r").groupBy("r") for side in _sides(fold, frames, width))
    sums = left.cogroup(right).applyInArrow(product, "x bigint, y bigint, v double").groupBy("x", "y").agg(F.sum("v").alias("v"))
    types = {d: dict(df.dtypes)[c] for o, df in zip(fold.operands, frames, strict=True) for d, c in o.keys.items()}
    return sums.select(*(F.col({x: "x", y: "y"}[d]).cast(types[d]).alias(d) for d in fold.outputs), F.col("v").alias(value))
