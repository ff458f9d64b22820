"""Two-operand products over dense integer keys, block by block.

Operands are packed into tiles of at most ``block`` keys a side, rows of a DataFrame like any other: tiles that meet are joined on their
block of the summed dimension and their strips of the output, multiplied as matrices in Arrow batches, and partial products are summed by output block. No
join row of the plain plan ever exists, no task holds more than a few tiles, and any number of tiles spreads over the cluster.

Rows keep SQL's meaning: duplicate keys count each, a group exists if any joined row reaches it, its sum is NULL if all its
factors' products are, and absent cells take part in nothing (infinities and NaN meet only what they join).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ir import Condition, Fold

BLOCK = 512
Backend = Callable[[np.ndarray, np.ndarray], np.ndarray]
_TILE = "w bigint, x bigint, z bigint, ids binary, m bigint, value binary, state binary"


def roles(fold: Fold) -> tuple[list[str], list[str], list[str], list[str]] | None:
    """Dimensions in both operands and the output, in one operand and the output (left, right), and summed; None if there are others."""
    if len(fold.operands) != 2 or not fold.is_einsum or not all(o.factor for o in fold.operands):
        return None
    a, b, out = fold.dims_of(0), fold.dims_of(1), set(fold.outputs)
    w, x, y, z = a & b & out, (a - b) & out, (b - a) & out, (a & b) - out
    if len(w) > 1 or len(x) != 1 or len(y) != 1 or len(z) != 1 or (a | b) - out - z or any(d.null_safe for d in fold.dimensions):
        return None
    if any({c.left, c.right} != x | y for c in fold.conditions):
        return None
    return [sorted(s) for s in (w, x, y, z)]


#: Cells a row up to which tiles pay where the join would have JOINED rows or more, and multiplications that cost as much as one joined row.
LOOSE, JOINED, PER_JOINED = 64, 1 << 22, 2048
#: Tiles a side of a task's strip of the output; strips are widened while there are SPARE times as many pairs of them as tasks, up to STRIP_BYTES a side.
STRIP, SPARE, STRIP_BYTES = 16, 4, 64 << 20
#: Times a block's keys in a tile at most, where a batch dimension leaves each batch only some of them.
WIDER = 16


def worth(fold: Fold, frames: list[DataFrame], cells_per_row: int = 4, least_products: int = 1 << 20) -> dict[str, int] | None:
    """Extents of the dimensions if tiles pay, else None: keys are integers from 0 on, products are many, and there are at most 4 cells a row
    and 4096, or 64 cells a row where the join would be far larger than the product. One small job an operand."""
    r = roles(fold)
    if r is None:
        return None
    w, (x,), (y,), (z,) = r
    extents, rows, loose = {}, [], False
    for o, df in zip(fold.operands, frames, strict=True):
        if any(dict(df.dtypes)[c] not in ("tinyint", "smallint", "int", "bigint") for c in o.keys.values()) or dict(df.dtypes)[o.factor] != "double":
            return None
        ends = df.agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{d}") for d, c in o.keys.items() for n, f in (("low", F.min), ("high", F.max))), *(F.count(c).alias(f"full_{d}") for d, c in o.keys.items())).first()
        if not ends["n"] or any(ends[f"full_{d}"] < ends["n"] or ends[f"low_{d}"] < 0 for d in o.keys):
            return None
        own = {d: ends[f"high_{d}"] + 1 for d in o.keys}
        cells = 1
        for d in own:
            cells *= own[d]
            extents[d] = max(extents.get(d, 0), own[d])
        if cells > LOOSE * ends["n"] + 4096:
            return None
        loose |= cells > cells_per_row * ends["n"] + 4096
        rows.append(ends["n"])
    batches = extents[w[0]] if w else 1
    total = extents[x] * extents[y] * extents[z] * batches
    joined = rows[0] * rows[1] // (extents[z] * batches)  # of keys that are spread evenly; fewer than of others
    if loose and (joined < JOINED or total > PER_JOINED * joined):
        return None
    return extents if total >= least_products else None


def tiles(df: DataFrame, w: str | None, x: str, z: str, value: str, block: int, wide: int) -> DataFrame:
    """A row for each tile of wide x block keys with any row: the x keys that have one, values of n x m cells up to the last z key (NULL as 0, duplicates
    summed; 32-bit floats where these hold them exactly), and states (1: a row, 2: a value; none where all cells have both)."""
    rows = df.select((F.col(w) if w else F.lit(0)).cast("bigint").alias("w"), F.col(x).cast("bigint").alias("xk"), F.col(z).cast("bigint").alias("zk"), F.col(value).cast("double").alias("v"))
    rows = rows.withColumns({"x": F.expr(f"xk div {wide}"), "z": F.expr(f"zk div {block}")})

    def packed(key: tuple, t: pa.Table) -> pa.Table:
        (ids, xs), zs = np.unique(t["xk"].to_numpy(), return_inverse=True), t["zk"].to_numpy() - key[2].as_py() * block
        n, m = len(ids), int(zs.max()) + 1
        at = xs * m + zs
        order = np.argsort(at, kind="stable")  # sums in the order of keys
        v = t["v"].to_numpy(zero_copy_only=False)[order]
        full = ~t["v"].is_null().to_numpy(zero_copy_only=False)[order]
        at = at[order]
        values = np.bincount(at, np.where(full, v, 0.0), n * m)
        state = np.zeros(n * m, np.uint8)
        state[at] = 1
        state[at[full]] = 3
        with np.errstate(over="ignore"):
            short = values.astype("<f4")
        values = short if (short == values).all() else values
        found = {"ids": [ids.astype("<i8").tobytes()], "m": [m], "value": [values.tobytes()], "state": [b"" if (state == 3).all() else state.tobytes()]}
        return pa.table({**{k: [key[i].as_py()] for i, k in enumerate("wxz")}, **found}, schema=schema)

    schema = pa.schema([*((k, pa.int64()) for k in "wxz"), ("ids", pa.binary()), ("m", pa.int64()), ("value", pa.binary()), ("state", pa.binary())])
    return rows.groupBy("w", "x", "z").applyInArrow(packed, _TILE)


def unpacked(ids: bytes, m: int, value: bytes, state: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, values and states of a tile."""
    keys = np.frombuffer(ids, "<i8")
    cells = len(keys) * m
    values = np.frombuffer(value, "<f4" if len(value) == 4 * cells else "<f8").astype(float)
    return keys, values.reshape(-1, m), (np.frombuffer(state, np.uint8) if len(state) else np.full(cells, 3, np.uint8)).reshape(-1, m)


def multiply(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, matmul: Backend) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, whether any row reached each cell, and whether any had a value. sa, sb: states (x, z) and (y, z)."""
    met = lambda bit: (sa & bit > 0).astype(np.float32) @ (sb & bit > 0).astype(np.float32).T > 0
    if (sa == 3).all() and (sb == 3).all():
        reached = valued = np.ones((len(a), len(b)), bool)
    else:
        reached = met(1)
        valued = met(2) if (sa == 1).any() or (sb == 1).any() else reached
    if np.isfinite(a).all() and np.isfinite(b).all():
        return matmul(a, b.T), reached, valued
    out = np.zeros((len(a), len(b)))
    with np.errstate(all="ignore"):
        for k in range(a.shape[1]):  # only pairs of present cells meet
            i, j = np.flatnonzero(sa[:, k] & 2), np.flatnonzero(sb[:, k] & 2)
            if len(i) and len(j):
                out[np.ix_(i, j)] += np.outer(a[i, k], b[j, k])
    return out, reached, valued


def _kept(conditions: tuple[Condition, ...], x: str, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    keep = np.ones((len(xs), len(ys)), bool)
    for c in conditions:
        left, right = (xs[:, None], ys[None, :] + c.offset) if c.left == x else (ys[None, :], xs[:, None] + c.offset)
        keep &= {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[c.op]
    return keep


def dense_fold(fold: Fold, frames: list[DataFrame], value: str = "v", block: int = BLOCK, matmul: Backend = np.matmul, extents: dict[str, int] | None = None) -> DataFrame:
    """The rows of lower(fold, frames); see worth() for when, and for the extents. matmul: arithmetic of one's own for a product of two matrices.

    Tiles meet on their block of the summed dimension and on a pair of strips of output blocks, to which they are copied: so the
    products spread over tasks even where the summed dimension is a single block.
    """
    w, (x,), (y,), (z,) = roles(fold)
    names = [w[0] if w else None, x, y]
    (oa, ob), (da, db) = fold.operands, frames
    if extents is None:
        extents = {}
        for o, df in zip(fold.operands, frames, strict=True):
            for d, top in zip(o.keys, df.agg(*(F.max(c) for c in o.keys.values())).first(), strict=True):
                extents[d] = max(extents.get(d, 0), 1 + (-1 if top is None else top))
    single = extents[z] <= block
    wide = block * min(WIDER, max(1, extents[w[0]])) if w and single else block
    blocks = {d: max(1, -(-n // (block if d == z else wide))) for d, n in extents.items()}
    strip, tasks = STRIP, int(da.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs_of = lambda strip: blocks[z] * -(-blocks[x] // strip) * -(-blocks[y] // strip)
    while strip > 1 and pairs_of(strip) < tasks:
        strip //= 2
    while pairs_of(strip) > SPARE * tasks and 2 * strip * wide * min(block, extents[z]) * 9 <= STRIP_BYTES:
        strip *= 2

    def strips(own: str, other: str, d: str) -> list:
        """The strip of a tile's own block, and a copy for each strip of the other side."""
        return [F.expr(f"{own} div {strip}").alias(f"s{own}"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((blocks[d] - 1) // strip).cast("bigint"))).alias(f"s{other}")]

    left = tiles(da, oa.keys[w[0]] if w else None, oa.keys[x], oa.keys[z], oa.factor, block, wide)
    right = tiles(db, ob.keys[w[0]] if w else None, ob.keys[y], ob.keys[z], ob.factor, block, wide)
    left = left.toDF("w", "x", "z", "ia", "ma", "a", "sa").select("*", *strips("x", "y", y))
    right = right.toDF("w2", "y", "z2", "ib", "mb", "b", "sb").select("*", *strips("y", "x", x)).withColumnsRenamed({"sx": "sx2", "sy": "sy2"})
    meets = (F.col("w") == F.col("w2")) & (F.col("z") == F.col("z2")) & (F.col("sx") == F.col("sx2")) & (F.col("sy") == F.col("sy2"))
    for c in fold.conditions:  # block pairs that a condition leaves nothing
        low = lambda k: F.col("x" if k == x else "y") * wide
        high = lambda k: low(k) + wide - 1
        a, b = (low(c.left), high(c.right) + c.offset) if c.op[0] == "<" else (high(c.left), low(c.right) + c.offset)
        meets &= {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[c.op]
    conditions = fold.conditions

    def rows(k: int, xs: np.ndarray, ys: np.ndarray, total: np.ndarray, flags: np.ndarray) -> dict[str, pa.Array]:
        i, j = np.nonzero(flags & 1)
        return {"w": pa.array(np.full(len(i), k), pa.int64()), "x": pa.array(xs[i], pa.int64()), "y": pa.array(ys[j], pa.int64()), "v": pa.array(total[i, j], mask=(flags[i, j] & 2) == 0)}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                k = min(r["ma"], r["mb"])  # beyond it, one of the two has nothing
                (xs, a, sa), (ys, b, sb) = ((ids, v[:, :k], state[:, :k]) for ids, v, state in (unpacked(r[f"i{n}"], r[f"m{n}"], r[n], r[f"s{n}"]) for n in "ab"))
                for at, other in ((slice(p, p + block), slice(q, q + block)) for p in range(0, len(xs), block) for q in range(0, len(ys), block)):
                    keep = _kept(conditions, x, xs[at], ys[other])
                    if not keep.any():
                        continue
                    out, reached, valued = multiply(a[at], b[other], sa[at], sb[other], matmul)
                    flags = ((reached & keep) | ((valued & keep) << 1)).astype(np.uint8)
                    if flags.any() and single:
                        yield pa.RecordBatch.from_pydict(rows(r["w"], xs[at], ys[other], out, flags))
                    elif flags.any():
                        yield pa.RecordBatch.from_arrays([*(pa.array([r[n]], pa.int64()) for n in "wxyz"), *(pa.array([v.tobytes()]) for v in (xs[at], ys[other], out, flags))], names=["w", "x", "y", "z", "xs", "ys", "out", "flags"])

    pairs = left.join(right.hint("merge"), meets).select("w", "x", "y", "z", "ia", "ma", "a", "sa", "ib", "mb", "b", "sb")

    def summed(t: pa.Table) -> pa.Table:
        total, flags = np.zeros((block, block)), np.zeros((block, block), np.uint8)
        k = {n: t[n][0].as_py() for n in "wxy"}
        for i in np.argsort(t["z"].to_numpy()).tolist():  # in the order of blocks: the same bits however tasks ran
            at = np.ix_(*(np.frombuffer(t[f"{n}s"][i].as_py(), "<i8") - k[n] * block for n in "xy"))
            total[at] += np.frombuffer(t["out"][i].as_py()).reshape(total[at].shape)
            flags[at] |= np.frombuffer(t["flags"][i].as_py(), np.uint8).reshape(flags[at].shape)
        return pa.table(rows(k["w"], k["x"] * block + np.arange(block), k["y"] * block + np.arange(block), total, flags))

    if single:
        out = pairs.mapInArrow(products, "w bigint, x bigint, y bigint, v double")
    else:
        partial = pairs.mapInArrow(products, "w bigint, x bigint, y bigint, z bigint, xs binary, ys binary, out binary, flags binary")
        out = partial.groupBy("w", "x", "y").applyInArrow(summed, "w bigint, x bigint, y bigint, v double")
    of = dict(zip(names, "wxy", strict=True))
    types = {k: dict(df.dtypes)[c] for o, df in zip(fold.operands, frames, strict=True) for k, c in o.keys.items()}
    return out.select(*(F.col(of[d]).cast(types[d]).alias(d) for d in fold.outputs), F.col("v").alias(value))
