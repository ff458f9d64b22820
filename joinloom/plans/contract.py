"""Products over several operands: the order of contraction, and sums taken early.

Catalyst joins all operands before it aggregates. Here the cheapest pair is contracted first and summed over what no other
operand and no output needs, so that intermediate results have the size of their keys, not of their joins. This re-associates sums
of floats; a guard keeps to the plain plan where a factor isn't finite or partial sums could overflow.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from math import log2, prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ir import Dimension, Fold, Operand
from .lower import from_domain, lower

#: Operands up to which all orders are tried.
EXHAUSTIVE = 9
#: log2 of the largest product of factors and row counts that is taken as safe.
SAFE_LOG2 = 1000


def order_of(dims: Sequence[frozenset[str]], outputs: frozenset[str], extents: dict[str, float]) -> list[tuple[int, int]]:
    """Pairs to contract, in order; results take the next numbers. Cost: the product of a pair's extents, and its result's size."""

    def size(d: frozenset[str]) -> float:
        return prod(extents[x] for x in d)

    n = len(dims)
    if n > EXHAUSTIVE:
        left, path = dict(enumerate(dims)), []
        while len(left) > 1:
            def kept(i: int, j: int) -> frozenset[str]:
                others = frozenset().union(outputs, *(d for k, d in left.items() if k not in (i, j)))
                return (left[i] | left[j]) & others

            i, j = min(((i, j) for i in left for j in left if i < j), key=lambda p: (size(left[p[0]] | left[p[1]]) + size(kept(*p)), p))
            new = kept(i, j)
            path.append((i, j))
            del left[i], left[j]
            left[n + len(path) - 1] = new
        return path

    everything = frozenset(range(n))

    def result(s: frozenset[int]) -> frozenset[str]:
        others = frozenset().union(outputs, *(dims[i] for i in everything - s))
        return frozenset().union(*(dims[i] for i in s)) & (others if s != everything else outputs)

    @lru_cache(None)
    def best(s: frozenset[int]) -> tuple[float, tuple]:
        if len(s) == 1:
            return 0.0, (next(iter(s)),)
        first, found = min(s), None
        rest = sorted(s - {first})
        for mask in range(1 << len(rest)):
            a = frozenset([first, *(x for k, x in enumerate(rest) if mask >> k & 1)])
            b = s - a
            if b:
                (ca, ta), (cb, tb) = best(a), best(b)
                da = dims[next(iter(a))] if len(a) == 1 else result(a)
                db = dims[next(iter(b))] if len(b) == 1 else result(b)
                cost = ca + cb + size(da | db) + size(result(s))
                if found is None or cost < found[0]:
                    found = cost, (ta, tb)
        return found

    path: list[tuple[int, int]] = []

    def walk(t: tuple) -> int:
        if len(t) == 1:
            return t[0]
        path.append((walk(t[0]), walk(t[1])))
        return n + len(path) - 1

    if n > 1:
        walk(best(everything)[1])
    return path


def measures(fold: Fold, frames: Sequence[DataFrame]) -> tuple[dict[str, float], bool, list[bool]]:
    """The extent of each dimension (its least number of distinct keys in an operand), whether the guard passes, and which operands
    surely repeat keys (twice as many rows as their keys can tell apart): one small job an operand."""
    extents: dict[str, float] = {}
    repeated: list[bool] = []
    rows, largest = 0.0, 0.0
    for o, df in zip(fold.operands, frames, strict=True):
        counts = [F.approx_count_distinct(c).alias(f"n_{d}") for d, c in o.keys.items()]
        top = F.max(F.abs(F.col(o.factor).cast("double"))).alias("top") if o.factor else F.lit(1.0).alias("top")
        r = df.agg(F.count("*").alias("rows"), top, *counts).first()
        for d in o.keys:
            extents[d] = min(extents.get(d, float("inf")), max(1, r[f"n_{d}"]))
        repeated.append(r["rows"] >= 2 * prod(max(1, r[f"n_{d}"]) for d in o.keys))
        top = r["top"] if r["top"] is not None else 0.0
        if not top < float("inf"):  # NaN is above infinity in Spark
            return extents, False, repeated
        rows += log2(max(1, r["rows"]))
        largest += log2(max(1.0, top))
    return extents, rows + largest <= SAFE_LOG2, repeated


def summed(o: Operand, df: DataFrame, value: str) -> tuple[Operand, DataFrame]:
    """The operand with one row for each key, its factors summed: products of sums are sums of products, and NULL stays where all are NULL."""
    sums = df.groupBy(*(F.col(c).alias(d) for d, c in o.keys.items())).agg(F.sum(F.col(o.factor).cast("double")).alias(value))
    return Operand({d: d for d in o.keys}, value), sums


def contract(fold: Fold, frames: Sequence[DataFrame], value: str = "v", domain: DataFrame | None = None, extents: dict[str, float] | None = None, repeated: Sequence[bool] = ()) -> DataFrame:
    """A product fold of three or more operands by pairs; others, and those that the guard holds back, as lower() has them.

    extents: known sizes of dimensions; without them, and the guard, operands are measured first. Operands that repeat keys are summed by key
    before any join, since joins of few keys grow with the product of their rows.
    """
    product_of_all = fold.is_einsum and not fold.conditions and all(o.factor for o in fold.operands)
    if not product_of_all or len(frames) < 3 or any(not o.keys for o in fold.operands):
        return lower(fold, frames, value, domain)
    if extents is None:
        extents, safe, repeated = measures(fold, frames)
        if not safe:
            return lower(fold, frames, value, domain)
    dims = [fold.dims_of(i) for i in range(len(frames))]
    path = order_of(dims, frozenset(fold.outputs), extents)
    left: dict[int, tuple[Operand, DataFrame]] = {i: summed(o, df, "__sum") if again else (o, df) for i, (o, df, again) in enumerate(zip(fold.operands, frames, repeated or [False] * len(frames), strict=True))}
    for k, (i, j) in enumerate(path):
        a, b = left.pop(i), left.pop(j)
        last = k + 1 == len(path)
        needed = set(fold.outputs).union(*(o.keys for o, _ in left.values()))
        both = [d for d in {**a[0].keys, **b[0].keys}]
        kept = tuple(fold.outputs) if last else tuple(d for d in both if d in needed)
        pair = Fold((a[0], b[0]), tuple(d for d in fold.dimensions if d.name in both), kept)
        out = lower(pair, (a[1], b[1]), value)
        left[len(frames) + k] = (Operand({d: d for d in kept}, value), out)
    out = left.popitem()[1][1]
    return from_domain(fold, out, domain, value) if fold.domain else out


def einsum(spec: str, *operands: tuple[DataFrame, Sequence[str], str], value: str = "v") -> DataFrame:
    """``einsum("ij,jk->ik", (a, ["i", "j"], "v"), (b, ["j", "k"], "v"))``: each operand with its key columns in the order of its letters."""
    left, right = spec.replace(" ", "").split("->")
    letters = left.split(",")
    if len(letters) != len(operands):
        raise ValueError("an operand for each term")
    if any(len(set(t)) != len(t) for t in letters):
        raise ValueError("a letter twice in one term")
    ops = tuple(Operand(dict(zip(t, keys, strict=True)), v) for t, (_, keys, v) in zip(letters, operands, strict=True))
    fold = Fold(ops, tuple(Dimension(x) for x in dict.fromkeys("".join(letters))), tuple(right))
    return contract(fold, [df for df, _, _ in operands], value)


def join_back(fold: Fold, frames: Sequence[DataFrame], domain: DataFrame, value: str = "v") -> DataFrame:
    """``domain LEFT JOIN (SELECT keys, SUM(e) FROM domain JOIN fold GROUP BY keys)`` in one left join where the domain's keys are unique, else as written.

    The regrouped copy sums each value once for each domain row of its key; with unique keys that is the value itself.
    """
    d = fold.domain
    keys = list(d.keys.values())
    bare = Fold(fold.operands, fold.dimensions, fold.outputs, fold.value, fold.aggregate, None, fold.conditions)
    out = contract(bare, frames, value)
    if domain.groupBy(*keys).count().where("count > 1").isEmpty():
        return from_domain(fold, out, domain, value)
    copies = domain.groupBy(*(F.col(c).alias(f"__d_{k}") for k, c in d.keys.items())).agg(F.count("*").alias("__n"))
    on = [F.col(k).eqNullSafe(F.col(f"__d_{k}")) if fold.null_safe(k) else F.col(k) == F.col(f"__d_{k}") for k in d.keys]
    for c in on[1:]:
        on[0] = on[0] & c
    out = out.join(copies, on[0]).select(*fold.outputs, (F.col(value) * F.col("__n")).alias(value))
    return from_domain(fold, out, domain, value)
