"""Folds and pipelines as plain joins and aggregations, which hold for all data."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ieee_divide
from ..ir import Condition, Domain, Fold, Operand, Pipeline, Weight

_OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _projected(i: int, o: Operand, df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The operand's columns under names of its own: o<i>_k_<dimension>, o<i>_f, o<i>_c_<column>."""
    keys = [F.col(c).alias(f"o{i}_k_{d}") for d, c in o.keys.items()]
    factor = [F.col(o.factor).cast("double").alias(f"o{i}_f")] if o.factor else []
    return df.select(*keys, *factor, *(F.col(c).cast("double").alias(f"o{i}_c_{c}") for c in extra))


def _compare(c: Condition, left: Column, right: Column) -> Column:
    return _OPS[c.op](left, right + F.lit(c.offset) if c.offset else right)


def joined(fold: Fold, frames: Sequence[DataFrame]) -> tuple[DataFrame, dict[str, Column]]:
    """The rows of the fold's join, and a column for each dimension."""
    extra = [[name for j, name in sorted(fold.value.columns()) if j == i] if fold.value else [] for i in range(len(frames))]
    parts = [_projected(i, o, df, extra[i]) for i, (o, df) in enumerate(zip(fold.operands, frames, strict=True))]
    todo, rows, at, waiting = list(range(1, len(parts))), parts[0], {d: F.col(f"o0_k_{d}") for d in fold.operands[0].keys}, list(fold.conditions)
    while todo:
        # Next the operand that shares most dimensions with those joined so far.
        i = max(todo, key=lambda i: (len(fold.dims_of(i) & at.keys()), -i))
        todo.remove(i)
        keys = {d: F.col(f"o{i}_k_{d}") for d in fold.operands[i].keys}
        on = [at[d].eqNullSafe(k) if fold.null_safe(d) else at[d] == k for d, k in keys.items() if d in at]
        at |= {d: k for d, k in keys.items() if d not in at}
        ready = [c for c in waiting if c.left in at and c.right in at]
        waiting = [c for c in waiting if c not in ready]
        on += [_compare(c, at[c.left], at[c.right]) for c in ready]
        rows = rows.join(parts[i], reduce(operator.and_, on), "inner") if on else rows.crossJoin(parts[i])
    for c in waiting:
        rows = rows.where(_compare(c, at[c.left], at[c.right]))
    return rows, at


def row_value(fold: Fold) -> Column:
    if fold.value is not None:
        return fold.value.to_column(lambda i, name: F.col(f"o{i}_c_{name}"))
    factors = [F.col(f"o{i}_f") for i, o in enumerate(fold.operands) if o.factor]
    return reduce(operator.mul, factors) if factors else F.lit(1.0)


_AGGREGATES = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "bool_and": lambda c: F.bool_and(c != 0), "bool_or": lambda c: F.bool_or(c != 0)}


def lower(fold: Fold, frames: Sequence[DataFrame], value: str = "v", domain: DataFrame | None = None) -> DataFrame:
    """The fold as a join and an aggregation: a row for each group that a joined row reaches."""
    rows, at = joined(fold, frames)
    what = _AGGREGATES[fold.aggregate](row_value(fold)).alias(value)
    out = rows.groupBy(*(at[d].alias(d) for d in fold.outputs)).agg(what) if fold.outputs else rows.agg(what)
    return from_domain(fold, out, domain, value) if fold.domain else out


def from_domain(fold: Fold, folded: DataFrame, domain: DataFrame, value: str) -> DataFrame:
    """Every row of the domain, with the value of its keys, else the missing one."""
    d: Domain = fold.domain
    right = folded.select(*(F.col(k).alias(f"__{k}") for k in fold.outputs), F.col(value).alias("__value"))
    on = [F.col(c).eqNullSafe(F.col(f"__{k}")) if fold.null_safe(k) else F.col(c) == F.col(f"__{k}") for k, c in d.keys.items()]
    found = domain.join(right, reduce(operator.and_, on), "left")
    filled = F.col("__value") if d.missing is None else F.coalesce("__value", F.lit(float(d.missing)))
    return found.select(*d.columns, filled.alias(value))


def weighted(weight: Weight, s: Column, kept: Sequence[str]) -> Column:
    if weight.of is not None:
        return weight.of.to_column(lambda i, name: s)
    if weight.scale.by is not None:
        s = ieee_divide(s, F.lit(float(weight.scale.by))) if weight.scale.divides and weight.scale.by == 0 else s / weight.scale.by if weight.scale.divides else s * weight.scale.by
    return F.exp(s - F.max(s).over(Window.partitionBy(*kept))) if weight.shifted else F.exp(s)


def lower_pipeline(p: Pipeline, frames: Sequence[DataFrame], values: DataFrame, value: str = "v") -> DataFrame:
    """Scores, weights, their normalizer and the weighted sum, each as a relation."""
    # Own columns have names that no dimension has.
    pairs = lower(p.producer, frames, "__s")
    weights = pairs.select(*p.producer.outputs, weighted(p.weight, F.col("__s"), p.kept).alias("__w"))
    own = [d for d in p.values.keys if d not in p.producer.outputs]
    right = values.select(*(F.col(c).alias(f"__v_{d}") for d, c in p.values.keys.items()), F.col(p.values.factor).cast("double").alias("__y"))
    shared = [d for d in p.values.keys if d in p.producer.outputs]
    rows = weights.join(right, reduce(operator.and_, (F.col(d) == F.col(f"__v_{d}") for d in shared)))
    groups = [*p.kept, *(F.col(f"__v_{d}").alias(d) for d in own)]
    product = F.sum(F.col("__w") * F.col("__y")).alias("__a")
    if p.normalizer == "rows":
        return rows.groupBy(*groups).agg(product, F.sum("__w").alias("__z")).select(*p.kept, *own, ieee_divide(F.col("__a"), F.col("__z")).alias(value))
    sums = rows.groupBy(*groups).agg(product)
    if p.normalizer is None:
        return sums.withColumnRenamed("__a", value)
    norm = weights.groupBy(*p.kept).agg(F.sum("__w").alias("__z"))
    return sums.join(norm, [*p.kept]).select(*p.kept, *own, ieee_divide(F.col("__a"), F.col("__z")).alias(value))
