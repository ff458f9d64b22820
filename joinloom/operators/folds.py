"""The cheapest shape that gives the plain plan's rows: tiles for dense integer keys, ranges where sparse ones meet often, early sums for several factors, else joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..ir import Fold, Pipeline
from ..plans.contract import contract
from ..plans.lower import from_domain, lower, lower_pipeline
from .attention import attention
from .dense import dense_fold, worth
from .ranged import range_width, ranged_fold

#: How often each way was taken; "host" is the plain plan.
metrics = {"dense_folds": 0, "ranged_folds": 0, "contractions": 0, "fused_pipelines": 0, "host_plans": 0}


def run_fold(fold: Fold, frames: Sequence[DataFrame], value: str = "v", domain: DataFrame | None = None) -> DataFrame:
    frames = list(frames)
    if len(frames) == 2 and (extents := worth(fold, frames)):
        metrics["dense_folds"] += 1
        out = dense_fold(fold, frames, value, extents=extents)
        return from_domain(fold, out, domain, value) if fold.domain else out
    if len(frames) == 2 and (width := range_width(fold, frames)):
        metrics["ranged_folds"] += 1
        out = ranged_fold(fold, frames, width, value)
        return from_domain(fold, out, domain, value) if fold.domain else out
    if len(frames) > 2 and fold.is_einsum and not fold.conditions:
        metrics["contractions"] += 1
        return contract(fold, frames, value, domain)
    metrics["host_plans"] += 1
    return lower(fold, frames, value, domain)


def run_pipeline(p: Pipeline, frames: Sequence[DataFrame], values: DataFrame, value: str = "v") -> DataFrame:
    out = attention(p, frames, values, value)
    metrics["host_plans" if out is None else "fused_pipelines"] += 1
    return lower_pipeline(p, frames, values, value) if out is None else out
