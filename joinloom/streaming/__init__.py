"""Folds over a stream joined with static operands.

Only the plain plan is incremental: a stream-static join and a streaming aggregation. There are no watermarks here, so
results come in update or complete mode, and state grows with the number of groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..ir import Fold
from ..plans.lower import lower


def stream_fold(fold: Fold, frames: Sequence[DataFrame], value: str = "v") -> DataFrame:
    """The fold where one operand is a stream."""
    if sum(df.isStreaming for df in frames) != 1:
        raise ValueError("one operand is a stream")
    if fold.domain is not None:
        raise ValueError("a stream has no domain")
    return lower(fold, frames, value)
