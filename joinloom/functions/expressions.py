"""Row expressions over DOUBLE columns, for Spark and for arrays alike, and IEEE arithmetic where Spark's differs.

Spark raises on division by zero and gives NULL for the logarithm of what isn't positive; the functions here give
infinities and NaN. NULL in gives NULL out.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_NAN, _INF = math.nan, math.inf


def ieee_divide(a: Column, b: Column) -> Column:
    zero = F.when(F.isnan(a) | (a == 0), F.lit(_NAN)).when((a > 0) == ~b.cast("double").cast("string").startswith("-"), F.lit(_INF)).otherwise(F.lit(-_INF))
    return F.when(b.isNull() | a.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(F.try_divide(a, b))


def ieee_remainder(a: Column, b: Column) -> Column:
    return F.when(b.isNull() | a.isNull(), F.lit(None).cast("double")).when(b == 0, F.lit(_NAN)).otherwise(F.try_mod(a, b))


def ieee_ln(a: Column) -> Column:
    return F.when(a == 0, F.lit(-_INF)).when(a < 0, F.lit(_NAN)).otherwise(F.ln(a))


_UNARY: dict[str, tuple[Callable, Callable]] = {
    "neg": (lambda x: -x, np.negative),
    "abs": (F.abs, np.abs),
    "exp": (F.exp, np.exp),
    "ln": (ieee_ln, np.log),
    "tanh": (F.tanh, np.tanh),
    "signum": (F.signum, np.sign),
}
_BINARY: dict[str, tuple[Callable, Callable]] = {
    "+": (lambda a, b: a + b, np.add),
    "-": (lambda a, b: a - b, np.subtract),
    "*": (lambda a, b: a * b, np.multiply),
    "/": (ieee_divide, np.divide),
    "power": (F.pow, lambda a, b: np.square(a) if np.ndim(b) == 0 and b == 2 else np.power(a, b)),
}


@dataclass(frozen=True)
class Expression:
    """A column (operand number, name), a literal, or an operation on expressions."""

    op: str
    args: tuple = ()

    def columns(self) -> set[tuple[int, str]]:
        if self.op == "col":
            return {self.args}
        return set().union(*(a.columns() for a in self.args if isinstance(a, Expression))) if self.op != "lit" else set()

    def to_column(self, of: Callable[[int, str], Column]) -> Column:
        if self.op == "col":
            return of(*self.args)
        if self.op == "lit":
            return F.lit(float(self.args[0]))
        args = [a.to_column(of) for a in self.args]
        return (_UNARY if len(args) == 1 else _BINARY)[self.op][0](*args)

    def evaluate(self, of: Callable[[int, str], np.ndarray]) -> np.ndarray:
        if self.op == "col":
            return of(*self.args)
        if self.op == "lit":
            return np.float64(self.args[0])
        args = [a.evaluate(of) for a in self.args]
        with np.errstate(all="ignore"):
            return (_UNARY if len(args) == 1 else _BINARY)[self.op][1](*args)

    def __add__(self, o): return Expression("+", (self, _of(o)))  # noqa: E704
    def __radd__(self, o): return Expression("+", (_of(o), self))  # noqa: E704
    def __sub__(self, o): return Expression("-", (self, _of(o)))  # noqa: E704
    def __rsub__(self, o): return Expression("-", (_of(o), self))  # noqa: E704
    def __mul__(self, o): return Expression("*", (self, _of(o)))  # noqa: E704
    def __rmul__(self, o): return Expression("*", (_of(o), self))  # noqa: E704
    def __truediv__(self, o): return Expression("/", (self, _of(o)))  # noqa: E704
    def __rtruediv__(self, o): return Expression("/", (_of(o), self))  # noqa: E704
    def __pow__(self, o): return Expression("power", (self, _of(o)))  # noqa: E704
    def __neg__(self): return Expression("neg", (self,))  # noqa: E704
    def abs(self): return Expression("abs", (self,))  # noqa: E704
    def exp(self): return Expression("exp", (self,))  # noqa: E704
    def ln(self): return Expression("ln", (self,))  # noqa: E704
    def tanh(self): return Expression("tanh", (self,))  # noqa: E704
    def signum(self): return Expression("signum", (self,))  # noqa: E704


def _of(x) -> Expression:
    return x if isinstance(x, Expression) else lit(x)


def col(operand: int, name: str) -> Expression:
    return Expression("col", (operand, name))


def lit(x: float) -> Expression:
    return Expression("lit", (float(x),))
