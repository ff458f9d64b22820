"""IEEE expressions in Spark and on arrays."""

import math

import numpy as np
import pytest

from joinloom.functions import col, ieee_divide, ieee_ln, ieee_remainder

SPECIAL = [0.0, -0.0, 1.0, -2.5, math.inf, -math.inf, math.nan, 1e-308, None]
A, B = col(0, "a"), col(0, "b")


def equal(x, y):
    return (x is None) == (y is None) and (x is None or (math.isnan(x) and math.isnan(y)) or (x == y and math.copysign(1, x) == math.copysign(1, y)) or abs(x - y) <= 1e-12 * abs(y))


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(a, b) for a in SPECIAL for b in SPECIAL], "a double, b double")


@pytest.mark.parametrize("f,g", [(ieee_divide, np.divide), (ieee_remainder, np.fmod)])
def test_division(pairs, f, g):
    for r in pairs.select("a", "b", f(pairs.a, pairs.b).alias("v")).collect():
        with np.errstate(all="ignore"):
            want = None if r.a is None or r.b is None else float(g(np.float64(r.a), np.float64(r.b)))
        assert equal(r.v, want), r


def test_logarithm(pairs):
    for r in pairs.select("a", ieee_ln(pairs.a).alias("v")).distinct().collect():
        with np.errstate(all="ignore"):
            assert equal(r.v, None if r.a is None else float(np.log(r.a))), r


@pytest.mark.parametrize("e", [A + B * 2, -A.abs() - 1, (A / B).exp(), A.abs().ln(), A.tanh() * B.signum(), A**2, 1 / (1 + (-A).exp()), (A - B) ** 2], ids=repr)
def test_spark_and_arrays_agree(pairs, e):
    assert e.columns() <= {(0, "a"), (0, "b")}
    for r in pairs.select("a", "b", e.to_column(lambda i, n: pairs[n]).alias("v")).collect():
        used = {n for _, n in e.columns()}
        want = None if any(r[n] is None for n in used) else float(e.evaluate(lambda i, n: np.float64(r[n])))
        assert (r.v is None) == (want is None) and (want is None or (math.isnan(want) and math.isnan(r.v)) or r.v == want or abs(r.v - want) <= 1e-12 * abs(want)), r
