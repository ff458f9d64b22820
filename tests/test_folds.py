"""Folds: construction, joins against nested loops, tiles and contractions against the plain plan."""

import importlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from joinloom.functions import col
from joinloom.ir import Condition, Dimension, Domain, Fold, Operand, Pipeline, Weight, describe
from joinloom.operators.dense import dense_fold, roles, tiles, unpacked, worth
from joinloom.operators.folds import metrics as folds_metrics
from joinloom.operators.folds import run_fold
from joinloom.operators.ranged import range_width, ranged_fold
from joinloom.plans.contract import contract, einsum, join_back, measures, order_of
from joinloom.plans.lower import lower

L, R = Operand({"i": "i", "j": "j"}, "v"), Operand({"j": "j", "k": "k"}, "v")


def dims(names, null_safe=""):
    return tuple(Dimension(n, n in null_safe) for n in names)


def rows_of(spark, rows, keys):
    t = pa.table({**{k: pa.array([r[n] for r in rows], pa.int64()) for n, k in enumerate(keys)}, "v": pa.array([r[-1] for r in rows], pa.float64())})
    return spark.createDataFrame(t)


def brute(fold, tables):
    """Groups and sums by nested loops; tables: rows of (keys in the operand's order, factor)."""
    groups = {}
    for picked in itertools.product(*tables):
        at, ok = {}, True
        for o, r in zip(fold.operands, picked, strict=True):
            for d, k in zip(o.keys, r, strict=False):
                if d in at and not (at[d] == k and (k is not None or fold.null_safe(d))):
                    ok = False
                at.setdefault(d, k)
        # A NULL key equals nothing unless null-safe.
        shared = [d for d in at if sum(d in o.keys for o in fold.operands) > 1]
        ok = ok and all(at[d] is not None or fold.null_safe(d) for d in shared)
        for c in fold.conditions:
            a, b = at[c.left], at[c.right]
            ok = ok and a is not None and b is not None and {"<": a < b + c.offset, "<=": a <= b + c.offset, ">": a > b + c.offset, ">=": a >= b + c.offset}[c.op]
        if ok:
            v = math.prod(r[-1] for r in picked) if all(r[-1] is not None for r in picked) else None
            groups.setdefault(tuple(at[d] for d in fold.outputs), []).append(v)
    return {g: None if all(v is None for v in vs) else sum(v for v in vs if v is not None) for g, vs in groups.items()}


def got(df, outputs, value="v"):
    return {tuple(r[d] for d in outputs): r[value] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        x, y = a[k], b[k]
        assert (x is None) == (y is None), k
        if x is not None:
            assert (math.isnan(x) and math.isnan(y)) or x == y or abs(x - y) <= 1e-12 * max(1, abs(y)), (k, x, y)


@pytest.mark.parametrize(
    "bad",
    [
        lambda: Fold((L, R), dims("ij"), ("i",)),
        lambda: Fold((L, R), dims("ijk"), ("i", "i")),
        lambda: Fold((L, R), dims("ijkz"), ("i",)),
        lambda: Fold((L, R), dims("ijj"), ("i",)),
        lambda: Fold((Operand({"i": "i", "j": "i"}, "v"),), dims("ij"), ("i",)),
        lambda: Fold((Operand({"i": "i"}), Operand({"i": "i"})), dims("i"), ("i",)),
        lambda: Fold((L, R), dims("ijk"), ("i",), col(2, "v")),
        lambda: Fold((L, R), dims("ijk"), ("i",), aggregate="median"),
        lambda: Fold((L, R), dims("ijk"), ("i",), domain=Domain({}, ())),
        lambda: Fold((L, R), dims("ijk"), ("i", "k"), conditions=(Condition("i", ">=", "i"),)),
        lambda: Fold((L, R), dims("ijk"), ("i", "k"), conditions=(Condition("i", "<>", "k"),)),
        lambda: Fold((), (), ()),
        lambda: Pipeline(Fold((L, R), dims("ijk"), ("i", "k")), Weight(), Operand({"k": "k"}), ("k",)),
        lambda: Pipeline(Fold((L, R), dims("ijk"), ("i", "k")), Weight(), Operand({"k": "k"}, "v"), ("j",)),
        lambda: Pipeline(Fold((L, R), dims("ijk"), ("i", "k")), Weight(of=col(1, "x")), Operand({"k": "k"}, "v"), ("k",)),
    ],
)
def test_invalid_folds(bad):
    with pytest.raises(ValueError):
        bad()


def test_description():
    f = Fold((L, R), dims("ijk"), ("i", "k"), conditions=(Condition("i", ">=", "k", 3),))
    assert describe(f) == "i,j * j,k -> i,k where i >= k +3"
    assert describe(Pipeline(f, Weight(), Operand({"k": "k", "c": "c"}, "v"), ("k",))) == "softmax[i,j * j,k -> i,k where i >= k +3] * k,c -> i,c / groups"


KEY = st.one_of(st.none(), st.integers(0, 4))
VALUE = st.one_of(st.none(), st.sampled_from([0.5, -1.5, 2.0, 0.0, -0.0, math.inf, -math.inf, math.nan, 3.0]))
TABLE = st.lists(st.tuples(KEY, KEY, VALUE), max_size=14)
FEW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@FEW
@given(TABLE, TABLE, st.sampled_from(["", "j"]), st.sampled_from([(), (Condition("i", ">=", "k"),), (Condition("i", "<", "k", 2), Condition("i", ">=", "k", -1))]))
def test_joins_equal_nested_loops(spark, a, b, null_safe, conditions):
    fold = Fold((L, R), dims("ijk", null_safe), ("i", "k"), conditions=conditions)
    same(got(lower(fold, [rows_of(spark, a, "ij"), rows_of(spark, b, "jk")]), "ik"), brute(fold, [a, b]))


DENSE = st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), VALUE), min_size=1, max_size=60)


@FEW
@given(DENSE, DENSE, st.sampled_from([(), (Condition("k", "<=", "i", 1),), (Condition("i", ">", "k", -3),)]))
def test_tiles_equal_nested_loops(spark, a, b, conditions):
    """Duplicates, NULL and non-finite factors, absent cells, several blocks."""
    fold = Fold((L, R), dims("ijk"), ("i", "k"), conditions=conditions)
    same(got(dense_fold(fold, [rows_of(spark, a, "ij"), rows_of(spark, b, "jk")], block=4), "ik"), brute(fold, [a, b]))


@pytest.mark.parametrize("strips", [1, 2, 16])
def test_one_block_of_the_summed_dimension_spreads_over_strips(spark, monkeypatch, strips):
    monkeypatch.setattr("joinloom.operators.dense.STRIP", strips)
    rows = [(i, j, float(i * 7 % 5 - j)) for i in range(23) for j in range(3) if (i + j) % 4]
    a, b = rows_of(spark, rows, "ij"), rows_of(spark, [(j, i, v) for i, j, v in rows], "jk")
    fold = Fold((L, R), dims("ijk"), ("i", "k"), conditions=(Condition("i", ">=", "k", -9),))
    out = dense_fold(fold, [a, b], block=4)
    same(got(out, "ik"), got(lower(fold, [a, b]), "ik"))


def test_loose_keys_take_tiles_where_the_join_is_far_larger(spark, monkeypatch):
    monkeypatch.setattr("joinloom.operators.dense.JOINED", 1 << 12)
    df = spark.range(4000).select((F.col("id") * 37 % 200).alias("i"), (F.col("id") * 11 % 300).alias("j"), F.lit(1.0).alias("v"))
    few = df.where("i = j")
    fold = Fold((L, Operand({"j": "j", "k": "i"}, "v")), dims("ijk"), ("i", "k"))
    assert worth(fold, [df, df], least_products=1 << 10) and not worth(fold, [few, few], least_products=1 << 10)
    same(got(dense_fold(fold, [df, df], block=64), "ik"), got(lower(fold, [df, df]), "ik"))


def test_tiles_by_batch_dimension_and_own_arithmetic(spark):
    rng = np.random.default_rng(1)
    rows = [(h, i, j, float(rng.integers(-4, 5))) for h in range(2) for i in range(6) for j in range(5)]
    df = rows_of(spark, rows, "hij")
    fold = Fold((Operand({"h": "h", "a": "i", "z": "j"}, "v"), Operand({"h": "h", "b": "i", "z": "j"}, "v")), dims(["h", "a", "b", "z"]), ("b", "h", "a"))
    calls = spark.sparkContext.accumulator(0)

    def product(x, y):
        calls.add(1)
        return x @ y

    out = got(dense_fold(fold, [df, df], block=4, matmul=product), "bha")
    same(out, got(lower(fold, [df, df]), "bha"))
    assert calls.value > 0


def test_tiles_hold_the_rows_of_their_batch_alone(spark):
    """Keys of which each batch has every fifth: tiles five times as wide, without the rows of other batches, and no larger than full ones."""
    rows = [(i % 5, i, j, float(i * 3 % 7 - j)) for i in range(60) for j in range(3) if (i, j) != (7, 1)]
    df = rows_of(spark, rows, "hij")
    sent = {r.w: [] for r in df.selectExpr("h AS w").distinct().collect()}
    for r in tiles(df, "h", "i", "j", "v", 4, 20).collect():
        ids, v, state = unpacked(r.ids, r.m, r.value, r.state)
        assert v.shape == state.shape == (len(ids), 3) and len(r.value) == 4 * v.size and len(r.state) == (0 if (state == 3).all() else v.size)
        sent[r.w].append(ids.tolist())
    assert {w: sorted(sum(x, [])) for w, x in sent.items()} == {w: list(range(w, 60, 5)) for w in range(5)} and all(len(x) == 3 for x in sent.values())
    fold = Fold((Operand({"h": "h", "a": "i", "z": "j"}, "v"), Operand({"h": "h", "b": "i", "z": "j"}, "v")), dims(["h", "a", "b", "z"]), ("h", "a", "b"), conditions=(Condition("a", ">=", "b", 7),))
    for block in (2, 4):  # several blocks of the summed dimension, and one
        same(got(dense_fold(fold, [df, df], block=block), "hab"), got(lower(fold, [df, df]), "hab"))


def test_strips_widen_with_the_input(spark, monkeypatch):
    """Tiles are copied to about as many strips as tasks need, however many blocks there are."""
    df = spark.range(600).select((F.col("id") % 200).alias("i"), F.expr("id div 200").alias("j"), (F.col("id") % 11).cast("double").alias("v"))
    fold = Fold((L, Operand({"j": "j", "k": "i"}, "v")), dims("ijk"), ("i", "k"))
    monkeypatch.setattr("joinloom.operators.dense.STRIP", 1)
    monkeypatch.setattr("joinloom.operators.dense.STRIP_BYTES", 10**6)
    one, last = F.sequence, []
    monkeypatch.setattr(F, "sequence", lambda low, high: last.append(int(re.search(r"\d+", str(high))[0])) or one(low, high))
    same(got(dense_fold(fold, [df, df], block=4), "ik"), got(lower(fold, [df, df]), "ik"))
    assert last == [3, 3]  # of 50 blocks


@FEW
@given(TABLE, TABLE)
def test_ranges_equal_nested_loops(spark, a, b):
    """Duplicates, NULL and non-finite factors, NULL keys of the summed dimension, absent cells, several ranges."""
    a, b = [t for t in a if t[0] is not None], [t for t in b if t[1] is not None]
    fold = Fold((L, R), dims("ijk"), ("i", "k"))
    same(got(ranged_fold(fold, [rows_of(spark, a, "ij"), rows_of(spark, b, "jk")], 2), "ik"), brute(fold, [a, b]))


def test_sparse_keys_that_meet_often_are_multiplied_by_range(spark, monkeypatch):
    """Blocks of 20 i and 100 j each, far from dense as a whole, of which 40,000 joined rows fall on 4,000 groups."""
    module = importlib.import_module("joinloom.operators.ranged")
    monkeypatch.setattr(module, "JOINED", 1 << 12)
    monkeypatch.setattr(module, "ROWS", 500)
    block = F.expr("id div 500")
    df = spark.range(5000).select((F.hash("id") % 10 + 10 + 20 * block * 50).alias("i").cast("bigint"), (F.col("id") % 50 + 100 * block).alias("j"), F.lit(1.5).alias("v"))
    fold = Fold((L, Operand({"j": "j", "k": "i"}, "v")), dims("ijk"), ("k", "i"))
    before = dict(folds_metrics)
    out = run_fold(fold, [df, df])
    assert folds_metrics["ranged_folds"] == before["ranged_folds"] + 1 and folds_metrics["host_plans"] == before["host_plans"]
    same(got(out, "ki"), got(lower(fold, [df, df]), "ki"))
    # As many groups as joined rows, a range too large, too many groups in one, and NULL keys run as before.
    apart = df.withColumn("i", F.monotonically_increasing_id())
    assert range_width(fold, [apart, apart]) is None and range_width(fold, [df.withColumn("i", F.nullif("i", F.col("i"))), df]) is None
    for name in ("MOST_ROWS", "MOST_CELLS"):
        with monkeypatch.context() as m:
            m.setattr(module, name, 10)
            assert range_width(fold, [df, df]) is None


def test_when_tiles_are_worth_it(spark):
    full = rows_of(spark, [(i, j, 1.0) for i in range(64) for j in range(64)], "ij")
    right = full.toDF("j", "k", "v")
    fold = Fold((L, R), dims("ijk"), ("i", "k"))
    assert worth(fold, [full, right], least_products=1 << 10) and not worth(fold, [full, right])
    for damaged in (full.withColumn("j", F.col("j") - 1), full.withColumn("i", F.nullif("i", F.lit(3))), full.withColumn("i", F.col("i") * 10**6), full.withColumn("j", F.col("j").cast("string")), full.limit(0)):
        assert not worth(fold, [damaged, right], least_products=1 << 10)
    assert roles(Fold((L, R), dims("ijk"), ("i",))) is None and roles(Fold((L, R), dims("ijk", "j"), ("i", "k"))) is None


@FEW
@given(DENSE, DENSE, DENSE, st.permutations([0, 1, 2]))
def test_contraction_equals_nested_loops(spark, a, b, c, order):
    a, b, c = ([(i, j, v if v is None or math.isfinite(v) else 1.0) for i, j, v in t[:8]] for t in (a, b, c))
    ops = [L, R, Operand({"k": "k", "l": "l"}, "v")]
    tables, names = [a, b, c], ["ij", "jk", "kl"]
    fold = Fold(tuple(ops[o] for o in order), dims("ijkl"), ("i", "l"))
    frames = [rows_of(spark, tables[o], names[o]) for o in order]
    same(got(contract(fold, frames), "il"), brute(fold, [tables[o] for o in order]))


def test_contraction_order():
    dims3 = [frozenset("ij"), frozenset("jk"), frozenset("kl")]
    assert order_of(dims3, frozenset("il"), {"i": 100, "j": 2, "k": 100, "l": 2})[0] == (1, 2)
    assert order_of(dims3, frozenset("il"), {"i": 2, "j": 100, "k": 2, "l": 100})[0] == (0, 1)
    long = [frozenset((f"d{n}", f"d{n + 1}")) for n in range(12)]
    path = order_of(long, frozenset(("d0", "d12")), {f"d{n}": 2.0 + n % 3 for n in range(13)})
    assert len(path) == 11 and sorted({x for p in path for x in p}) == list(range(22))


@pytest.mark.parametrize("bad", [math.inf, math.nan, 1e250])
def test_guard_keeps_the_plain_plan(spark, bad):
    fold = Fold((L, R, Operand({"k": "k"}, "v")), dims("ijk"), ("i",))
    good = [rows_of(spark, [(1, 1, 2.0)], "ij"), rows_of(spark, [(1, 1, 2.0)], "jk"), rows_of(spark, [(1, 2.0)], "k")]
    assert measures(fold, good)[1]
    frames = [rows_of(spark, [(1, 1, bad)], "ij"), good[1].withColumn("v", F.lit(bad)), good[2]]
    assert not measures(fold, frames)[1]
    v = contract(fold, frames).first()["v"]
    assert math.isnan(v) if math.isnan(bad) else v == bad * bad * 2.0


def test_operands_that_repeat_keys_are_summed_before_joins(spark, monkeypatch):
    """Two operands of 400 rows under 2 keys, NULLs among both: one row for each key is joined, not 200 times 200."""
    module = importlib.import_module("joinloom.plans.contract")
    one, seen = module.lower, []
    monkeypatch.setattr(module, "lower", lambda fold, frames, *a: seen.append([df.count() for df in frames]) or one(fold, frames, *a))
    a = [(n % 2, None if n % 2 or n % 3 == 0 else float(n)) for n in range(400)]
    b = [(n % 2, float(n % 7)) for n in range(400)]
    c = [(0, 5, 2.0), (1, 5, 3.0), (1, 6, 4.0), (2, 7, 1.0)]
    frames = [rows_of(spark, a, "n"), rows_of(spark, b, "n"), rows_of(spark, c, "nr")]
    out = got(einsum("n,n,nr->r", (frames[0], ["n"], "v"), (frames[1], ["n"], "v"), (frames[2], ["n", "r"], "v")), "r")
    total = lambda t: sum(v for n, v in t if n == 0 and v is not None)
    assert out == {(5,): total(a) * total(b) * 2.0, (6,): None}
    assert max(map(max, seen)) <= 4


def test_einsum(spark):
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(-3, 4, (4, 5)), rng.integers(-3, 4, (5, 6)), rng.integers(-3, 4, (6, 3))
    frame = lambda m: rows_of(spark, [(*i, float(v)) for i, v in np.ndenumerate(m)], "xy")
    out = got(einsum("ij,jk,kl->li", (frame(a), "xy", "v"), (frame(b), "xy", "v"), (frame(c), "xy", "v")), "li")
    assert out == {k: float(v) for k, v in np.ndenumerate(np.einsum("ij,jk,kl->li", a, b, c))}
    with pytest.raises(ValueError):
        einsum("ii->i", (frame(a), "xy", "v"))


@pytest.mark.parametrize("missing", [None, 0.0, -0.0, -1.0])
def test_domain(spark, missing):
    a, b = rows_of(spark, [(0, 0, 2.0), (1, 0, None), (None, 0, 5.0)], "ij"), rows_of(spark, [(0, 3.0)], "j")
    domain = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z"), (7, None), (None, "n")], "i bigint, c string")
    fold = Fold((L, Operand({"j": "j"}, "v")), dims("ij"), ("i",), domain=Domain({"i": "i"}, ("i", "c"), missing))
    out = {(r.i, r.c): r.v for r in run_fold(fold, [a, b], domain=domain).collect()}
    assert out == {(0, "x"): 6.0, (0, "y"): 6.0, (1, "z"): missing, (7, None): missing, (None, "n"): missing}
    if missing is not None:
        assert math.copysign(1, out[7, None]) == math.copysign(1, missing)


@pytest.mark.parametrize("keys", [[0, 1, 2, None], [0, 0, 1, 1, 1, 2]])
def test_join_back(spark, keys):
    a, b = rows_of(spark, [(0, 0, 2.0), (1, 0, 3.0), (1, 0, None)], "ij"), rows_of(spark, [(0, 3.0)], "j")
    domain = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "i bigint, n bigint")
    fold = Fold((L, Operand({"j": "j"}, "v")), dims("ij"), ("i",), domain=Domain({"i": "i"}, ("i", "n"), 0.0))
    folded = {0: 6.0, 1: 9.0}
    want = {n: folded.get(k, 0.0) * (keys.count(k) if k in folded else 1) for n, k in enumerate(keys)}
    assert {r.n: r.v for r in join_back(fold, [a, b], domain).collect()} == want


@pytest.mark.parametrize("aggregate,want", [("count", 2), ("avg", 3.0), ("min", 2.0), ("max", 4.0)])
def test_other_monoids(spark, aggregate, want):
    a, b = rows_of(spark, [(0, 0, 1.0), (0, 1, 2.0), (0, 1, None)], "ij"), rows_of(spark, [(0, 2.0), (1, 2.0)], "j")
    fold = Fold((L, Operand({"j": "j"}, "v")), dims("ij"), ("i",), aggregate=aggregate)
    assert lower(fold, [a, b]).first()["v"] == want


def test_mask_operand(spark):
    a = rows_of(spark, [(0, 0, 1.0), (1, 1, 2.0), (2, 1, 4.0)], "ij")
    only = spark.createDataFrame([(1,), (1,), (2,)], "i bigint")
    fold = Fold((L, Operand({"i": "i"})), dims("ij"), ("j",))
    assert got(lower(fold, [a, only]), "j") == {(1,): 8.0}
