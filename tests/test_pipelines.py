"""Pipelines tile by tile against the plain plan, complete and damaged; and in SQL."""

import importlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from joinloom.functions import col
from joinloom.ir import Condition, Dimension, Fold, Operand, Pipeline, Scale, Weight
from joinloom.operators.attention import attention
from joinloom.operators.folds import metrics, run_pipeline
from joinloom.plans.lower import lower_pipeline
from joinloom.session import install

S = col(0, "s")
WEIGHTS = {
    "softmax": Weight(scale=Scale(2.0, True)), "times": Weight(scale=Scale(0.5)), "unshifted": Weight(shifted=False), "sigmoid": Weight(of=1 / (1 + (-S).exp())), "square": Weight(of=S**2),
}


def frame(spark, n=23, d=3, seed=0, heads=1):
    rng = np.random.default_rng(seed)
    h, t, k = (x.ravel() for x in np.indices((heads, n, d)))
    return spark.createDataFrame(pa.table({"h": h, "t": t, "d": k, "x": rng.normal(size=len(t))}))


def pipeline(weight, normalizer="groups", conditions=(), heads=False, value=None):
    h = {"h": "h"} if heads else {}
    side = lambda n: Operand({**h, n: "t", "d": "d"}, None if value else "x")
    names = [*h, "a", "b", "d"]
    producer = Fold((side("a"), side("b")), tuple(map(Dimension, names)), tuple(names[:-1]), value, conditions=conditions)
    return Pipeline(producer, weight, Operand({**h, "b": "t", "c": "d"}, "x"), ("b",), normalizer)


def check(got, want):
    key = lambda r: tuple(r)[:-1]
    a, b = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert [x[:-1] for x in a] == [x[:-1] for x in b] and got.columns == want.columns
    for x, y in zip(a, b, strict=True):
        assert x[-1] == y[-1] or (x[-1] != x[-1] and y[-1] != y[-1]) or abs(x[-1] - y[-1]) <= 1e-11 * max(1, abs(y[-1])), (key(x), x[-1], y[-1])


CAUSAL, BAND = (Condition("a", ">=", "b"),), (Condition("b", "<=", "a", 4), Condition("b", ">", "a", -6))


@pytest.mark.parametrize("normalizer", ["groups", "rows", None])
@pytest.mark.parametrize("weight", WEIGHTS)
def test_tiles_equal_the_plain_plan(spark, weight, normalizer):
    q, k, v = (frame(spark, seed=s) for s in range(3))
    p = pipeline(WEIGHTS[weight], normalizer, CAUSAL if normalizer == "rows" else ())
    check(attention(p, [q, k], v, block=8), lower_pipeline(p, [q, k], v))


@pytest.mark.parametrize("apart", [10**7, 2**53 + 1])
def test_keys_far_apart_take_the_plain_plan(spark, apart):
    q, v = frame(spark, seed=1, n=4), frame(spark, seed=2, n=4)
    far = lambda df: df.withColumn("t", F.col("t") * apart)
    p = pipeline(WEIGHTS["softmax"])
    assert attention(p, [far(q), q], v) is None and attention(p, [q, far(q)], far(v)) is None
    check(run_pipeline(p, [far(q), far(q)], far(v)), lower_pipeline(p, [far(q), far(q)], far(v)))


def test_masks_heads_expressions_and_fan_in(spark, monkeypatch):
    monkeypatch.setattr(importlib.import_module("joinloom.operators.attention"), "FAN_IN", 2)
    q, k, v = (frame(spark, seed=s, heads=2) for s in range(3))
    p = pipeline(WEIGHTS["softmax"], "groups", BAND, heads=True)
    check(attention(p, [q, k], v, block=4), lower_pipeline(p, [q, k], v))
    q, k, v = (frame(spark, seed=s) for s in range(3))
    p = pipeline(Weight(scale=Scale(-1.0), shifted=False), "groups", BAND, value=(col(0, "x") - col(1, "x")) ** 2)
    check(attention(p, [q, k], v, block=4), lower_pipeline(p, [q, k], v))


def test_a_row_that_a_mask_leaves_nothing_is_absent(spark):
    e = frame(spark, n=6)
    p = pipeline(WEIGHTS["softmax"], "groups", (Condition("a", ">", "b", 1),))
    out = attention(p, [e, e], e, block=4)
    check(out, lower_pipeline(p, [e, e], e))
    assert {r.a for r in out.collect()} == {2, 3, 4, 5}


DAMAGE = {
    "missing": lambda e: e.where("NOT (t = 3 AND d = 1)"),
    "repeated": lambda e: e.union(e.where("t = 3 AND d = 1")),
    "null value": lambda e: e.withColumn("x", F.expr("if(t = 3 AND d = 1, null, x)")),
    "nan": lambda e: e.withColumn("x", F.expr("if(t = 3 AND d = 1, double('nan'), x)")),
    "infinite": lambda e: e.withColumn("x", F.expr("if(t = 3 AND d = 1, double('inf'), x)")),
    "huge": lambda e: e.withColumn("x", F.expr("if(t = 3 AND d = 1, 1e200, x)")),
    "null key": lambda e: e.withColumn("t", F.expr("if(t = 3, null, t)")),
    "negative key": lambda e: e.withColumn("t", F.expr("t - 1")),
    "empty": lambda e: e.limit(0),
    "missing row": lambda e: e.where("t <> 3"),
}


@pytest.mark.parametrize("damage", DAMAGE)
@pytest.mark.parametrize("which", [1, 2])
def test_damaged_inputs_run_as_the_plain_plan(spark, damage, which):
    tables = [frame(spark, n=6, seed=s) for s in range(3)]
    tables[which] = DAMAGE[damage](tables[which])
    p = pipeline(WEIGHTS["softmax"])
    before = metrics["host_plans"]
    check(run_pipeline(p, tables[:2], tables[2]), lower_pipeline(p, tables[:2], tables[2]))
    assert metrics["host_plans"] == before + 1


SCORES = "s AS (SELECT q.t AS a, k.t AS b, sum(q.x * k.x) / 2.0D AS s FROM q JOIN k ON q.d = k.d GROUP BY q.t, k.t)"
WINDOW = "w AS (SELECT a, b, exp(s - max(s) OVER (PARTITION BY a)) AS w FROM s)"
NORM = "n AS (SELECT a, sum(w) AS z FROM w GROUP BY a)"
OUT = "SELECT w.a, v.d AS c, sum(w.w * v.x) / n.z AS o FROM w JOIN v ON w.b = v.t JOIN n ON w.a = n.a GROUP BY w.a, v.d, n.z"
FUSED = {
    "window": f"WITH {SCORES}, {WINDOW}, {NORM} {OUT}",
    "inside": f"WITH {SCORES}, {WINDOW}, {NORM} SELECT w.a, v.d AS c, sum(w.w / n.z * v.x) AS o FROM w JOIN v ON w.b = v.t JOIN n ON w.a = n.a GROUP BY w.a, v.d",
    "after": f"WITH {SCORES}, {WINDOW}, {NORM} SELECT v.d AS c, w.a, sum(v.x * w.w / n.z) AS o FROM w JOIN v ON w.b = v.t JOIN n ON w.a = n.a GROUP BY w.a, v.d",
    "rows": f"WITH {SCORES}, {WINDOW} SELECT w.a, v.d AS c, sum(w.w * v.x) / sum(w.w) AS o FROM w JOIN v ON w.b = v.t GROUP BY w.a, v.d",
    "causal": f"WITH {SCORES.replace('q.d = k.d', 'q.d = k.d AND q.t >= k.t')}, {WINDOW}, {NORM} {OUT} ORDER BY o LIMIT 7",
    **{n: f"WITH {SCORES}, w AS (SELECT a, b, {w} AS w FROM s), {NORM} {OUT}" for n, w in (("unshifted", "exp(s)"), ("sigmoid", "1 / (1 + exp(-s))"), ("cauchy", "1 / (1 + power(s, 2))"))},
    "chain": f"WITH {SCORES.replace(' / 2.0D', '')} SELECT s.a, v.d AS c, sum(s.s * v.x) AS o FROM s JOIN v ON s.b = v.t GROUP BY s.a, v.d",
}
#: Look-alikes that aren't the pipeline they resemble.
HOST = {
    "maximum over the summed key": FUSED["window"].replace("PARTITION BY a", "PARTITION BY b"),
    "ordered maximum": FUSED["window"].replace("PARTITION BY a", "PARTITION BY a ORDER BY b"),
    "normalizer of other weights": FUSED["window"].replace("sum(w) AS z FROM w", "sum(w * 2) AS z FROM w"),
    "normalizer of other scores": f"WITH {SCORES}, {WINDOW}, s2 AS (SELECT q.t AS a, k.t AS b, sum(q.x * k.x) / 4.0D AS s FROM q JOIN k ON q.d = k.d GROUP BY q.t, k.t), n AS (SELECT a, sum(w) AS z FROM (SELECT a, exp(s - max(s) OVER (PARTITION BY a)) AS w FROM s2) GROUP BY a) {OUT}",
    "average": FUSED["rows"].replace("sum(w.w * v.x)", "avg(w.w * v.x)"),
    "minimum": FUSED["window"].replace("max(s)", "min(s)"),
    "distinct": FUSED["rows"].replace("sum(w.w * v.x)", "sum(DISTINCT w.w * v.x)"),
    "outer join": FUSED["rows"].replace("w JOIN v", "w LEFT JOIN v"),
}


@pytest.fixture(scope="module")
def views(spark):
    for s, name in enumerate("qkv"):
        frame(spark, n=7, seed=s).createOrReplaceTempView(name)


def agree(a, b):
    assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]
    x, y = sorted(map(tuple, a.collect()), key=repr), sorted(map(tuple, b.collect()), key=repr)
    assert len(x) == len(y)
    number = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(map(number, x), key=repr) == sorted(map(number, y), key=repr)


@pytest.mark.parametrize("name", FUSED)
def test_sql_is_fused(spark, views, name):
    s = install(spark)
    agree(s.sql(FUSED[name]), spark.sql(FUSED[name]))
    assert s.metrics.fused_pipelines == 1 and s.metrics.plans_rewritten == 1


@pytest.mark.parametrize("name", HOST)
def test_look_alikes_are_left_alone(spark, views, name):
    s = install(spark)
    agree(s.sql(HOST[name]), spark.sql(HOST[name]))
    assert s.metrics.fused_pipelines == 0


def test_sql_chains_and_folds(spark, views):
    s = install(spark)
    chain = "SELECT a.t, c.t AS u, sum(a.x * (b.x * c.x)) AS o FROM q a JOIN k b ON a.d = b.d JOIN v c ON b.t = c.d GROUP BY a.t, c.t"
    agree(s.sql(chain), spark.sql(chain))
    assert s.metrics.contractions == 1 and s.explain(chain).count("*") == 2
    frame(spark, n=120, d=80).createOrReplaceTempView("big")
    gram = "SELECT l.t, r.t AS u, sum(l.x * r.x) AS o FROM big l JOIN big r ON l.d = r.d AND abs(l.t - r.t) < 9 GROUP BY l.t, r.t HAVING o > 0"
    agree(s.sql(gram), spark.sql(gram))
    assert s.metrics.dense_folds == 1


@pytest.mark.parametrize(
    "query",
    [
        "SELECT sum(q.x * k.x) AS o FROM q JOIN k ON q.d = k.d",
        "SELECT q.t, avg(q.x * k.x) AS o FROM q JOIN k ON q.d = k.d GROUP BY q.t",
        "SELECT q.t, sum(q.x * k.x) AS o, count(*) AS n FROM q JOIN k ON q.d = k.d GROUP BY q.t",
        "SELECT q.t + 1 AS t, sum(q.x * k.x) AS o FROM q JOIN k ON q.d = k.d GROUP BY q.t + 1",
        "SELECT q.t, k.t AS u, sum(q.x * k.x) AS o FROM q LEFT JOIN k ON q.d = k.d GROUP BY q.t, k.t",
        "SELECT q.t, k.t AS u, sum(q.x * k.x) AS o FROM q JOIN k ON q.d = k.d AND q.t <> k.t GROUP BY q.t, k.t",
        "SELECT t, x FROM q ORDER BY x LIMIT 3",
    ],
)
def test_declined_shapes(spark, views, query):
    s = install(spark)
    agree(s.sql(query), spark.sql(query))
    assert s.metrics.plans_rewritten == 0


def test_gaussian_smoother(spark):
    rng = np.random.default_rng(2)
    p = spark.createDataFrame(pa.table({"t": np.arange(30), "x": rng.random(30), "v": rng.random(30)})).withColumn("c", F.lit(0))
    producer = Fold((Operand({"a": "t"}), Operand({"b": "t"})), (Dimension("a"), Dimension("b")), ("a", "b"), (-((col(0, "x") - col(1, "x")) ** 2) / 0.1).exp())
    smoother = Pipeline(producer, Weight(of=S), Operand({"b": "t", "c": "c"}, "v"), ("b",), "rows")
    check(attention(smoother, [p, p], p, block=8), lower_pipeline(smoother, [p, p], p))
    assert math.isfinite(attention(smoother, [p, p], p).first()["v"])


@pytest.mark.parametrize("conditions, copies", [((), 6 * 3), (CAUSAL, 2 + 4 + 6), (BAND, 3 + 4 + 3)])
def test_tiles_are_copied_once_a_strip(spark, monkeypatch, conditions, copies):
    """Not once for each pair: 24 tiles of queries in 3 strips meet 6 tiles of keys."""
    kind, sent = type(spark.range(0)), []
    deal = kind.repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda self, *a: sent.append(self) or deal(self, *a))
    q, k, v = (frame(spark, n=48, seed=s) for s in range(3))
    p = pipeline(WEIGHTS["softmax"], "groups", conditions)
    check(attention(p, [q, k], v, block=8, strips=3), lower_pipeline(p, [q, k], v))
    assert sent[0].count() == 24 + copies and sent[0].where("side = 0").count() == 24


def test_strips_hold_no_more_than_their_bytes(spark, monkeypatch):
    module = importlib.import_module("joinloom.operators.attention")
    monkeypatch.setattr(module, "STRIP_BYTES", 8 * (3 + 2 * 3 + 4) * 6)
    kind, dealt = type(spark.range(0)), []
    deal = kind.repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda self, n, by: dealt.append(n) or deal(self, n, by))
    q, k, v = (frame(spark, seed=s, heads=2) for s in range(3))
    p = pipeline(WEIGHTS["softmax"], "groups", heads=True)
    check(attention(p, [q, k], v, block=8, strips=1), lower_pipeline(p, [q, k], v))
    assert dealt == [4]


def test_values_that_floats_do_not_hold_keep_all_bits(spark):
    q, k, v = (frame(spark, seed=s) for s in range(3))
    short = lambda df: df.withColumn("x", F.col("x").cast("float").cast("double"))
    p = pipeline(WEIGHTS["square"])
    for a, b, c in ((q, short(k), v), (short(q), short(k), short(v)), (short(q), k, short(v))):
        check(attention(p, [a, b], c, block=8, strips=2), lower_pipeline(p, [a, b], c))


def test_plans_of_fused_pipelines_broadcast_no_pairs(spark):
    """Tiles of one feature are so small that Spark broadcast them with a copy for each pair of blocks."""
    p = spark.range(300).select(F.col("id").alias("t"), (F.col("id") / 300).alias("x"), F.rand(1).alias("v"), F.lit(0).alias("c"))
    producer = Fold((Operand({"a": "t"}), Operand({"b": "t"})), (Dimension("a"), Dimension("b")), ("a", "b"), (-((col(0, "x") - col(1, "x")) ** 2) / 0.1).exp())
    smoother = Pipeline(producer, Weight(of=S), Operand({"b": "t", "c": "c"}, "v"), ("b",), "rows")
    out = attention(smoother, [p, p], p, block=8)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Join" in line for line in plan[: next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line)])
    explode = [i for i, line in enumerate(plan) if "Generate explode" in line]
    assert len(explode) == 1 and any("Join" in line for line in plan[explode[0] :])
    assert out.count() == 300


@pytest.mark.parametrize("far, product", [(0, True), (1e6, False)])
def test_squared_differences_are_a_product_where_it_keeps_their_digits(far, product):
    module = importlib.import_module("joinloom.operators.attention")
    rng = np.random.default_rng(3)
    q, k = (rng.normal(size=(1, n, 5)) + far for n in (7, 9))
    k[0, 0] = q[0, 0]
    want = ((q[0][:, None, :] - k[0][None, :, :]) ** 2).sum(axis=2)
    for value in ((col(0, "x") - col(1, "x")) ** 2, (col(1, "x") - col(0, "x")) ** 2):
        p = pipeline(Weight(scale=Scale(-1.0), shifted=False), value=value)
        asked = []
        one = type(value).evaluate
        with pytest.MonkeyPatch.context() as m:
            m.setattr(type(value), "evaluate", lambda self, of: asked.append(1) or one(self, of))
            got = module._scores(p.producer, q, k, [["x"], ["x"]], module._most(p.weight))
        assert np.abs(got - want).max() < 1e-12 and (got >= 0).all() and bool(asked) != product
    # A weight that isn't an exponential may be steep at 0.
    assert module._most(Weight(of=S)) == 0 and module._most(Weight(scale=Scale(0.0, True))) == 0


@pytest.mark.parametrize("conditions, heads", [((), False), (BAND, True)])
def test_one_relation_on_all_sides_is_packed_and_sent_once(spark, monkeypatch, conditions, heads):
    """Queries, keys and values of one table were three sets of tiles, and keys travelled with a copy of themselves as values."""
    kind, sent, packed = type(spark.range(0)), [], []
    deal = kind.repartitionById
    module = importlib.import_module("joinloom.operators.attention")
    pack = module._packed
    monkeypatch.setattr(kind, "repartitionById", lambda self, *a: sent.append(self) or deal(self, *a))
    monkeypatch.setattr(module, "_packed", lambda *a: packed.append(a) or pack(*a))
    e = frame(spark, heads=2 if heads else 1)
    p = pipeline(WEIGHTS["softmax"], "groups", conditions, heads=heads)
    check(attention(p, [e, e], e, block=8, strips=3), lower_pipeline(p, [e, e], e))
    assert len(packed) == 1 and sent[0].where("side = 1").count() and sent[0].where("v <> X''").isEmpty()
    # The same table read otherwise isn't the same relation.
    other = e.withColumn("x", F.col("x") + 1)
    for q, k, v, n in ((e, other, other, 2), (e, e, other, 2), (other, e, other, 3)):
        packed.clear()
        check(attention(p, [q, k], v, block=8, strips=3), lower_pipeline(p, [q, k], v))
        assert len(packed) == n


def test_strips_are_no_more_than_asked_for(spark, monkeypatch):
    """One strip more than cores take in whole rounds costs a round, and a copy of all keys."""
    kind, dealt = type(spark.range(0)), []
    deal = kind.repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda self, n, by: dealt.append(n) or deal(self, n, by))
    q, k, v = (frame(spark, n=48, seed=s) for s in range(3))
    p = pipeline(WEIGHTS["softmax"])
    check(attention(p, [q, k], v, block=8, strips=5), lower_pipeline(p, [q, k], v))
    assert dealt == [5]


@pytest.mark.parametrize("normalizer", ["groups", None])
@pytest.mark.parametrize("conditions", [(), CAUSAL])
@pytest.mark.parametrize("order", [1, -1])
def test_scores_small_and_large_sum_to_the_same_quotients(monkeypatch, normalizer, conditions, order):
    """Blocks of small scores are summed without a shift; others, far below or above, with one."""
    module = importlib.import_module("joinloom.operators.attention")
    rng = np.random.default_rng(5)
    ids = np.arange(24)
    q, v = rng.normal(size=(24, 3)) * np.repeat([1.0, 30.0, 0.0], 8)[:, None], rng.normal(size=(24, 3))
    k = rng.normal(size=(24, 3)) * np.repeat([2.0, 900.0, 1.0], 8)[::order, None]
    p = pipeline(Weight(scale=Scale(2.0, True)), normalizer, conditions)
    used, weights = [], module._weights
    monkeypatch.setattr(module, "_weights", lambda w, s, keep, shifted: used.append(shifted) or weights(w, s, keep, shifted))
    strip = module.Strip(p, "a", [["x"], ["x"]], 8)
    for i in range(0, 24, 2):
        strip.queries(ids[i : i + 2], q[None, i : i + 2])
    for i in range(0, 24, 4):
        strip.keys(ids[i : i + 4], k[None, i : i + 4], v[i : i + 4])
    got = {}
    for at, rows in strip.results():
        got.update(zip(at.tolist(), rows, strict=True))
    s = q @ k.T / 2
    s[~(ids[:, None] >= ids[None, :]) if conditions else np.zeros((24, 24), bool)] = -np.inf
    w = np.exp(s - s.max(axis=1)[:, None])
    want = w @ v / (w.sum(axis=1)[:, None] if normalizer else 1)
    assert sorted(got) == list(range(24)) and set(used) == ({True, False} if normalizer else {True})
    assert np.abs(np.array([got[i] for i in range(24)]) - want).max() < 1e-10
