"""The registered queries of folds and pipelines over whole tables, each beside the SQL that defines its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import col, lit
from .ir import Condition, Dimension, Domain, Fold, Operand, Pipeline, Scale, Weight
from .operators.folds import run_fold, run_pipeline
from .plans.contract import einsum, join_back
from .plans.lower import lower
from .sources import from_arrays

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


class T:
    """Inputs: DataFrames of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def e(self) -> DataFrame:
        """Elements of embeddings: t, h (their label), d, x."""
        return from_arrays(self.embeddings.select(F.col("vec_id").alias("t"), F.col("label").cast("bigint").alias("h"), "embedding"), "embedding", ["t", "h"])

    @property
    def lq(self) -> DataFrame:
        """Quantities by supplier and part, keys repeated: i, j, v."""
        return self.lineitem.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))

    @property
    def pm(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("j"), F.col("p_size").cast("double").alias("v"))

    @property
    def ev(self) -> DataFrame:
        return self.events.select(F.col("user_id").alias("u"), F.col("event_type").alias("k"), F.hour("ts").cast("bigint").alias("h"), "value")

    @property
    def points(self) -> DataFrame:
        """The first three features of embeddings as a row each: t, x, y, v."""
        at = lambda i: F.col("embedding")[i].cast("double")
        return self.embeddings.select(F.col("vec_id").alias("t"), at(0).alias("x"), at(1).alias("y"), at(2).alias("v"))


#: The same inputs in DuckDB.
E = "e AS (SELECT vec_id AS t, CAST(label AS BIGINT) AS h, CAST(i - 1 AS BIGINT) AS d, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, len(embedding) + 1) r(i))"
LQ = "lq AS (SELECT l_suppkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem)"
PM = "pm AS (SELECT p_partkey AS j, CAST(p_size AS DOUBLE) AS v FROM part)"
EV = "ev AS (SELECT user_id AS u, event_type AS k, CAST(hour(ts) AS BIGINT) AS h, value FROM events)"
PT = "pt AS (SELECT vec_id AS t, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS v FROM embeddings)"


def _dims(names: str, null_safe: str = "") -> tuple[Dimension, ...]:
    return tuple(Dimension(n, n in null_safe.split()) for n in names.split())


def _rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns or ("v",)})


def _gram(*conditions: Condition) -> Fold:
    return Fold((Operand({"a": "t", "d": "d"}, "x"), Operand({"b": "t", "d": "d"}, "x")), _dims("a b d"), ("a", "b"), conditions=conditions)


def _gram_sql(where: str = "TRUE") -> str:
    return f"WITH {E} SELECT l.t AS a, r.t AS b, round(sum(l.x * r.x), 6) + 0.0::DOUBLE AS v FROM e l JOIN e r ON l.d = r.d AND {where} GROUP BY l.t, r.t"


@_query(_gram_sql())
def fold_matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T(spark, sf_dir).e
    return _rounded(run_fold(_gram(), [e, e]))


@_query("SELECT l.l_suppkey AS i, sum(l.l_quantity * r.l_quantity) AS v FROM lineitem l JOIN lineitem r ON l.l_suppkey = r.l_suppkey AND l.l_partkey = r.l_partkey GROUP BY l.l_suppkey")
def fold_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lq = T(spark, sf_dir).lq
    o = Operand({"i": "i", "j": "j"}, "v")
    return run_fold(Fold((o, o), _dims("i j"), ("i",)), [lq, lq])


@_query(f"WITH {LQ}, {PM} SELECT l.i, sum(l.v * p.v) AS v FROM lq l JOIN (SELECT v, nullif(j % 7, 0) AS j FROM pm) p ON nullif(l.j % 7, 0) IS NOT DISTINCT FROM p.j GROUP BY l.i")
def fold_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir)
    key = F.nullif(F.col("j") % 7, F.lit(0)).alias("j")
    # Sums by key before the join: few keys, many rows.
    fold = Fold((Operand({"i": "i", "j": "j"}, "v"), Operand({"j": "j"}, "v")), _dims("i j", "j"), ("i",))
    left, right = t.lq.groupBy("i", key).agg(F.sum("v").alias("v")), t.pm.groupBy(key).agg(F.sum("v").alias("v"))
    return run_fold(fold, [left, right])


@_query(f"WITH {E} SELECT l.h, l.t AS a, r.t AS b, round(sum(l.x * r.x), 6) + 0.0::DOUBLE AS v FROM e l JOIN e r ON l.h = r.h AND l.d = r.d GROUP BY l.h, l.t, r.t")
def fold_batch_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T(spark, sf_dir).e
    fold = Fold((Operand({"h": "h", "a": "t", "d": "d"}, "x"), Operand({"h": "h", "b": "t", "d": "d"}, "x")), _dims("h a b d"), ("h", "a", "b"))
    return _rounded(run_fold(fold, [e, e]))


@_query("WITH a AS (SELECT l_suppkey AS i, l_partkey AS j, tanh(l_discount * 10) AS v FROM lineitem), b AS (SELECT p_partkey AS j, abs(p_size - 25) / CAST(2 AS DOUBLE) + 1 AS v FROM part) SELECT i, round(sum(a.v * b.v), 6) AS v FROM a JOIN b ON a.j = b.j GROUP BY i")
def fold_expr_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir)
    a = t.lineitem.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.tanh(F.col("l_discount") * 10).alias("v"))
    b = t.part.select(F.col("p_partkey").alias("j"), (F.abs(F.col("p_size") - 25).cast("double") / 2 + 1).alias("v"))
    return _rounded(run_fold(Fold((Operand({"i": "i", "j": "j"}, "v"), Operand({"j": "j"}, "v")), _dims("i j"), ("i",)), [a, b]))


@_query(f"WITH {LQ} SELECT l.i AS a, r.i AS b, sum(l.v * r.v) AS v FROM lq l JOIN lq r ON l.j = r.j GROUP BY l.i, r.i")
def fold_bag_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lq = T(spark, sf_dir).lq
    return run_fold(Fold((Operand({"a": "i", "j": "j"}, "v"), Operand({"b": "i", "j": "j"}, "v")), _dims("a b j"), ("a", "b")), [lq, lq])


@_query(f"WITH {EV}, w AS (SELECT k, h, CAST(count(*) AS DOUBLE) AS n FROM ev GROUP BY k, h) SELECT ev.u, w.h AS hour, round(sum(ev.value * w.n), 6) AS v FROM ev JOIN w ON ev.k = w.k GROUP BY ev.u, w.h")
def fold_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = T(spark, sf_dir).ev
    w = ev.groupBy("k", "h").agg(F.count("*").cast("double").alias("n"))
    return _rounded(run_fold(Fold((Operand({"u": "u", "k": "k"}, "value"), Operand({"k": "k", "hour": "h"}, "n")), _dims("u k hour"), ("u", "hour")), [ev, w]))


def _masked(name: str, where: str, *conditions: Condition) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = T(spark, sf_dir).e
        return _rounded(run_fold(_gram(*conditions), [e, e]))

    query.__name__ = name
    _query(_gram_sql(where))(query)


_masked("fold_mask_causal", "l.t >= r.t", Condition("a", ">=", "b"))
_masked("fold_mask_window", "l.t >= r.t AND l.t - r.t < 32", Condition("a", ">=", "b"), Condition("a", "<", "b", 32))
_masked("fold_mask_abs_band", "abs(l.t - r.t) <= 16", Condition("a", "<=", "b", 16), Condition("a", ">=", "b", -16))
_masked("fold_mask_between", "r.t BETWEEN l.t - 8 AND l.t + 24", Condition("b", ">=", "a", -8), Condition("b", "<=", "a", 24))
_masked("fold_mask_offset", "l.t < r.t + 8", Condition("a", "<", "b", 8))

_PRODUCT = Fold((Operand({"i": "i", "j": "j"}, "v"), Operand({"j": "j"}, "v")), _dims("i j"), ("i",))
#: Domains of which some rows have no sum: beside its own rows, each has a copy of them under keys that no fact has, -1 - key.
_ALL = "f AS (SELECT i, sum(lq.v * pm.v) AS v FROM lq JOIN pm ON lq.j = pm.j GROUP BY i)"
_SUPPLIERS = "s AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT -1 - s_suppkey, s_name, s_acctbal FROM supplier)"
_LINES = "s AS (SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT -1 - l_suppkey, l_orderkey, l_linenumber FROM lineitem)"


def _with_unknown(domain: DataFrame, key: str, *columns: str) -> DataFrame:
    return domain.select(key, *columns).union(domain.select((F.lit(-1) - F.col(key)).alias(key), *columns))


def _domain(spark: SparkSession, sf_dir: str, missing: float | None, *columns: str) -> DataFrame:
    t = T(spark, sf_dir)
    fold = Fold(_PRODUCT.operands, _PRODUCT.dimensions, ("i",), domain=Domain({"i": "s_suppkey"}, ("s_suppkey", *columns), missing))
    return run_fold(fold, [t.lq, t.pm], domain=_with_unknown(t.supplier, "s_suppkey", *columns))


@_query(f"WITH {LQ}, {PM}, {_ALL}, {_SUPPLIERS} SELECT s_suppkey, s_name, f.v FROM s LEFT JOIN f ON s_suppkey = f.i")
def fold_domain_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domain(spark, sf_dir, None, "s_name")


@_query(f"WITH {LQ}, {PM}, {_ALL}, {_SUPPLIERS} SELECT s_suppkey, s_name, coalesce(f.v, 0) AS v FROM s LEFT JOIN f ON s_suppkey = f.i")
def fold_domain_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domain(spark, sf_dir, 0.0, "s_name")


@_query(f"WITH {LQ}, {PM}, {_ALL}, {_SUPPLIERS} SELECT s_suppkey, s_name, CASE WHEN f.v IS NULL THEN -1 ELSE f.v END AS v FROM s LEFT JOIN f ON s_suppkey = f.i")
def fold_domain_case_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domain(spark, sf_dir, -1.0, "s_name")


@_query(f"WITH {LQ}, {PM}, {_ALL}, {_SUPPLIERS}, g AS (SELECT s.s_suppkey AS i, sum(f.v) AS v FROM s JOIN f ON s.s_suppkey = f.i GROUP BY s.s_suppkey) SELECT s_suppkey, s_name, coalesce(g.v, 0) AS v FROM s LEFT JOIN g ON s_suppkey = g.i")
def fold_join_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir)
    fold = Fold(_PRODUCT.operands, _PRODUCT.dimensions, ("i",), domain=Domain({"i": "s_suppkey"}, ("s_suppkey", "s_name"), 0.0))
    return join_back(fold, [t.lq, t.pm], _with_unknown(t.supplier, "s_suppkey", "s_name"))


@_query(f"WITH {LQ}, {PM}, {_ALL}, {_LINES}, g AS (SELECT s.l_suppkey AS i, sum(f.v) AS v FROM s JOIN f ON s.l_suppkey = f.i GROUP BY s.l_suppkey) SELECT l_orderkey, l_linenumber, coalesce(g.v, 0) AS v FROM s LEFT JOIN g ON l_suppkey = g.i")
def fold_join_back_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir)
    fold = Fold(_PRODUCT.operands, _PRODUCT.dimensions, ("i",), domain=Domain({"i": "l_suppkey"}, ("l_orderkey", "l_linenumber"), 0.0))
    return join_back(fold, [t.lq, t.pm], _with_unknown(t.lineitem, "l_suppkey", "l_orderkey", "l_linenumber"))


@_query(f"WITH {LQ}, {PM}, {_ALL}, {_SUPPLIERS} SELECT s_suppkey, CASE WHEN s_acctbal < 1000 THEN NULL ELSE coalesce(f.v, 0) END AS v FROM s LEFT JOIN f ON s_suppkey = f.i")
def fold_null_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _domain(spark, sf_dir, 0.0, "s_acctbal")
    return out.select("s_suppkey", F.when(F.col("s_acctbal") < 1000, None).otherwise(F.col("v")).alias("v"))


@_query("SELECT CAST(c_nationkey AS BIGINT) AS n, sum(floor(o_totalprice) * l_quantity) AS v FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_nationkey")
def fold_three_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir)
    customers = t.customer.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("n"))
    orders = t.orders.select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("double").alias("p"))
    fold = Fold((Operand({"c": "c_custkey", "n": "n"}), Operand({"c": "o_custkey", "o": "o_orderkey"}, "p"), Operand({"o": "l_orderkey"}, "l_quantity")), _dims("c n o"), ("n",))
    return run_fold(fold, [customers, orders, t.lineitem])


@_query(f"WITH {E}, g AS (SELECT l.d AS d, r.d AS c, sum(l.x * r.x) AS x FROM e l JOIN e r ON l.t = r.t GROUP BY l.d, r.d) SELECT e.t AS a, g.c, round(sum(e.x * g.x), 6) + 0.0::DOUBLE AS v FROM e JOIN g ON e.d = g.d GROUP BY e.t, g.c")
def fold_chain3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E times its transpose times E. The SQL names the cheap order; the fold finds it."""
    e = T(spark, sf_dir).e
    return _rounded(einsum("ad,td,tc->ac", (e, ["t", "d"], "x"), (e, ["t", "d"], "x"), (e, ["t", "d"], "x")))


@_query("WITH c AS (SELECT c_nationkey AS n, CAST(c_custkey % 10 AS DOUBLE) AS v FROM customer), s AS (SELECT s_nationkey AS n, CAST(s_suppkey % 7 AS DOUBLE) AS v FROM supplier), r AS (SELECT n_nationkey AS n, n_regionkey AS r, CAST(n_nationkey AS DOUBLE) AS v FROM nation) SELECT CAST(r.r AS BIGINT) AS r, sum(c.v * s.v * r.v) AS v FROM c JOIN s ON c.n = s.n JOIN r ON s.n = r.n GROUP BY r.r")
def fold_chain_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir)
    c = t.customer.select(F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 10).cast("double").alias("v"))
    s = t.supplier.select(F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 7).cast("double").alias("v"))
    r = t.nation.select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").cast("bigint").alias("r"), F.col("n_nationkey").cast("double").alias("v"))
    return einsum("n,n,nr->r", (c, ["n"], "v"), (s, ["n"], "v"), (r, ["n", "r"], "v"))


@_query(f"WITH {LQ}, {PM}, s AS (SELECT v AS k, CAST(count(*) AS DOUBLE) AS v FROM pm GROUP BY v) SELECT lq.i, sum(lq.v * pm.v * s.v) AS v FROM lq JOIN pm ON lq.j = pm.j JOIN s ON pm.v = s.k GROUP BY lq.i")
def fold_chain_matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir)
    pm = t.pm.withColumn("k", F.col("v"))
    s = t.pm.groupBy(F.col("v").alias("k")).agg(F.count("*").cast("double").alias("v"))
    return einsum("ij,jk,k->i", (t.lq, ["i", "j"], "v"), (pm, ["j", "k"], "v"), (s, ["k"], "v"))


@_query(f"WITH {LQ}, {PM}, f AS (SELECT i, sum(lq.v * pm.v) AS v FROM lq JOIN pm ON lq.j = pm.j GROUP BY i) SELECT CAST(s_nationkey AS BIGINT) AS n, sum(f.v * s_suppkey) AS v FROM f JOIN supplier ON f.i = s_suppkey GROUP BY s_nationkey")
def fold_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir)
    inner = run_fold(_PRODUCT, [t.lq, t.pm])
    s = t.supplier.select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("bigint").alias("n"), F.col("s_suppkey").cast("double").alias("v"))
    return run_fold(Fold((Operand({"i": "i"}, "v"), Operand({"i": "i", "n": "n"}, "v")), _dims("i n"), ("n",)), [inner, s])


@_query(f"WITH {LQ}, {PM} SELECT 'all' AS kind, i, sum(lq.v * pm.v) AS v FROM lq JOIN pm ON lq.j = pm.j GROUP BY i UNION ALL SELECT 'large', i, sum(lq.v * pm.v) FROM lq JOIN pm ON lq.j = pm.j WHERE pm.v > 40 GROUP BY i")
def fold_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir)
    each = [run_fold(_PRODUCT, [t.lq, pm]).select(F.lit(kind).alias("kind"), "i", "v") for kind, pm in (("all", t.pm), ("large", t.pm.where("v > 40")))]
    return each[0].unionByName(each[1])


@_query(f"WITH {LQ}, {PM} SELECT i, sum(lq.v * pm.v) AS v FROM lq JOIN pm ON lq.j = pm.j GROUP BY i ORDER BY v DESC, i LIMIT 10")
def fold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir)
    return run_fold(_PRODUCT, [t.lq, t.pm]).orderBy(F.desc("v"), "i").limit(10)


# Pipelines.


def _attention(weight: Weight, normalizer: str | None, *conditions: Condition, heads: bool = False, value=None) -> Pipeline:
    h, batch = ({"h": "h"}, "h ") if heads else ({}, "")
    side = lambda name: Operand({**h, name: "t", "d": "d"}, None if value else "x")
    producer = Fold((side("a"), side("b")), _dims(batch + "a b d"), tuple((batch + "a b").split()), value, conditions=conditions)
    return Pipeline(producer, weight, Operand({**h, "b": "t", "c": "d"}, "x"), ("b",), normalizer)


def _pipe(name: str, sql: str, p: Pipeline, digits: int = 9) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = T(spark, sf_dir).e
        return _rounded(run_pipeline(p, [e, e], e), digits)

    query.__name__ = name
    _query(sql)(query)


_S = "SELECT q.t AS a, k.t AS b, sum(q.x * k.x) / 8.0::DOUBLE AS s FROM e q JOIN e k ON q.d = k.d{where} GROUP BY q.t, k.t"
_WINDOW = "w AS (SELECT a, b, exp(s - max(s) OVER (PARTITION BY a)) AS w FROM s)"
_OUT = "SELECT w.a, v.d AS c, round(sum(w.w * v.x) / n.z, 9) + 0.0::DOUBLE AS v FROM w JOIN e v ON w.b = v.t JOIN n ON w.a = n.a GROUP BY w.a, v.d, n.z"
_NORM = "n AS (SELECT a, sum(w) AS z FROM w GROUP BY a)"


def _soft(where: str = "", weights: str = _WINDOW, out: str = _OUT, scores: str = _S) -> str:
    return f"WITH {E}, s AS ({scores.format(where=where)}), {weights}, {_NORM} {out}"


_SOFTMAX = Weight(scale=Scale(8.0, divides=True))
_GROUPED = "m AS (SELECT a, max(s) AS m FROM s GROUP BY a), w AS (SELECT s.a, s.b, exp(s.s - m.m) AS w FROM s JOIN m ON s.a = m.a)"
_INSIDE = "SELECT w.a, v.d AS c, round(sum(w.w / n.z * v.x), 9) + 0.0::DOUBLE AS v FROM w JOIN e v ON w.b = v.t JOIN n ON w.a = n.a GROUP BY w.a, v.d"
_ROWS = "SELECT w.a, v.d AS c, round(sum(w.w * v.x) / sum(w.w), 9) + 0.0::DOUBLE AS v FROM w JOIN e v ON w.b = v.t GROUP BY w.a, v.d"

_pipe("pipe_attention_window", _soft(), _attention(_SOFTMAX, "groups"))
_pipe("pipe_attention_groupby", _soft(weights=_GROUPED), _attention(_SOFTMAX, "groups"))
_pipe("pipe_attention_inside", _soft(out=_INSIDE), _attention(_SOFTMAX, "groups"))
_pipe("pipe_attention_causal", _soft(" AND q.t >= k.t"), _attention(_SOFTMAX, "groups", Condition("a", ">=", "b")))
_pipe("pipe_attention_sliding", _soft(" AND q.t >= k.t AND q.t - k.t < 64"), _attention(_SOFTMAX, "groups", Condition("a", ">=", "b"), Condition("a", "<", "b", 64)))
_pipe("pipe_joined_rows", _soft(out=_ROWS), _attention(_SOFTMAX, "rows"))
_pipe("pipe_exp_unshifted", _soft(weights="w AS (SELECT a, b, exp(s) AS w FROM s)"), _attention(Weight(scale=Scale(8.0, divides=True), shifted=False), "groups"))
_pipe("pipe_score_times", _soft(scores=_S.replace("/ 8.0", "* 0.25")), _attention(Weight(scale=Scale(0.25)), "groups"))
_RAW = _S.replace(" / 8.0::DOUBLE", "")
_pipe("pipe_sigmoid", _soft(scores=_RAW, weights="w AS (SELECT a, b, 1 / (1 + exp(-s)) AS w FROM s)"), _attention(Weight(of=1 / (1 + (-col(0, "s")).exp())), "groups"))
_pipe("pipe_cauchy", _soft(scores=_RAW, weights="w AS (SELECT a, b, 1 / (1 + power(s, 2)) AS w FROM s)"), _attention(Weight(of=1 / (1 + col(0, "s") ** 2)), "groups"))
_pipe(
    "pipe_chain_unnormalized",
    f"WITH {E}, s AS ({_RAW.format(where='')}) SELECT s.a, v.d AS c, round(sum(s.s * v.x), 6) + 0.0::DOUBLE AS v FROM s JOIN e v ON s.b = v.t GROUP BY s.a, v.d",
    _attention(Weight(of=col(0, "s")), None),
    6,
)
_pipe(
    "pipe_rowexpr_sum",
    _soft(scores="SELECT q.t AS a, k.t AS b, -sum(power(q.x - k.x, 2)) AS s FROM e q JOIN e k ON q.d = k.d GROUP BY q.t, k.t", weights="w AS (SELECT a, b, exp(s) AS w FROM s)"),
    _attention(Weight(shifted=False, scale=Scale(-1.0)), "groups", value=(col(0, "x") - col(1, "x")) ** 2),
)
_pipe(
    "pipe_attention_heads",
    f"""WITH {E}, s AS (SELECT q.h, q.t AS a, k.t AS b, sum(q.x * k.x) / 8.0::DOUBLE AS s FROM e q JOIN e k ON q.h = k.h AND q.d = k.d GROUP BY q.h, q.t, k.t),
    w AS (SELECT h, a, b, exp(s - max(s) OVER (PARTITION BY h, a)) AS w FROM s), n AS (SELECT h, a, sum(w) AS z FROM w GROUP BY h, a)
    SELECT w.h, w.a, v.d AS c, round(sum(w.w * v.x) / n.z, 9) + 0.0::DOUBLE AS v FROM w JOIN e v ON w.h = v.h AND w.b = v.t JOIN n ON w.h = n.h AND w.a = n.a GROUP BY w.h, w.a, v.d, n.z""",
    _attention(_SOFTMAX, "groups", heads=True),
)

_GAUSS = (-((col(0, "x") - col(1, "x")) ** 2 + (col(0, "y") - col(1, "y")) ** 2) / lit(0.02)).exp()


def _smoother(normalizer: str) -> Pipeline:
    producer = Fold((Operand({"a": "t"}), Operand({"b": "t"})), _dims("a b"), ("a", "b"), _GAUSS)
    return Pipeline(producer, Weight(of=col(0, "s")), Operand({"b": "t", "c": "c"}, "v"), ("b",), normalizer)


_PAIRS = f"WITH {PT}, w AS (SELECT q.t AS a, k.t AS b, exp(-(power(q.x - k.x, 2) + power(q.y - k.y, 2)) / 0.02::DOUBLE) AS w FROM pt q CROSS JOIN pt k), n AS (SELECT a, sum(w) AS z FROM w GROUP BY a)"


@_query(f"{_PAIRS} SELECT w.a, round(sum(w.w * v.v) / n.z, 9) + 0.0::DOUBLE AS v FROM w JOIN pt v ON w.b = v.t JOIN n ON n.a = w.a GROUP BY w.a, n.z")
def pipe_gaussian_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T(spark, sf_dir).points
    return _rounded(run_pipeline(_smoother("groups"), [p, p], p.withColumn("c", F.lit(0))).drop("c"), 9)


@_query(f"{_PAIRS} SELECT w.a, round(sum(w.w * v.v) / sum(w.w), 9) + 0.0::DOUBLE AS v FROM w JOIN pt v ON w.b = v.t GROUP BY w.a")
def pipe_nadaraya_watson(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T(spark, sf_dir).points
    return _rounded(run_pipeline(_smoother("rows"), [p, p], p.withColumn("c", F.lit(0))).drop("c"), 9)


# Expressions and other monoids.


@_query(f"WITH {LQ}, {PM} SELECT i, round(sum(ln(lq.v + 1) * abs(pm.v - 25) / (lq.v + 0.5::DOUBLE) - exp(-pm.v) + power(pm.v, 1.5::DOUBLE)), 6) AS v FROM lq JOIN pm ON lq.j = pm.j GROUP BY i")
def expr_closed_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir)
    a, b = col(0, "v"), col(1, "v")
    value = (a + 1).ln() * (b - 25).abs() / (a + 0.5) - (-b).exp() + b ** 1.5
    fold = Fold((Operand({"i": "i", "j": "j"}), Operand({"j": "j"})), _dims("i j"), ("i",), value)
    return _rounded(run_fold(fold, [t.lq, t.pm]))


@_query("""WITH a AS (SELECT l_suppkey AS i, l_partkey AS j, CASE WHEN l_quantity IN (1, 2, 3) OR l_quantity BETWEEN 10 AND 20 THEN -l_quantity WHEN NOT l_discount < 0.05 THEN sign(l_quantity - 25) ELSE l_quantity % 7 END AS v FROM lineitem)
SELECT i, sum(a.v * CAST(p_size AS DOUBLE)) AS v FROM a JOIN part ON a.j = p_partkey GROUP BY i""")
def expr_movable(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T(spark, sf_dir)
    q = F.col("l_quantity")
    factor = F.when(q.isin(1, 2, 3) | q.between(10, 20), -q).when(~(F.col("l_discount") < 0.05), F.signum(q - 25)).otherwise(q % 7)
    a = t.lineitem.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), factor.alias("v"))
    return run_fold(_PRODUCT, [a, t.pm])


def _semiring(name: str, aggregate: str, sql: str, value=None, digits: int | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = T(spark, sf_dir)
        fold = Fold(_PRODUCT.operands, _PRODUCT.dimensions, ("i",), value, aggregate)
        out = lower(fold, [t.lq, t.pm])
        return out if digits is None else _rounded(out, digits)

    query.__name__ = name
    _query(f"WITH {LQ}, {PM} SELECT i, {sql} AS v FROM lq JOIN pm ON lq.j = pm.j GROUP BY i")(query)


_plus = col(0, "v") + col(1, "v")
_semiring("semiring_count", "count", "count(lq.v * pm.v)")
_semiring("semiring_avg", "avg", "round(avg(lq.v * pm.v), 6)", digits=6)
_semiring("semiring_minplus", "min", "min(lq.v + pm.v)", _plus)
_semiring("semiring_maxplus", "max", "max(lq.v + pm.v)", _plus)
_semiring("semiring_bool_or", "bool_or", "bool_or(lq.v - pm.v <> 0)", col(0, "v") - col(1, "v"))
_semiring("semiring_bool_and", "bool_and", "bool_and(lq.v - pm.v <> 0)", col(0, "v") - col(1, "v"))
