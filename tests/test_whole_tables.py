"""Registered folds over whole tables, against sums in plain Python."""

from collections import defaultdict

import pytest

from joinloom.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three suppliers, fourteen parts (each remainder by 7 twice), small and large quantities and sizes."""
    at = str(tmp_path_factory.mktemp("whole"))
    lines = [(n, n % 5, n % 3, n % 14, float(1 + n * 7 % 50)) for n in range(90)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(j, 1 + j * 11 % 50) for j in range(14)], "p_partkey bigint, p_size int").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(i, f"s{i}", 900.0 + 100 * i) for i in range(3)], "s_suppkey bigint, s_name string, s_acctbal double").write.parquet(f"{at}/supplier.parquet")
    return at, lines, {j: 1 + j * 11 % 50 for j in range(14)}


def test_null_safe_keys_of_all_parts(spark, folder):
    at, lines, parts = folder
    want = defaultdict(float)
    for _, _, i, j, v in lines:
        want[i] += sum(v * x for k, x in parts.items() if k % 7 == j % 7)
    assert {r.i: r.v for r in QUERIES["fold_null_safe"](spark, at).collect()} == want


def sums(lines, parts):
    out = defaultdict(float)
    for _, _, i, j, v in lines:
        out[i] += v * parts[j]
    return out


@pytest.mark.parametrize("name,missing", [("fold_domain_left", None), ("fold_domain_coalesce", 0.0), ("fold_domain_case_fill", -1.0), ("fold_join_back", 0.0)])
def test_domains_of_whole_tables(spark, folder, name, missing):
    """Every line and part counts; suppliers without lines are there."""
    at, lines, parts = folder
    want = {(i, f"s{i}"): v for i, v in sums(lines, parts).items()} | {(-1 - i, f"s{i}"): missing for i in range(3)}
    assert {(r.s_suppkey, r.s_name): r.v for r in QUERIES[name](spark, at).collect()} == want


def test_repeated_domain_of_whole_tables(spark, folder):
    at, lines, parts = folder
    by, n = sums(lines, parts), defaultdict(int)
    for _, _, i, _, _ in lines:
        n[i] += 1
    want = sorted([(o, k, by[i] * n[i]) for o, k, i, _, _ in lines] + [(o, k, 0.0) for o, k, *_ in lines])
    assert sorted(map(tuple, QUERIES["fold_join_back_duplicates"](spark, at).collect())) == want


def test_nulls_over_whole_tables(spark, folder):
    at, lines, parts = folder
    want = {i: v if i else None for i, v in sums(lines, parts).items()} | {-1 - i: 0.0 if i else None for i in range(3)}
    assert {r.s_suppkey: r.v for r in QUERIES["fold_null_when"](spark, at).collect()} == want
