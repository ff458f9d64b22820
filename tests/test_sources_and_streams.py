"""Sources, sinks, streams, the registry and the entry point."""

import numpy as np
import pytest

import __spark_entry__
from joinloom import sources
from joinloom.ir import Dimension, Fold, Operand
from joinloom.plans.lower import lower
from joinloom.streaming import stream_fold

FOLD = Fold((Operand({"i": "i", "j": "j"}, "v"), Operand({"j": "j"}, "v")), (Dimension("i"), Dimension("j")), ("i",))


@pytest.mark.parametrize("format", ["parquet", "csv", "json", "orc"])
def test_written_and_read(spark, tmp_path, format):
    df = sources.from_numpy(spark, np.arange(6.0).reshape(2, 3), ["i", "j"], "v")
    options = {"header": "true", "inferSchema": "true"} if format == "csv" else {}
    sources.write(df, f"{tmp_path}/t", format, **({"header": "true"} if options else {}))
    back = sources.read(spark, f"{tmp_path}/t", format, **options)
    assert sorted((r.i, r.j, r.v) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_arrays_and_columns(spark):
    df = spark.createDataFrame([(1, [0.5, 1.5], 2, 3.0), (2, [], 4, None)], "t bigint, a array<float>, x int, y double")
    assert [tuple(r) for r in sources.from_arrays(df, "a", ["t"]).collect()] == [(1, 0, 0.5), (1, 1, 1.5)]
    assert sorted(sources.from_columns(df, ["x", "y"], ["t"]).collect(), key=repr) == sorted([(1, 0, 2.0), (1, 1, 3.0), (2, 0, 4.0), (2, 1, None)], key=repr)


def test_stream(spark, tmp_path):
    left = sources.from_numpy(spark, np.arange(12.0).reshape(4, 3), ["i", "j"], "v")
    right = sources.from_numpy(spark, np.array([1.0, 2.0, 3.0]), ["j"], "v")
    left.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(left.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stream_fold(FOLD, [stream, right])
    query = out.writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("sums").collect())) == sorted(map(tuple, lower(FOLD, [left, right]).collect()))
    with pytest.raises(ValueError):
        stream_fold(FOLD, [left, right])


def test_registry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 40
    assert __spark_entry__.entry(spark).limit(1).count() == 1
