"""Arrays as relations: a row for each coordinate, key columns and a DOUBLE value. Any Spark source serves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    return spark.read.format(format).options(**options).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", **options) -> None:
    df.write.format(format).options(**options).mode(mode).save(path)


def from_arrays(df: DataFrame, array_col: str, keys: list[str], position: str = "d", value: str = "x") -> DataFrame:
    """A row for each element: the keys, its position from 0, and its value."""
    return df.select(*keys, F.posexplode(array_col).alias(position, value)).select(*keys, F.col(position).cast("bigint").alias(position), F.col(value).cast("double").alias(value))


def from_columns(df: DataFrame, columns: list[str], keys: list[str], position: str = "d", value: str = "x") -> DataFrame:
    """Columns as positions 0, 1, ... of a new dimension."""
    return from_arrays(df.withColumn("__array", F.array(*(F.col(c).cast("double") for c in columns))), "__array", keys, position, value)


def from_numpy(spark: SparkSession, array, keys: list[str], value: str = "x") -> DataFrame:
    """A small array as a relation, without missing cells."""
    import numpy as np
    import pyarrow as pa

    at = np.indices(array.shape).reshape(array.ndim, -1)
    return spark.createDataFrame(pa.table({**{k: pa.array(a, pa.int64()) for k, a in zip(keys, at, strict=True)}, value: pa.array(np.asarray(array, float).ravel())}))
