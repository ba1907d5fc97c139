"""Readers for log files. All of them are plain Spark sources, so scans split and prune as usual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import RAW_COLUMNS

_BAD = "_bad_line"


def read_columns(spark: SparkSession, *paths: str) -> DataFrame:
    """Columnar files."""
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Lines with too many fields are dropped, short lines keep nulls.

    Without a schema one pass infers it; give one for large inputs.
    """
    schema = schema or spark.read.csv(path, header=True, inferSchema=True).schema
    wide = T.StructType(schema.fields + [T.StructField(_BAD, T.StringType())])
    rows = spark.read.csv(path, schema=wide, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD)
    # A flagged line is too long, too short, or holds an unreadable value; only the first is dropped.
    # Quoted runs may hold the separator, so they are blanked before separators are counted.
    bare = F.regexp_replace(F.col(_BAD), r'"(?:[^"]|"")*"', "")
    fields = F.size(F.split(bare, ",", -1))
    return rows.filter(F.col(_BAD).isNull() | (fields <= len(schema.fields))).drop(_BAD)


def raw_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A raw log dump whose first line is unusable: fixed columns, extra fields cut, short lines filled."""
    return spark.read.csv(path, schema=raw_schema(), header=True, enforceSchema=True, mode="PERMISSIVE")


def read_partitions(spark: SparkSession, path: str, condition: Column | None = None) -> DataFrame:
    """A table partitioned by directory; the condition on partition columns prunes files."""
    df = spark.read.parquet(path)
    return df if condition is None else df.filter(condition)


def with_origin(df: DataFrame, name: str = "origin") -> DataFrame:
    """The file a row came from, for tables made of several files."""
    return df.withColumn(name, F.col("_metadata.file_name"))


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write by partition columns. Rebalancing joins small pieces of a partition value and splits a
    large one over several tasks, by measured size."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)
