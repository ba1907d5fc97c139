"""Parts the detectors share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HASH_RANGE = 1 << 40


def row_hash(*columns: Column) -> Column:
    """Repeatable number in 0 .. 2^40 - 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(_HASH_RANGE))


def bounded_sample(df: DataFrame, number: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, the ones with the lowest hash of their number; same rows on every run.

    A hash threshold thins the rows where they are, so only slightly more than ``n`` reach the sort.
    """
    total = df.count()
    if total <= n:
        return df
    mark = row_hash(F.col(number), F.lit(seed))
    threshold = int(_HASH_RANGE * min(1.0, (n + 6 * n**0.5 + 50) / total))
    return df.withColumn("_mark", mark).filter(F.col("_mark") < threshold).orderBy("_mark", number).limit(n).drop("_mark")


def latest_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows in order: the bounded history a detector learns from."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def as_matrix(columns: Sequence[pd.Series]) -> np.ndarray:
    """Feature columns of one Arrow batch as a matrix, nulls as 0."""
    return np.nan_to_num(np.column_stack([c.to_numpy(dtype=float) for c in columns]), nan=0.0)


def collect_matrix(df: DataFrame, features: Sequence[str]) -> np.ndarray:
    """A bounded model sample as a matrix on the driver."""
    table = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]).toPandas()
    return table.to_numpy(dtype=float).reshape(-1, len(features))


def detection(df: DataFrame, name: str, raw: Column, confidence: Column, anomaly: Column) -> DataFrame:
    """Add one detector's result as a struct column."""
    return df.withColumn(name, F.struct(raw.alias("raw"), confidence.alias("confidence"), anomaly.alias("anomaly")))
