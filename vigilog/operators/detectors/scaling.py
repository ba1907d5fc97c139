"""Scaling of features and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...constants import EPSILON


def min_max(df: DataFrame, column: str, name: str, invert: bool = False) -> DataFrame:
    """Scale to 0..1 over the batch; one small aggregation gives the bounds."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    low, high = (0.0, 0.0) if low is None else (float(low), float(high))
    scaled = (F.col(column) - F.lit(low)) / F.lit(high - low + EPSILON)
    return df.withColumn(name, 1.0 - scaled if invert else scaled)


class StandardScaler:
    """Centre and divide by the population deviation; a constant feature is only centred."""

    def __init__(self, features: Sequence[str]):
        self.features = list(features)
        self.moments: dict[str, tuple[float, float]] = {}

    def fit(self, df: DataFrame) -> "StandardScaler":
        row = df.agg(*[e.alias(f"{k}{i}") for i, c in enumerate(self.features) for k, e in (
            ("m", F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))),
            ("s", F.stddev_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))))]).first()
        self.moments = {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(self.features)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(mean)) / F.lit(std)
            for c, (mean, std) in self.moments.items()
        })
