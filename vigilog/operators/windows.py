"""Ordered operators: gaps, running counts, rolling statistics, failure window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EMA_SPAN, EPSILON, FAILURE_WINDOW, GAP_LIMIT_SECONDS
from ..functions.scalar import clip, epoch_micros
from .ordered import BUCKET_ROWS, ema, framed, global_position, halo_buckets, last_known, per_key_frames, without_halo

ALPHA = 2.0 / (EMA_SPAN + 1)
# (1 - ALPHA) ** 240 is below double precision, so earlier rows cannot show.
EMA_REACH = 240
# Short buckets keep the running products near one, which keeps digits.
EMA_BUCKET = 500


def seconds_since_previous(
    df: DataFrame, key: str, ts: str, tie: str, name: str, group_limit: int | None = None, largest: int | None = None
) -> DataFrame:
    """Seconds to the previous event of the same key, 0 for its first, limited to one hour."""
    options = {} if group_limit is None else {"group_limit": group_limit}

    def build(part: DataFrame, window) -> DataFrame:
        gap = (epoch_micros(F.col(ts)) - F.lag(epoch_micros(F.col(ts))).over(window)) / 1e6
        gap = clip(F.coalesce(gap, F.lit(0.0)), 0, GAP_LIMIT_SECONDS)
        return part.withColumn(name, F.when(F.col(key).isNotNull(), gap).otherwise(F.lit(0.0)))

    return per_key_frames(df, key, [ts, tie], 1, build, largest=largest, **options)


def running_count(
    df: DataFrame, key: str, order: Sequence[str], name: str, group_limit: int | None = None, largest: int | None = None
) -> DataFrame:
    """How many rows of the key came so far, this one included; null for a null key."""
    options = {} if group_limit is None else {"group_limit": group_limit}
    return per_key_frames(
        df, key, order, 0,
        lambda part, window: part.withColumn(name, F.when(F.col(key).isNotNull(), F.col("_rank").cast("long"))),
        largest=largest, **options,
    )


def volume_statistics(df: DataFrame, key: str, order: Sequence[str], prefix: str, largest: int | None = None) -> DataFrame:
    """Exponential mean, rolling deviation and z-score of the running count of each key.

    The running count of one key is 1, 2, 3, ..., so all three are functions of the rank alone: the
    mean lags behind the count t by the sum of (1-a)^j for j = 1..t-1, and n consecutive integers
    have sample variance n(n+1)/12. Only the rank needs ordering.
    """
    out = running_count(df, key, order, "_t", largest=largest)
    t = F.col("_t").cast("double")
    lag = (F.lit(1.0 - ALPHA) - F.pow(F.lit(1.0 - ALPHA), t)) / F.lit(ALPHA)
    n = F.least(t, F.lit(10.0))
    std = F.when(t >= 2, F.sqrt(n * (n + 1) / 12.0)).when(t < 2, F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.withColumns({
        f"{prefix}_ema": zero(t - lag), f"{prefix}_std": zero(std), f"{prefix}_zscore": zero(lag / (std + EPSILON)),
    }).drop("_t")


def volume_statistics_row_order(df: DataFrame, key: str, order: Sequence[str], prefix: str) -> DataFrame:
    """The same three figures over the running counts of all keys in row order, keys mixed.

    Rows with a null key have no count: they keep the last mean, leave the rolling window one value
    short, and widen the decay of the next count.
    """
    counted = running_count(df, key, order, "_x")
    placed = global_position(counted, order)
    filled = global_position(placed.filter(F.col("_x").isNotNull()).select("_pos", "_x"), ["_pos"], "_seq")

    def mean(part: DataFrame, window) -> DataFrame:
        gap = F.col("_pos") - F.lag("_pos").over(window)
        old = F.pow(F.lit(1.0 - ALPHA), F.coalesce(gap, F.lit(1)).cast("double"))
        part = part.withColumn("_old", old)
        total = F.col("_old") + ALPHA
        return ema(part, "_x", F.col("_old") / total, F.lit(ALPHA) / total, F.col("_seq") == 0, window, "_ema").drop("_old")

    means = framed(filled, EMA_REACH, mean, position="_seq", rows=EMA_BUCKET).select("_pos", "_ema")
    joined = placed.join(means, "_pos", "left")

    def rolling(part: DataFrame, window) -> DataFrame:
        last10 = window.rowsBetween(-9, 0)
        std = F.when(F.count("_x").over(last10) >= 2, F.stddev_samp("_x").over(last10))
        return part.withColumn("_std", F.coalesce(std, F.lit(0.0)))

    out = last_known(framed(joined, 9, rolling), "_ema", "_carried")
    zscore = (F.col("_x") - F.col("_carried")) / (F.col("_std") + EPSILON)
    return out.withColumns({
        f"{prefix}_ema": F.coalesce("_carried", F.lit(0.0)), f"{prefix}_std": F.col("_std"),
        f"{prefix}_zscore": F.coalesce(zscore, F.lit(0.0)),
    }).drop("_x", "_ema", "_carried", "_std", "_pos")


def _sliding(x: np.ndarray, size: int) -> np.ndarray:
    """The window of ``size`` values that ends at each row of a column, NaN before the first row."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(size - 1, np.nan), x]), size)


def _deviations(x: np.ndarray, short: int, long: int) -> np.ndarray:
    """|mean of the last ``short`` - mean of the last ``long``| in deviations of the long ones, by row; nulls left out."""
    near, far = _sliding(x, short), _sliding(x, long)
    count = (~np.isnan(far)).sum(axis=1)
    mean = np.nansum(far, axis=1) / np.maximum(count, 1)
    spread = np.sqrt(np.nansum((far - mean[:, None]) ** 2, axis=1) / np.maximum(count, 1))
    near_count = (~np.isnan(near)).sum(axis=1)
    out = np.abs((np.nansum(near, axis=1) / np.maximum(near_count, 1) - mean) / (spread + EPSILON))
    return np.where(near_count > 0, out, np.nan)


def rolling_deviation(
    df: DataFrame, order: Sequence[str], features: Sequence[str], name: str = "deviation", short: int = 10, long: int = 100,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Largest deviation, over the features, of the short mean from the long mean in long deviations.

    0 until ``short`` rows exist; the current row belongs to both windows. Only position and features go through the
    buckets; a bucket is a bounded array, over which the windows slide without being built row by row.
    """
    placed = global_position(df, order)
    narrow = placed.select("_pos", *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)])

    def slide(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_pos")
        position = rows["_pos"].to_numpy()
        columns = [rows[f"_f{i}"].to_numpy().astype(float) for i in range(len(features))]
        worst = np.fmax.reduce([_deviations(x, short, long) for x in columns])
        worst = pa.array(np.where(position + 1 >= short, worst, 0.0), from_pandas=True)
        home = (rows["_home"].to_numpy() == rows["_bucket"].to_numpy())
        return pa.table({"_pos": rows["_pos"], name: worst}).filter(pa.array(home))

    found = halo_buckets(narrow, long - 1, rows=bucket_rows).groupBy("_bucket").applyInArrow(slide, f"_pos long, {name} double")
    return placed.join(found, "_pos").drop("_pos")


def failures_in_window(
    df: DataFrame, key: str, failed: str, order: Sequence[str], name: str, size: int = FAILURE_WINDOW,
    bucket_rows: int = 10_000,
) -> DataFrame:
    """Failures of the same key among the ``size`` events of everybody before this one.

    The frame ranges over the global position. Buckets of positions with a halo of ``size`` keep it
    exact and keep every task at one bucket, also when one key owns most of the rows.
    """
    placed = global_position(df, order)
    halo = halo_buckets(placed, size, rows=bucket_rows)
    window = Window.partitionBy("_bucket", key).orderBy("_pos").rangeBetween(-size, -1)
    count = F.coalesce(F.sum(F.col(failed).cast("long")).over(window), F.lit(0))
    return without_halo(halo.withColumn(name, count)).drop("_pos")


def any_true(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
