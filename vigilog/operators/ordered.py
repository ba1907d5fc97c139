"""Row order at scale.

Global order: rows are range-partitioned and sorted, numbered inside each partition by the engine's
own counter and shifted by the number of rows before the partition. The numbered rows are written
to the shared folder, so the numbers cannot change when an executor is lost.

Frames over that order never need one task for everything: positions are cut into equal buckets and
the last ``halo`` rows of a bucket are copied into the next one, so a frame of at most ``halo`` rows
is complete inside one bucket. A key's own order is the same thing over (key, order), so no task
ever holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .lookup import attach

GROUP_LIMIT = 1_000_000
BUCKET_ROWS = 2_000
_ROW_BITS = 33


def global_position(df: DataFrame, order: Sequence[str], name: str = "_pos") -> DataFrame:
    """Number all rows from 0 in the given total order."""
    spark = df.sparkSession
    numbered = (
        df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn("_mark", F.monotonically_increasing_id())
    )
    fixed = durable(numbered).withColumn("_part", F.shiftright("_mark", _ROW_BITS))
    # One row per partition: bounded by the partition count, not by the data.
    sizes = sorted((r["_part"], r["n"]) for r in fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before = [], 0
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    table = spark.createDataFrame(offsets, "_part long, _before long")
    position = F.col("_before") + F.col("_mark").bitwiseAND((1 << _ROW_BITS) - 1)
    return fixed.join(F.broadcast(table), "_part").withColumn(name, position).drop("_part", "_before", "_mark")


def halo_buckets(df: DataFrame, halo: int, position: str = "_pos", rows: int = BUCKET_ROWS) -> DataFrame:
    """Cut positions into buckets of ``rows`` and repeat the last ``halo`` rows in the next bucket."""
    rows = max(rows, halo, 1)
    bucket = F.floor(F.col(position) / rows).cast("long")
    repeated = F.when(F.pmod(F.col(position), F.lit(rows)) >= rows - halo, bucket + 1)
    copies = F.array_compact(F.array(bucket, repeated))
    return df.withColumn("_home", bucket).withColumn("_bucket", F.explode(copies))


def without_halo(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_bucket") == F.col("_home")).drop("_bucket", "_home")


def framed(
    df: DataFrame,
    halo: int,
    build: Callable[[DataFrame, object], DataFrame],
    key: Sequence[str] = (),
    position: str = "_pos",
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Run ``build(df, window)`` over position-ordered buckets; frames may reach back ``halo`` rows."""
    window = Window.partitionBy("_bucket", *key).orderBy(position)
    return without_halo(build(halo_buckets(df, halo, position, rows), window))


def last_known(df: DataFrame, value: str, name: str, position: str = "_pos", rows: int = BUCKET_ROWS) -> DataFrame:
    """Add the last non-null ``value`` at or before each position, however far back it is.

    A bucket of positions looks into itself; the last value of the buckets before it comes from the table of buckets,
    by the same steps. Each level is smaller by ``rows``, so no task ever orders more than one bucket.
    """
    cell = f"_cell{position}"
    placed = df.withColumn(cell, F.floor(F.col(position) / rows).cast("long"))
    window = Window.partitionBy(cell).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.withColumn(name, F.last(value, ignorenulls=True).over(window))
    if (df.agg(F.max(position)).first()[0] or 0) < rows:
        return inside.drop(cell)
    known = F.col(value).isNotNull()
    cells = placed.groupBy(cell).agg(F.max_by(F.when(known, F.col(value)), F.when(known, F.col(position))).alias(f"{cell}_value"))
    # What is known behind a bucket is what the next one starts with.
    before = last_known(durable(cells), f"{cell}_value", f"{cell}_before", cell, rows).select((F.col(cell) + 1).alias(cell), f"{cell}_before")
    return inside.join(before, cell, "left").withColumn(name, F.coalesce(name, f"{cell}_before")).drop(cell, f"{cell}_before")


def largest_group(df: DataFrame, key: str) -> int:
    row = df.groupBy(key).count().agg(F.max("count").alias("n")).first()
    return row["n"] or 0


def per_key_frames(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    halo: int,
    build: Callable[[DataFrame, object], DataFrame],
    group_limit: int = GROUP_LIMIT,
    bucket_rows: int = BUCKET_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Per-key ordered frames reaching back at most ``halo`` rows; adds ``_rank`` (1-based, per key).

    Small groups use the plain per-key window. When the largest group is over ``group_limit`` rows,
    all rows are numbered in (key, order) and cut into buckets instead. ``largest`` is that size when it is known.
    """
    if (largest_group(df, key) if largest is None else largest) <= group_limit:
        window = Window.partitionBy(key).orderBy(*order)
        return build(df.withColumn("_rank", F.row_number().over(window)), window).drop("_rank")
    placed = global_position(df, [key, *order])
    starts = F.min("_pos")
    placed = attach(placed, key, {"_start": starts})
    # A null key sorts first, so its rows start at position 0.
    placed = placed.withColumn("_rank", (F.col("_pos") - F.coalesce("_start", F.lit(0)) + 1)).drop("_start")
    return framed(placed, halo, build, key=[key], rows=bucket_rows).drop("_pos", "_rank")


def rank_values(df: DataFrame, order: Sequence[str], name: str, local_rows: int = 200_000) -> DataFrame:
    """0-based rank of rows that are already unique: one task for a short list, else global order."""
    if df.limit(local_rows + 1).count() <= local_rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    return global_position(df, order, name)


def ema(df: DataFrame, value: str, keep: Column, bring: Column, first: Column, window, name: str) -> DataFrame:
    """Exponential mean y[t] = keep[t]*y[t-1] + bring[t]*x[t], from two running sums over ``window``.

    With P[t] the product of all keep factors so far, y[t] = P[t] * sum(bring[i]*x[i] / P[i]). The
    product is carried as a sum of logarithms; windows stay short (bucket and halo), so neither side
    leaves the range of a double. The very first value (``first``) enters with weight one.
    """
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log_keep = F.when(first, F.lit(0.0)).otherwise(F.log(keep))
    weighted = F.when(first, F.col(value).cast("double")).otherwise(bring * F.col(value))
    out = df.withColumn("_log_product", F.sum(log_keep).over(running)).withColumn("_weighted", weighted)
    scaled = F.sum(F.col("_weighted") * F.exp(-F.col("_log_product"))).over(running)
    return out.withColumn(name, scaled * F.exp("_log_product")).drop("_log_product", "_weighted")
