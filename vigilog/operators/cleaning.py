"""Cleaning of a log table: times, numbers, missing values, duplicates, quality report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NUMERIC_NAME_PARTS
from ..functions.fields import col_of
from ..functions.scalar import parse_timestamp
from .lookup import side_by_side

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def add_parsed_time(df: DataFrame, column: str) -> DataFrame:
    """UTC time of a text column in ``<column>_dt``; the text stays."""
    return df.withColumn(f"{column}_dt", parse_timestamp(col_of(column)))


def time_parse_counts(df: DataFrame, column: str) -> DataFrame:
    """How many texts were parsed, and how many were blank or unreadable."""
    parsed = parse_timestamp(col_of(column))
    return df.agg(F.count(parsed).alias("parsed"), (F.count(F.lit(1)) - F.count(parsed)).alias("errors"))


def to_number(column: Column) -> Column:
    return column.try_cast("double")


def numeric_candidates(df: DataFrame) -> list[str]:
    """Text columns whose name suggests a number."""
    return [
        f.name for f in df.schema.fields
        if f.dataType.simpleString() == "string" and any(p in f.name.lower() for p in NUMERIC_NAME_PARTS)
    ]


def coerce_numbers(df: DataFrame, candidates: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Turn candidate text columns into numbers where at least one value converts.

    One pass counts the convertible values of all candidates; the conversion itself is a projection.
    """
    names = numeric_candidates(df) if candidates is None else list(candidates)
    if not names:
        return df, {}
    row = df.agg(*[F.count(to_number(col_of(c))).alias(f"c{i}") for i, c in enumerate(names)]).first()
    converted = {c: row[f"c{i}"] for i, c in enumerate(names) if row[f"c{i}"] > 0}
    return df.withColumns({c: to_number(col_of(c)) for c in converted}), converted


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and share (four digits) per column in one pass."""
    names = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(col_of(c)).alias(f"c{i}") for i, c in enumerate(names)])
    return row.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col("_rows") - F.col(f"c{i}")).alias("nulls"))
        for i, c in enumerate(names)
    ])).alias("p")).select(
        "p.column", "p.nulls", F.round(F.col("p.nulls") / F.col("_rows").cast("double"), 4).alias("null_share"))


def sparse_columns(profile: DataFrame, limit: float = 0.95) -> list[str]:
    """Columns at or over the null limit; one row per column is collected."""
    return sorted(r["column"] for r in profile.filter(F.col("null_share") >= limit).collect())


def drop_sparse(df: DataFrame, limit: float = 0.95, keep: Sequence[str] = ()) -> DataFrame:
    return df.drop(*[c for c in sparse_columns(null_profile(df), limit) if c not in keep])


def handle_missing(df: DataFrame, strategy: str = "flag", text: str = "<missing>", number: float = 0.0) -> DataFrame:
    """``flag`` keeps nulls, ``fill_default`` fills texts and numbers, ``drop`` drops rows with a null."""
    if strategy == "flag":
        return df
    if strategy == "drop":
        return df.dropna()
    if strategy != "fill_default":
        raise ValueError(f"unknown strategy {strategy!r}")
    fills = {}
    for name in df.columns:
        kind = _kind(df, name)
        if kind == "string":
            fills[name] = F.coalesce(col_of(name), F.lit(text))
        elif kind.split("(")[0] in _NUMBERS:
            fills[name] = F.coalesce(col_of(name), F.lit(number).cast(kind))
    return df.withColumns(fills) if fills else df


def hashable_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString().split("<")[0] not in
            ("map", "struct", "array", "variant")]


def deduplicate(df: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first in ``order``.

    Expressed as a minimum over (order, row), which is combined before the shuffle, so a group of
    copies of any size arrives as one row per input partition.
    """
    usable = hashable_columns(df)
    keys = [k for k in (keys or usable) if k in usable]
    if not keys:
        return df
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    lead = [c for c in order if c in rest]
    packed = F.struct(*[col_of(c) for c in lead], *[col_of(c) for c in rest if c not in lead])
    best = df.groupBy(*[col_of(k) for k in keys]).agg(
        F.min(packed).alias("_row") if set(rest) <= set(usable) else F.min_by(packed, F.struct(*[
            col_of(c) for c in lead or [r for r in rest if r in usable]])).alias("_row"))
    return best.select(*[
        (col_of(c) if c in keys else F.col("_row")[c]).alias(c) for c in df.columns
    ])


@dataclass
class CleaningPlan:
    """Choices of the full cleaning run."""

    time_column: str = "ts_text"
    strategy: str = "flag"
    null_limit: float = 0.95
    dedup_keys: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    renames: dict[str, str] = field(default_factory=dict)
    keep: list[str] = field(default_factory=list)


def quality_report(raw: DataFrame, cleaned: DataFrame, before_dedup: DataFrame | None = None) -> DataFrame:
    """One row: sizes, duplicates, null columns, retention, coverage and duplicate rates."""
    profile = null_profile(raw)
    columns = profile.agg(
        F.count(F.lit(1)).alias("total_fields"),
        F.count(F.when(F.col("null_share") >= 1.0, 1)).alias("fully_null_fields"),
        F.count(F.when((F.col("null_share") >= 0.5) & (F.col("null_share") < 1.0), 1)).alias("high_null_fields"),
        F.round(F.lit(100.0) - F.avg("null_share") * 100.0, 1).alias("coverage_score"),
    )
    size = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both = side_by_side([size(raw, "input"), size(cleaned, "output"), size(before_dedup or raw, "kept"), columns])
    removed = F.col("kept") - F.col("output")
    share = lambda part: F.when(F.col("input") > 0, F.round(part / F.col("input") * 100.0, 1))
    return both.select(
        F.col("input").alias("input_count"), F.col("output").alias("output_count"),
        removed.alias("duplicates_removed"), "total_fields", "fully_null_fields", "high_null_fields",
        F.coalesce(share(F.col("output")), F.lit(100.0)).alias("retention_rate"), "coverage_score",
        F.coalesce(share(removed), F.lit(0.0)).alias("dedup_rate"),
    )
