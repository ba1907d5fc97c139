"""Resolving logical field names against the columns that exist; driver metadata only."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FIELD_ALIASES


def col_of(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col(f"`{name}`")


def resolve(columns: Iterable[str], logical: str, aliases: Mapping[str, list[str]] = FIELD_ALIASES) -> str | None:
    """First alias that is a column, tried as written and with dots as underscores."""
    present = set(columns)
    for alias in aliases.get(logical, [logical]):
        for spelling in (alias, alias.replace(".", "_")):
            if spelling in present:
                return spelling
    return None


def field(df: DataFrame, logical: str) -> Column | None:
    """The resolved field as a column, or None when no alias exists."""
    name = resolve(df.columns, logical)
    return None if name is None else col_of(name)


def first_filled(df: DataFrame, logical: str) -> Column:
    """Row-wise choice: the first alias holding a value, for batches mixing spellings."""
    present = set(df.columns)
    found = []
    for alias in FIELD_ALIASES.get(logical, [logical]):
        for spelling in (alias, alias.replace(".", "_")):
            if spelling in present and spelling not in found:
                found.append(spelling)
    return F.coalesce(*[col_of(name) for name in found]) if found else F.lit(None)


def keep_existing(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Project onto the wanted columns that exist; everything when none does."""
    present = set(df.columns)
    names = [name for name in wanted if name in present]
    return df.select(*[col_of(name) for name in names]) if names else df


def rename_existing(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename only the columns that exist."""
    return df.withColumnsRenamed({old: new for old, new in renames.items() if old in df.columns})


def drop_metadata(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop bookkeeping columns when present."""
    return df.drop(*names)


def entity_of(nested: Column, flat: Column) -> Column:
    """An entity name: the nested spelling first, the flat one when that is empty."""
    filled = F.when(nested != "", nested)
    return F.coalesce(filled, F.when(flat != "", flat))
