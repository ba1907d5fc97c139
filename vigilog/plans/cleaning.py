"""The full cleaning run: original, cleaned and feature tables with their report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..constants import METADATA_COLUMNS
from ..functions.fields import drop_metadata, rename_existing
from ..operators import cleaning as cl
from ..operators import features_clean as fc


@dataclass
class CleaningResult:
    """What one cleaning run yields; all parts are lazy."""

    original: DataFrame
    cleaned: DataFrame
    features: DataFrame
    report: DataFrame
    dropped_columns: list[str]
    converted: dict[str, int]


def cleaning_run(df: DataFrame, plan: cl.CleaningPlan) -> CleaningResult:
    """Metadata, times, numbers, missing values, names, duplicates, features: in this order."""
    part = drop_metadata(df, METADATA_COLUMNS)
    if plan.time_column in part.columns:
        part = cl.add_parsed_time(part, plan.time_column)
    part, converted = cl.coerce_numbers(part)
    dropped = [c for c in cl.sparse_columns(cl.null_profile(part), plan.null_limit) if c not in plan.keep]
    part = rename_existing(cl.handle_missing(part.drop(*dropped), plan.strategy), plan.renames)
    cleaned = cl.deduplicate(part, plan.dedup_keys, plan.order)
    features = cleaned
    if f"{plan.time_column}_dt" in cleaned.columns:
        features = fc.time_features(features, f"{plan.time_column}_dt")
    features = fc.frequency_features(fc.address_features(features))
    return CleaningResult(df, cleaned, features, cl.quality_report(df, cleaned, part), dropped, converted)
