"""Aggregate-then-look-up: the join behind every frequency, rarity and diversity feature.

A statistic per key is computed with a partial aggregation (so a hot key is combined before the
shuffle) and brought back to the rows. How it comes back depends on the measured number of keys:

* few keys: the statistics are broadcast, the rows are not shuffled;
* many keys: the statistics of hot keys (those holding at least one row in ``HOT_PARTS``, hence
  at most ``HOT_PARTS`` of them) are broadcast, all other keys go through a shuffled join in
  which rows of hot or null keys are spread by a hash and therefore pile up nowhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_KEYS = 200_000
#: Most bytes of keys that are broadcast, by the longest key.
BROADCAST_BYTES = 64 << 20
HOT_PARTS = 1_000
SPREAD = 4_096


def key_name(key: str | Sequence[str]) -> str:
    return key if isinstance(key, str) else "+".join(key)


def _names(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


@dataclass(frozen=True)
class KeyProfile:
    """Row count, approximate number of keys, filled rows and longest key (bytes) per key, measured in one pass."""

    rows: int
    keys: dict[str, int] = field(default_factory=dict)
    filled: dict[str, int] = field(default_factory=dict)
    longest: dict[str, int] = field(default_factory=dict)

    def few(self, key: str | Sequence[str], limit: int) -> bool:
        """Whether the keys are few and, even if all were as long as the longest, small."""
        keys = self.keys[key_name(key)]
        return keys <= limit and keys * self.longest.get(key_name(key), 0) <= BROADCAST_BYTES


def profile_keys(df: DataFrame, keys: Sequence[str | Sequence[str]]) -> KeyProfile:
    """One column-pruned pass of mergeable sketches over all candidate keys."""
    sketches = []
    for i, key in enumerate(keys):
        names = _names(key)
        value = F.col(names[0]) if len(names) == 1 else F.struct(*names)
        sketches.append(F.approx_count_distinct(value).alias(f"k{i}"))
        known = F.col(names[0]).isNotNull()
        for name in names[1:]:
            known = known & F.col(name).isNotNull()
        sketches.append(F.count(F.when(known, 1)).alias(f"f{i}"))
        sketches.append(F.max(sum((F.octet_length(F.col(n).cast("string")) for n in names[1:]), F.octet_length(F.col(names[0]).cast("string")))).alias(f"w{i}"))
    row = df.agg(F.count(F.lit(1)).alias("rows"), *sketches).first()
    return KeyProfile(
        row["rows"], {key_name(k): row[f"k{i}"] for i, k in enumerate(keys)},
        {key_name(k): row[f"f{i}"] for i, k in enumerate(keys)},
        {key_name(k): row[f"w{i}"] or 0 for i, k in enumerate(keys)},
    )


def key_stats(
    source: DataFrame, key: str | Sequence[str], aggregates: dict[str, Column], weight: str | None = None
) -> DataFrame:
    """Aggregates per non-null key, with the number of rows behind each key in ``_key_rows``.

    ``weight`` names a row count when the source is already partly aggregated.
    """
    names = _names(key)
    filled = source
    for name in names:
        filled = filled.filter(F.col(name).isNotNull())
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return filled.groupBy(*names).agg(
        rows.alias("_key_rows"), *[expr.alias(alias) for alias, expr in aggregates.items()]
    )


def attach_stats(
    df: DataFrame,
    key: str | Sequence[str],
    stats: DataFrame,
    profile: KeyProfile,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Bring a table of key statistics (with ``_key_rows``) back to the rows; null keys get nulls."""
    names = _names(key)
    values = [c for c in stats.columns if c not in (*names, "_key_rows")]
    if profile.few(key, broadcast_keys):
        return df.join(F.broadcast(stats.drop("_key_rows")), names, "left")
    return attach_large(df, stats, names, values, profile.rows)


def attach(
    df: DataFrame,
    key: str | Sequence[str],
    aggregates: dict[str, Column],
    profile: KeyProfile | None = None,
    source: DataFrame | None = None,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Add per-key aggregates to every row. Rows with a null key get nulls."""
    source = df if source is None else source
    profile = profile or profile_keys(source, [key])
    return attach_stats(df, key, key_stats(source, key, aggregates), profile, broadcast_keys)


def attach_large(df: DataFrame, stats: DataFrame, names: list[str], values: list[str], rows: int) -> DataFrame:
    """Look-up for many keys: hot keys by broadcast, the others by a shuffle without hot partitions."""
    columns = df.columns
    hot_from = max(1, -(-rows // HOT_PARTS))
    hot = stats.filter(F.col("_key_rows") >= hot_from).select(
        *names, F.lit(True).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values]
    )
    # At most HOT_PARTS keys can hold 1/HOT_PARTS of the rows each: the broadcast is bounded.
    tagged = df.join(F.broadcast(hot), names, "left")
    settled = F.col("_hot").isNotNull()
    for name in names:
        settled = settled | F.col(name).isNull()
    # The partition number keeps identical copies of a row apart, and is the same when a task is repeated.
    hashable = [f.name for f in df.schema.fields if f.dataType.simpleString().split("<")[0] not in ("map", "variant")]
    row_hash = F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in hashable])
    tagged = tagged.withColumn(
        "_spread", F.when(settled, F.pmod(row_hash, F.lit(SPREAD)) + 1).otherwise(F.lit(0).cast("long"))
    )
    cold = stats.filter(F.col("_key_rows") < hot_from).select(
        *names, F.lit(0).cast("long").alias("_spread"), *[F.col(v).alias(f"_cold_{v}") for v in values]
    )
    joined = tagged.join(cold, [*names, "_spread"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in columns],
        *[F.coalesce(F.col(f"_hot_{v}"), F.col(f"_cold_{v}")).alias(v) for v in values],
    )


def mark_new(stats: DataFrame, key: str, known: DataFrame, alias: str) -> DataFrame:
    """Flag the keys of a statistics table that are not known yet; works on keys, not on rows."""
    seen = known.select(key).distinct().withColumn("_seen", F.lit(True))
    return stats.join(seen, key, "left").withColumn(
        alias, F.when(F.col("_seen").isNull(), F.lit(1.0)).otherwise(F.lit(0.0))).drop("_seen")


def new_key_flag(df: DataFrame, key: str, known: DataFrame, alias: str) -> DataFrame:
    """1.0 on every row of a key that is not known yet; a null is never new."""
    stats = mark_new(key_stats(df, key, {}), key, known, alias)
    out = attach_stats(df, key, stats, profile_keys(df, [key]))
    return out.withColumn(alias, F.coalesce(F.col(alias), F.lit(0.0)))


def semi_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Restrict to a batch of ids. The ids are made unique first, so rows never multiply."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def left_with_default(df: DataFrame, other: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join on a unique id with default values for rows without a partner."""
    joined = df.join(other, key, "left")
    for name, value in defaults.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return joined


def side_by_side(rows: Sequence[DataFrame]) -> DataFrame:
    """Several one-row tables as one row, without joining them."""
    table = rows[0]
    for row in rows[1:]:
        table = table.unionByName(row, allowMissingColumns=True)
    return table.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in table.columns])
