"""Batch features (prefix ``_ml_``): the numeric matrix the detectors learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EPSILON, FAILURE_WORDS
from ..functions import net, scalar
from ..functions.fields import col_of, resolve
from ..functions.scalar import flag
from ..session import durable
from .aggregates import percentiles_of_counts
from .lookup import attach_stats, key_stats, profile_keys

PREFIX = "_ml_"
FEATURES = [PREFIX + name for name in (
    "hour", "day_of_week", "is_night", "is_weekend", "is_business_hours",
    "host_event_count", "user_event_count", "src_ip_event_count",
    "src_unique_dst_ips", "host_unique_users", "src_ip_rarity",
    "is_failure", "src_failure_ratio", "severity_score",
    "src_is_private", "src_first_octet", "dst_privileged_port",
    "bytes_log", "src_total_bytes_log",
)]
_LOCAL_KEYS = 1_000_000


def weighted_medians(stats: DataFrame, columns: list[str], few: bool) -> dict[str, float]:
    """Median over rows of features that depend on a key only: keys weighted by their rows."""
    if not columns:
        return {}
    if few:
        row = stats.agg(*[F.percentile(c, 0.5, F.col("_key_rows")).alias(c) for c in columns]).first()
        return {c: row[c] if row[c] is not None else 0.0 for c in columns}
    found = {}
    for c in columns:
        counted = stats.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).agg(
            F.sum("_key_rows").alias("n"))
        found[c] = percentiles_of_counts(counted, [50])[50] or 0.0
    return found


def _failure(outcome: Column) -> Column:
    return flag(F.lower(F.coalesce(outcome.cast("string"), F.lit(""))).isin(FAILURE_WORDS))


def batch_features(df: DataFrame, min_rows: int = 5) -> DataFrame:
    """Add all batch features. Absent source columns give 0; other nulls take the batch median."""
    names = {n: resolve(df.columns, n) for n in (
        "timestamp", "hostname", "username", "src_ip", "dst_ip", "severity", "outcome", "dst_port", "bytes_sent")}
    have = lambda *wanted: all(names[w] for w in wanted)
    c = lambda n: col_of(names[n])
    bytes_ = F.coalesce(c("bytes_sent").try_cast("double"), F.lit(0.0)) if have("bytes_sent") else F.lit(0.0)
    failed = _failure(c("outcome")) if have("outcome") else F.lit(0.0)

    keys = [names[n] for n in ("hostname", "username", "src_ip") if names[n]]
    profile = profile_keys(df, keys)
    if profile.rows < min_rows:
        raise ValueError(f"{profile.rows} rows are too few for batch features; {min_rows} are needed")

    plain: dict[str, Column] = {}
    if have("timestamp"):
        ts = c("timestamp")
        plain |= {
            "hour": F.hour(ts), "day_of_week": F.weekday(ts), "is_night": flag(scalar.is_night(ts)),
            "is_weekend": flag(scalar.is_weekend(ts)), "is_business_hours": flag(scalar.is_business_hour(ts)),
        }
    plain["is_failure"] = failed
    plain["severity_score"] = scalar.severity_number(c("severity")) if have("severity") else F.lit(0)
    plain["dst_privileged_port"] = flag(c("dst_port").try_cast("double") < 1024) if have("dst_port") else F.lit(0.0)
    plain["bytes_log"] = F.log1p(bytes_)
    out = df.withColumns({PREFIX + k: v.cast("double") for k, v in plain.items()})

    medians: dict[str, float] = {}
    for logical, label in (("hostname", "host"), ("username", "user"), ("src_ip", "src_ip")):
        if not have(logical):
            continue
        key = names[logical]
        parts: dict[str, Column] = {}
        if logical == "hostname" and have("username"):
            parts[PREFIX + "host_unique_users"] = F.countDistinct(c("username")).cast("double")
        if logical == "src_ip":
            if have("dst_ip"):
                parts[PREFIX + "src_unique_dst_ips"] = F.countDistinct(c("dst_ip")).cast("double")
            if have("outcome"):
                parts[PREFIX + "src_failure_ratio"] = F.avg(failed)
            if have("bytes_sent"):
                parts[PREFIX + "src_total_bytes_log"] = F.log1p(F.sum(bytes_))
        # Bounds, medians and the look-up all read the statistics: compute them once and keep them.
        stats = durable(key_stats(df, key, parts)).withColumn(
            f"{PREFIX}{label}_event_count", F.col("_key_rows").cast("double"))
        if logical == "src_ip":
            stats = _address_stats(stats, key)
        values = [v for v in stats.columns if v not in (key, "_key_rows")]
        medians |= weighted_medians(stats, values, profile.few(key, _LOCAL_KEYS))
        out = attach_stats(out, key, stats, profile)
    fill = {name: F.coalesce(F.col(name), F.lit(float(medians.get(name, 0.0)))) if name in out.columns else F.lit(0.0)
            for name in FEATURES}
    if have("timestamp"):
        # Hours and weekdays have at most 24 values, so their medians are small aggregates.
        row = {"h": 0.0, "d": 0.0}
        if _has_null(df, names["timestamp"]):
            ts = c("timestamp")
            row = df.agg(F.percentile(F.hour(ts), 0.5).alias("h"), F.percentile(F.weekday(ts), 0.5).alias("d")).first()
        fill[PREFIX + "hour"] = F.coalesce(F.col(PREFIX + "hour"), F.lit(float(row["h"] or 0.0)))
        fill[PREFIX + "day_of_week"] = F.coalesce(F.col(PREFIX + "day_of_week"), F.lit(float(row["d"] or 0.0)))
    return out.withColumns(fill)


def _has_null(df: DataFrame, name: str) -> bool:
    return not df.filter(col_of(name).isNull()).isEmpty()


def _address_stats(stats: DataFrame, key: str) -> DataFrame:
    """Rarity scaled to 0..1 over the batch, and what the address text itself tells."""
    row = stats.agg(F.sum("_key_rows").alias("n"), F.min("_key_rows").alias("lo"), F.max("_key_rows").alias("hi")).first()
    total = float(row["n"] or 1)
    rare = lambda rows: 1.0 / F.greatest(rows / F.lit(total), F.lit(EPSILON))
    low = 1.0 / max((row["hi"] or 1) / total, EPSILON)
    high = 1.0 / max((row["lo"] or 1) / total, EPSILON)
    return stats.withColumns({
        PREFIX + "src_ip_rarity": (rare(F.col("_key_rows")) - F.lit(low)) / F.lit(high - low + EPSILON),
        PREFIX + "src_is_private": net.is_private_ip(col_of(key)).cast("double"),
        PREFIX + "src_first_octet": net.first_octet(col_of(key)).cast("double"),
    })
