"""Behaviour features (prefix ``_ml_``): time, user, address, host, process, event, volume.

One pass over the rows counts all (kind, key, partner) combinations; the narrow table of key statistics
made of them is stored, and all families, the sizes of the look-ups and the largest groups come from it.
State is joined to the statistics (keys, not rows), and each key is brought back to the rows once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AUTH_ACTION, ESCALATION_WORDS, SCRIPT_ENGINES
from ..functions import net, scalar
from ..functions.scalar import flag
from ..session import durable
from .lookup import KeyProfile, attach_stats, key_stats, mark_new
from .windows import seconds_since_previous, volume_statistics

PREFIX = "_ml_"
FAMILIES = ["time", "user", "ip", "host", "process", "event", "volume"]
_KEYS = ["user_name", "source_ip", "host_name", "process_name", "_pair", "event_category"]
_PORTS = "source_ip:destination_port"


@dataclass
class EntityState:
    """What earlier batches left behind; None means nothing was seen before."""

    users: DataFrame | None = None
    addresses: DataFrame | None = None
    hosts: DataFrame | None = None
    user_counts: DataFrame | None = None


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def with_pair(df: DataFrame) -> DataFrame:
    """Parent and child process as one text; a missing name is the text ``nan`` and counts."""
    text = lambda c: F.coalesce(F.col(c), F.lit("nan"))
    return df.withColumn("_pair", F.concat(text("parent_name"), F.lit(" -> "), text("process_name")))


class KeyTable:
    """Statistics of every key of every kind, from one scan.

    Columns: ``kind``, ``key``, ``_key_rows``, ``_failed``, ``_partners`` (distinct partners: hosts of a user, users of an
    address, ports of an address under a kind of its own) and ``_entropy`` of the partners.
    """

    def __init__(self, df: DataFrame):
        base = with_pair(df)
        nothing, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
        failed = F.coalesce((F.lower("event_outcome") == "failure").cast("long"), zero)

        def pair(kind: str, key: str, partner: Column = nothing, hits: Column = zero) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"), partner.alias("partner"), hits.alias("hits"))

        combinations = F.explode(F.array(
            pair("user_name", "user_name", F.col("host_name"), failed), pair("source_ip", "source_ip", F.col("user_name")),
            pair(_PORTS, "source_ip", F.col("destination_port").cast("string")),
            *[pair(k, k) for k in ("host_name", "process_name", "_pair", "event_category")]))
        counted = base.select(combinations.alias("p")).select("p.*").groupBy("kind", "key", "partner").agg(
            F.count(F.lit(1)).alias("n"), F.sum("hits").alias("hits"))
        filled = F.when(F.col("partner").isNotNull(), F.col("n"))
        total, spread = F.sum(filled), F.sum(filled * F.log(filled))
        self.table = durable(counted.groupBy("kind", "key").agg(
            F.sum("n").alias("_key_rows"), F.sum("hits").alias("_failed"), F.count("partner").alias("_partners"),
            F.when(F.count("partner") > 1, F.log(total) - spread / total).otherwise(F.lit(0.0)).alias("_entropy")))
        known = F.col("key").isNotNull()
        rows = {r["kind"]: r for r in self.table.groupBy("kind").agg(
            F.sum("_key_rows").alias("rows"), F.count("key").alias("keys"), F.coalesce(F.sum(F.when(known, F.col("_key_rows"))), F.lit(0)).alias("filled"),
            F.coalesce(F.max(F.octet_length("key")), F.lit(0)).alias("longest"), F.max("_key_rows").alias("largest")).collect()}
        fact = lambda kind, name: rows[kind][name] if kind in rows else 0
        self.profile = KeyProfile(
            fact("user_name", "rows"), {k: fact(k, "keys") for k in _KEYS}, {k: fact(k, "filled") for k in _KEYS}, {k: fact(k, "longest") for k in _KEYS})
        self._largest = {k: fact(k, "largest") for k in _KEYS}

    def of(self, kind: str, key: str, **columns: str) -> DataFrame:
        """The statistics of one kind under the key's name; ``columns`` names what is wanted besides the rows."""
        rows = self.table.filter((F.col("kind") == kind) & F.col("key").isNotNull())
        return rows.select(F.col("key").alias(key), "_key_rows", *[F.col(v).alias(k) for k, v in columns.items()])

    def largest(self, key: str) -> int:
        return self._largest[key]


def share(rows: Column, total: int) -> Column:
    return rows / F.lit(float(max(total, 1)))


def time_features(df: DataFrame, keys: KeyTable, tie: str = "doc_id") -> DataFrame:
    df = seconds_since_previous(df, "user_name", "ts", tie, f"{PREFIX}time_since_last_event", largest=keys.largest("user_name"))
    ts = F.col("ts")
    return df.withColumns({
        f"{PREFIX}time_hour": F.hour(ts) / 24.0, f"{PREFIX}time_is_weekend": flag(scalar.is_weekend(ts)),
        f"{PREFIX}time_is_night": flag(scalar.is_night(ts)),
    })


def user_features(df: DataFrame, keys: KeyTable, state: EntityState) -> DataFrame:
    stats = keys.of("user_name", "user_name", _n="_key_rows", _failed="_failed", _hosts="_partners")
    known = state.users if state.users is not None else _empty(df, "user_name string")
    counts = state.user_counts if state.user_counts is not None else _empty(df, "user_name string, n long")
    stats = mark_new(stats, "user_name", known, f"{PREFIX}user_is_new").join(
        counts.select("user_name", F.col("n").alias("_history")), "user_name", "left")
    stats = stats.withColumns({
        f"{PREFIX}user_burst_score": F.col("_n") / (F.coalesce("_history", F.lit(0)) + F.col("_n")),
        f"{PREFIX}user_failed_login_ratio": F.col("_failed") / F.col("_n"),
        f"{PREFIX}user_unique_hosts_accessed": F.col("_hosts").cast("double"),
    }).drop("_n", "_failed", "_hosts", "_history")
    out = attach_stats(df, "user_name", stats, keys.profile)
    zero = lambda name: F.coalesce(F.col(f"{PREFIX}{name}"), F.lit(0.0))
    return out.withColumns({
        f"{PREFIX}user_is_new": zero("user_is_new"),
        f"{PREFIX}user_burst_score": F.coalesce(F.col(f"{PREFIX}user_burst_score"), F.lit(1.0)),
        f"{PREFIX}user_failed_login_ratio": zero("user_failed_login_ratio"),
        f"{PREFIX}user_unique_hosts_accessed": zero("user_unique_hosts_accessed"),
        f"{PREFIX}user_priv_escalation_flag": flag(F.lower("event_action").isin(ESCALATION_WORDS)),
    })


def port_entropy(base: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Entropy of a value's distribution per key: counts per (key, value) first, then per key."""
    pairs = base.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    filled = F.when(F.col(value).isNotNull(), F.col("_n"))
    total, spread = F.sum(filled), F.sum(filled * F.log(filled))
    entropy = F.when(F.count(value) > 1, F.log(total) - spread / total).otherwise(F.lit(0.0))
    return key_stats(pairs, key, {name: entropy}, weight="_n")


def address_features(df: DataFrame, keys: KeyTable, state: EntityState) -> DataFrame:
    total = keys.profile.filled["source_ip"]
    known = state.addresses if state.addresses is not None else _empty(df, "source_ip string")
    stats = mark_new(keys.of("source_ip", "source_ip", _users="_partners"), "source_ip", known, f"{PREFIX}ip_is_new")
    entropy = keys.of(_PORTS, "source_ip", **{f"{PREFIX}ip_port_entropy": "_entropy"}).drop("_key_rows")
    private = net.is_private_ip(F.col("source_ip"))
    stats = stats.join(entropy, "source_ip").withColumns({
        f"{PREFIX}ip_rarity": 1.0 - share(F.col("_key_rows"), total),
        f"{PREFIX}ip_unique_users": F.col("_users").cast("double"),
        # One test per address instead of one per row.
        f"{PREFIX}ip_is_private": private.cast("double"),
    }).drop("_users")
    out = attach_stats(df, "source_ip", stats, keys.profile)
    fills = {"ip_is_new": 0.0, "ip_rarity": 1.0, "ip_unique_users": 0.0, "ip_is_private": 0.0, "ip_port_entropy": 0.0}
    return out.withColumns({
        **{f"{PREFIX}{n}": F.coalesce(F.col(f"{PREFIX}{n}"), F.lit(v)) for n, v in fills.items()},
        f"{PREFIX}ip_impossible_travel": F.lit(0.0),
    })


def host_features(df: DataFrame, keys: KeyTable, state: EntityState) -> DataFrame:
    total = keys.profile.filled["host_name"]
    known = state.hosts if state.hosts is not None else _empty(df, "host_name string")
    stats = mark_new(keys.of("host_name", "host_name"), "host_name", known, f"{PREFIX}host_is_new")
    stats = stats.withColumn(f"{PREFIX}host_freq", share(F.col("_key_rows"), total))
    out = attach_stats(df, "host_name", stats, keys.profile)
    freq = F.coalesce(F.col(f"{PREFIX}host_freq"), F.lit(0.0))
    return out.withColumns({
        f"{PREFIX}host_is_new": F.coalesce(F.col(f"{PREFIX}host_is_new"), F.lit(0.0)),
        f"{PREFIX}host_freq": freq, f"{PREFIX}host_rarity": 1.0 - freq,
    })


def rarity(df: DataFrame, keys: KeyTable, key: str, name: str) -> DataFrame:
    """1 - share of the value among filled rows; a null is fully rare."""
    total = keys.profile.filled[key]
    stats = keys.of(key, key).withColumn(name, 1.0 - share(F.col("_key_rows"), total))
    out = attach_stats(df, key, stats, keys.profile)
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(1.0)))


def process_features(df: DataFrame, keys: KeyTable) -> DataFrame:
    df = rarity(df, keys, "process_name", f"{PREFIX}process_rarity")
    df = rarity(with_pair(df), keys, "_pair", f"{PREFIX}process_parent_child_rarity").drop("_pair")
    return df.withColumns({
        f"{PREFIX}process_is_script_engine": flag(F.lower("process_name").isin(SCRIPT_ENGINES)),
        f"{PREFIX}process_suspicious_cmd": flag(scalar.suspicious_command(F.col("command_line"))),
    })


def is_auth_failure() -> Column:
    return F.lower("event_action").rlike(AUTH_ACTION) & F.lower("event_outcome").contains("fail")


def event_features(df: DataFrame, keys: KeyTable) -> DataFrame:
    df = rarity(df, keys, "event_category", f"{PREFIX}event_category_rarity")
    category = F.lower("event_category")
    return df.withColumns({
        f"{PREFIX}event_is_file_mod": flag(category.contains("file")),
        f"{PREFIX}event_is_network": flag(category.contains("network")),
        f"{PREFIX}event_is_auth_failure": flag(is_auth_failure()),
    })


def behaviour_features(
    df: DataFrame, state: EntityState | None = None, families: list[str] | None = None
) -> DataFrame:
    """All behaviour features (or the named families) for every row, nulls filled with 0."""
    state, families = state or EntityState(), families or FAMILIES
    keys, out = KeyTable(df), df
    for family in families:
        if family == "time":
            out = time_features(out, keys)
        elif family == "user":
            out = user_features(out, keys, state)
        elif family == "ip":
            out = address_features(out, keys, state)
        elif family == "host":
            out = host_features(out, keys, state)
        elif family == "process":
            out = process_features(out, keys)
        elif family == "event":
            out = event_features(out, keys)
        elif family == "volume":
            out = volume_statistics(out, "host_name", ["ts", "doc_id"], f"{PREFIX}stat_host_volume", keys.largest("host_name"))
        else:
            raise ValueError(f"unknown feature family {family!r}")
    names = [c for c in out.columns if c.startswith(PREFIX)]
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})


def next_state(df: DataFrame, state: EntityState) -> EntityState:
    """State after the batch: seen entities joined, user counts added up."""
    from ..sources.state import merge_counts, seen_after

    known = lambda part, key: part if part is not None else _empty(df, f"{key} string")
    counts = df.filter("user_name IS NOT NULL").groupBy("user_name").agg(F.count(F.lit(1)).alias("n"))
    old = state.user_counts if state.user_counts is not None else _empty(df, "user_name string, n long")
    return EntityState(
        users=seen_after(known(state.users, "user_name"), df, "user_name"),
        addresses=seen_after(known(state.addresses, "source_ip"), df, "source_ip"),
        hosts=seen_after(known(state.hosts, "host_name"), df, "host_name"),
        user_counts=merge_counts(old, counts, "user_name"),
    )
