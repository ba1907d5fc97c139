"""Feature frame of the cleaning run (prefix ``_feat_``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net, scalar
from ..functions.fields import col_of, resolve
from .lookup import attach, profile_keys

PREFIX = "_feat_"


def time_features(df: DataFrame, ts: str) -> DataFrame:
    t = col_of(ts)
    return df.withColumns({
        f"{PREFIX}hour": scalar.hour_of(t), f"{PREFIX}day_of_week": scalar.weekday_of(t),
        f"{PREFIX}day_of_month": F.dayofmonth(t), f"{PREFIX}month": F.month(t),
        f"{PREFIX}is_weekend": scalar.is_weekend(t), f"{PREFIX}is_business_hours": scalar.is_business_hour(t),
        f"{PREFIX}is_night": scalar.is_night(t),
    })


def address_features(df: DataFrame) -> DataFrame:
    for logical in ("src_ip", "dst_ip"):
        name = resolve(df.columns, logical)
        if name:
            ip = col_of(name)
            df = df.withColumns({
                f"{PREFIX}{logical}_is_private": net.is_private_ip(ip), f"{PREFIX}{logical}_class": net.ip_class(ip),
                f"{PREFIX}{logical}_first_octet": net.first_octet(ip),
            })
    return df


def frequency_features(df: DataFrame) -> DataFrame:
    """How often each host, user and source address occurs in the batch; null for null."""
    names = {logical: resolve(df.columns, logical) for logical in ("hostname", "username", "src_ip")}
    names = {logical: name for logical, name in names.items() if name}
    profile = profile_keys(df, list(names.values()))
    for logical, name in names.items():
        df = attach(df, name, {f"{PREFIX}{logical}_batch_freq": F.count(F.lit(1))}, profile)
    return df
