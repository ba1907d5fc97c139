"""Feature frame of the single-table analysis: time, encoded categories, frequencies, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import KeyProfile, attach_stats, key_stats, profile_keys
from .ordered import rank_values

FEATURES = [
    "hour", "day_of_week", "is_night", "is_weekend", "host_enc", "host_freq", "user_enc", "user_freq",
    "proc_enc", "proc_rarity", "action_enc", "cmd_len", "args_count_num", "file_size_num", "file_size_log",
]


def time_features(df: DataFrame) -> DataFrame:
    hour = F.coalesce(F.hour("ts"), F.lit(12))
    day = F.coalesce(F.weekday("ts"), F.lit(0))
    return df.withColumns({
        "hour": hour, "day_of_week": day, "is_night": ((hour < 6) | (hour >= 22)).cast("int"),
        "is_weekend": (day >= 5).cast("int"),
    })


def category_codes(base: DataFrame, key: str, name: str) -> DataFrame:
    """Code of each value in sorted order (nulls as ``unknown``), with its row count."""
    filled = base.select(F.coalesce(F.col(key), F.lit("unknown")).alias(key))
    return rank_values(key_stats(filled, key, {}), [key], name)


def encode(df: DataFrame, base: DataFrame, key: str, name: str, profile: KeyProfile) -> DataFrame:
    """Attach the category code to every row."""
    codes = category_codes(base, key, name).withColumnRenamed(key, "_category")
    tagged = df.withColumn("_category", F.coalesce(F.col(key), F.lit("unknown")))
    moved = KeyProfile(profile.rows, {"_category": profile.keys[key]})
    return attach_stats(tagged, "_category", codes, moved).drop("_category")


def frequencies(df: DataFrame, base: DataFrame, profile: KeyProfile) -> DataFrame:
    for key, name in (("host_name", "host_freq"), ("user_name", "user_freq"), ("process_name", "_proc_n")):
        stats = key_stats(base, key, {}).withColumn(name, F.col("_key_rows"))
        df = attach_stats(df, key, stats, profile)
    rare = F.lit(1.0) / (F.col("_proc_n") + 1)
    return df.withColumns({
        "host_freq": F.coalesce("host_freq", F.lit(0)), "user_freq": F.coalesce("user_freq", F.lit(0)),
        "proc_rarity": F.coalesce(rare, F.lit(0.0)),
    }).drop("_proc_n")


def sizes(df: DataFrame) -> DataFrame:
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumns({
        "cmd_len": F.length(F.coalesce("command_line", F.lit(""))), "args_count_num": number("args_count"),
        "file_size_num": number("file_size"), "file_size_log": F.log1p(number("file_size")),
    })


def local_features(df: DataFrame) -> DataFrame:
    profile = profile_keys(df, ["host_name", "user_name", "process_name", "event_action"])
    out = frequencies(time_features(df), df, profile)
    for key, name in (("host_name", "host_enc"), ("user_name", "user_enc"), ("process_name", "proc_enc"),
                      ("event_action", "action_enc")):
        out = encode(out, df, key, name, profile)
    return sizes(out)

