"""Dashboard plans: several panels over one filtered set of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import bucket_start, many_top_terms, union_all


def dashboard_kpis(df: DataFrame) -> DataFrame:
    """Totals and distinct entities in one aggregation."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("host_name").alias("hosts"),
        F.countDistinct("user_name").alias("users"), F.countDistinct("source_ip").alias("src_ips"),
        F.countDistinct("destination_ip").alias("dst_ips"),
    )


def dashboard_trend(df: DataFrame, interval: str) -> DataFrame:
    """Bucket by severity, long form: any number of severities without a second pass."""
    return df.groupBy(
        bucket_start(F.col("ts"), interval).alias("bucket"), F.col("event_severity").alias("severity")
    ).agg(F.count(F.lit(1)).alias("n"))


def dashboard_lists(df: DataFrame, fields: dict[str, str], n: int = 15) -> DataFrame:
    """All top-n lists of the dashboard in one scan."""
    return many_top_terms(df, fields, n)


def overview_metrics(df: DataFrame, interval: str) -> DataFrame:
    """Volume, severities, top sources and distinct sources as one table (metric, value, n).

    One scan feeds all four: rows are counted by (metric, value) once, and the distinct sources are
    the number of counted source values.
    """
    bucket = bucket_start(F.col("ts"), interval).cast("string")
    pair = lambda metric, value: F.struct(F.lit(metric).alias("metric"), value.alias("value"))
    counted = (
        df.select(F.explode(F.array(
            pair("volume", bucket), pair("severity", F.col("event_severity")), pair("source", F.col("source_ip")),
        )).alias("p")).select("p.*").filter(F.col("value").isNotNull())
        .groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    best = lambda metric, size: counted.filter(F.col("metric") == metric).orderBy(
        F.col("n").desc(), "value").limit(size)
    distinct = counted.filter(F.col("metric") == "source").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("unique_sources").alias("metric"), F.lit(None).cast("string").alias("value"), "n")
    return union_all([
        counted.filter(F.col("metric") == "volume"), best("severity", 20), best("source", 15), distinct,
    ])
