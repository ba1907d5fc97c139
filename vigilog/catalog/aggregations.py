"""AGG: histograms over time and value, top terms, distributions, profiles."""

from pyspark.sql import functions as F

from ..constants import NAMESPACE_ORDER
from ..functions.scalar import percentage
from ..operators import aggregates as agg
from ..operators.filters import time_range
from ..operators.rules import SAMPLE_RULES
from ..plans.dashboard import dashboard_kpis, dashboard_lists, dashboard_trend, overview_metrics
from ..session import durable
from ..sources.logs import LOG_COLUMNS, logs, scored, table
from .filters import END, RANGE, START
from .paging import levels, on_levels
from .registry import on_logs, on_raw, on_scored, query


def in_range(df):
    return df.filter(time_range(F.col("ts"), START, END))


def hours_sql(rows: str) -> str:
    """Gap-filled hourly counts of a query that yields ts."""
    return (
        f"hits AS ({rows}), counted AS (SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM hits GROUP BY 1), "
        "buckets AS (SELECT unnest(generate_series((SELECT min(bucket) FROM counted), (SELECT max(bucket) FROM counted), "
        "INTERVAL 1 HOUR)) AS bucket) "
        "SELECT bucket, coalesce(n, 0) AS n FROM buckets LEFT JOIN counted USING (bucket)"
    )


def logs_hours(rows: str) -> str:
    return on_logs("").rstrip() + ", " + hours_sql(rows)


COMMANDS = (
    "regexp_matches(lower(coalesce(command_line, '')), 'base64|encodedcommand|-enc |iex |invoke-expression|wget|curl|"
    "downloadstring|bitstransfer|-w hidden|-windowstyle hidden|bypass')"
)


@query("agg1_time_histogram", (
    "WITH counted AS (SELECT date_trunc('month', o_orderdate) AS bucket, count(*) AS n, sum(o_totalprice) AS s "
    "FROM orders GROUP BY 1), buckets AS (SELECT CAST(unnest(generate_series((SELECT min(bucket) FROM counted), "
    "(SELECT max(bucket) FROM counted), INTERVAL 1 MONTH)) AS TIMESTAMP) AS bucket) "
    "SELECT bucket, coalesce(n, 0) AS n, round(coalesce(s, 0), 2) AS revenue FROM buckets LEFT JOIN counted USING (bucket)"))
def _(spark, sf):
    out = agg.time_histogram(table(spark, sf, "orders"), "o_orderdate", "1M",
                             {"n": F.count(F.lit(1)), "revenue": F.sum("o_totalprice")})
    return out.withColumn("revenue", F.round("revenue", 2))


@query("agg1_weekly_histogram", on_logs(
    "SELECT date_trunc('week', ts) AS bucket, count(*) AS n FROM logs GROUP BY 1"))
def _(spark, sf):
    return agg.time_histogram(logs(spark, sf), "ts", "1w")


@query("agg2_event_volume", logs_hours(f"SELECT ts FROM logs WHERE {RANGE} AND {COMMANDS}"))
def _(spark, sf):
    from ..functions.scalar import command_families

    families = command_families(F.col("command_line"))
    hit = families["encoded"] | families["download"] | families["hidden"]
    return agg.time_histogram(in_range(logs(spark, sf)).filter(hit), "ts", "1h")


SEVERITIES = ["Critical", "high", "medium", "low", "3"]


@query("agg3_trend_by_severity", on_logs(
    "SELECT date_trunc('day', ts) AS bucket, count(*) AS total, " + ", ".join(
        f"nullif(count(*) FILTER (WHERE event_severity = '{s}'), 0) AS n_{s.lower()}" for s in SEVERITIES)
    + f" FROM logs WHERE {RANGE} GROUP BY 1"))
def _(spark, sf):
    return agg.time_histogram_by(in_range(logs(spark, sf)), "ts", "1d", "event_severity")


@query("agg4_top_terms_by_metric", on_logs(
    "SELECT host_name AS value, count(*) AS n, count(DISTINCT user_name) AS users, "
    "max(network_bytes) AS max_bytes FROM logs WHERE host_name IS NOT NULL GROUP BY 1 "
    "ORDER BY users ASC, value LIMIT 12"))
def _(spark, sf):
    return agg.top_terms(logs(spark, sf), "host_name", 12, order_by="users", ascending=True, extra={
        "users": F.countDistinct("user_name"), "max_bytes": F.max("network_bytes")})


@query("agg5_top_terms_in_range", on_logs(
    f"SELECT process_name AS value, count(*) AS n FROM logs WHERE {RANGE} AND process_name IS NOT NULL "
    "GROUP BY 1 ORDER BY n DESC, value LIMIT 3"))
def _(spark, sf):
    return agg.top_terms(in_range(logs(spark, sf)), "process_name", 3)


@query("agg6_distinct_exact", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT props) AS props FROM events")
def _(spark, sf):
    return table(spark, sf, "events").agg(
        F.countDistinct("user_id").alias("users"), F.countDistinct("props").alias("props"))


@query("agg6_distinct_approx", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem")
def _(spark, sf):
    """Estimates; below an eighth of the registers they are the counts."""
    df = table(spark, sf, "lineitem").withColumnsRenamed({"l_partkey": "parts", "l_orderkey": "orders"})
    return agg.united_distinct(agg.distinct_sketches(df, F.lit(0), ["parts", "orders"]), ["parts", "orders"])


@query("agg6_kept_sketches", (
    "SELECT count(DISTINCT user_id) AS user_id, count(DISTINCT props) AS props FROM events "
    "WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'"))
def _(spark, sf):
    """Sketches of each day are kept; a range of days is their union, and no row is read again."""
    days = agg.distinct_sketches(table(spark, sf, "events"), F.to_date("ts"), ["user_id", "props"])
    return agg.united_distinct(durable(days).filter("part >= '2024-01-05' AND part < '2024-01-20'"), ["user_id", "props"])


@query("agg7_value_count", on_logs("SELECT count(source_ip) AS n, count(network_bytes) AS n_bytes FROM logs"))
def _(spark, sf):
    return logs(spark, sf).agg(F.count("source_ip").alias("n"), F.count("network_bytes").alias("n_bytes"))


@query("agg8_average", "SELECT round(avg(l_quantity), 6) AS quantity, round(avg(l_extendedprice), 4) AS price FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").agg(
        F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("price"))


@query("agg9_percentiles", (
    "SELECT CAST(p AS DOUBLE) AS percent, round(quantile_cont(l_extendedprice, p / 100.0), 6) AS value FROM lineitem, "
    "(SELECT unnest([50, 75, 90, 95, 99]) AS p) GROUP BY p").replace(
    "quantile_cont(l_extendedprice, p / 100.0)",
    "CASE p WHEN 50 THEN quantile_cont(l_extendedprice, 0.5) WHEN 75 THEN quantile_cont(l_extendedprice, 0.75) "
    "WHEN 90 THEN quantile_cont(l_extendedprice, 0.9) WHEN 95 THEN quantile_cont(l_extendedprice, 0.95) "
    "ELSE quantile_cont(l_extendedprice, 0.99) END"))
def _(spark, sf):
    from ..constants import DEFAULT_PERCENTS

    out = agg.percentile_table(table(spark, sf, "lineitem"), "l_extendedprice", DEFAULT_PERCENTS)
    return out.withColumn("value", F.round("value", 6))


@query("agg10_many_metrics", on_logs(
    f"SELECT count(*) AS total, count(DISTINCT source_ip) AS unique_src_ips, round(avg(network_bytes), 4) AS avg_bytes, "
    f"count(event_severity) AS with_severity FROM logs WHERE {RANGE}"))
def _(spark, sf):
    return in_range(logs(spark, sf)).agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("source_ip").alias("unique_src_ips"),
        F.round(F.avg("network_bytes"), 4).alias("avg_bytes"), F.count("event_severity").alias("with_severity"))


@query("agg10_overview", on_logs(
    "SELECT 'volume' AS metric, CAST(bucket AS VARCHAR) AS value, n FROM (SELECT date_trunc('day', ts) AS bucket, "
    "count(*) AS n FROM r GROUP BY 1) UNION ALL SELECT * FROM (SELECT 'severity', event_severity, count(*) AS n FROM r "
    "WHERE event_severity IS NOT NULL GROUP BY 2 ORDER BY n DESC, 2 LIMIT 20) UNION ALL "
    "SELECT * FROM (SELECT 'source', source_ip, count(*) AS n FROM r WHERE source_ip IS NOT NULL GROUP BY 2 "
    "ORDER BY n DESC, 2 LIMIT 15) UNION ALL SELECT 'unique_sources', NULL, count(DISTINCT source_ip) FROM r",
    r=f"SELECT * FROM logs WHERE {RANGE}"))
def _(spark, sf):
    return overview_metrics(in_range(logs(spark, sf)), "1d")


DASH_FIELDS = {
    "hosts": "host_name", "users": "user_name", "src_ips": "source_ip", "dst_ips": "destination_ip",
    "severity": "event_severity", "category": "event_category", "outcome": "event_outcome", "event_ids": "event_action",
}


@query("agg11_dashboard_lists", on_logs(
    "SELECT field, value, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, value) "
    "AS INTEGER) AS rank FROM (" + " UNION ALL ".join(
        f"SELECT '{label}' AS field, {name} AS value, count(*) AS n FROM logs WHERE {RANGE} AND {name} IS NOT NULL GROUP BY 2"
        for label, name in DASH_FIELDS.items()) + ")) WHERE rank <= 15"))
def _(spark, sf):
    return dashboard_lists(in_range(logs(spark, sf)), DASH_FIELDS)


@query("agg11_dashboard_kpis", on_logs(
    "SELECT count(*) AS total, count(DISTINCT host_name) AS hosts, count(DISTINCT user_name) AS users, "
    f"count(DISTINCT source_ip) AS src_ips, count(DISTINCT destination_ip) AS dst_ips FROM logs WHERE {RANGE}"))
def _(spark, sf):
    return dashboard_kpis(in_range(logs(spark, sf)))


@query("agg11_dashboard_trend", on_logs(
    "SELECT date_trunc('hour', ts) AS bucket, event_severity AS severity, count(*) AS n FROM logs "
    f"WHERE {RANGE} GROUP BY 1, 2"))
def _(spark, sf):
    return dashboard_trend(in_range(logs(spark, sf)), "1h")


@query("agg12_total_events", on_logs(f"SELECT count(ts) AS total_events FROM logs WHERE {RANGE}"))
def _(spark, sf):
    return in_range(logs(spark, sf)).agg(F.count("ts").alias("total_events"))


@query("agg13_severity_distribution", on_logs(
    f"SELECT event_severity AS value, count(*) AS n FROM logs WHERE {RANGE} AND event_severity IS NOT NULL GROUP BY 1 "
    "ORDER BY n DESC, value LIMIT 50"))
def _(spark, sf):
    return agg.top_terms(in_range(logs(spark, sf)), "event_severity", 50)


@query("agg14_top_talkers", on_logs(
    f"SELECT source_ip AS value, count(*) AS n FROM logs WHERE {RANGE} AND source_ip IS NOT NULL GROUP BY 1 "
    "ORDER BY n DESC, value LIMIT 20"))
def _(spark, sf):
    return agg.top_terms(in_range(logs(spark, sf)), "source_ip", 20)


@query("agg15_rule_hits_over_time", logs_hours(
    f"SELECT ts FROM logs WHERE {RANGE} AND event_category = 'network' AND network_direction = 'outbound' "
    "AND network_bytes > 1000000"))
def _(spark, sf):
    df = in_range(logs(spark, sf))
    return agg.time_histogram(df.filter(SAMPLE_RULES[2].predicate(df)), "ts", "1h")


@query("agg16_kpis", on_logs(
    "SELECT count(*) AS total_logs, count(DISTINCT host_name) AS unique_hosts, count(DISTINCT user_name) AS unique_users, "
    "count(DISTINCT process_name) AS unique_processes FROM logs"))
def _(spark, sf):
    return logs(spark, sf).agg(
        F.count(F.lit(1)).alias("total_logs"), F.countDistinct("host_name").alias("unique_hosts"),
        F.countDistinct("user_name").alias("unique_users"), F.countDistinct("process_name").alias("unique_processes"))


@query("agg17_top_list_terms", on_logs(
    "SELECT trim(item, '''\" ') AS value, count(*) AS n FROM (SELECT unnest(string_split(trim(tags_text, '[]''\"'), "
    "''', ''')) AS item FROM logs WHERE tags_text IS NOT NULL) GROUP BY 1 ORDER BY n DESC, value LIMIT 15"))
def _(spark, sf):
    return agg.top_list_terms(logs(spark, sf), "tags_text")


@query("agg17_top_files", on_logs(
    "SELECT file_name AS value, count(*) AS n FROM logs WHERE file_name IS NOT NULL GROUP BY 1 "
    "ORDER BY n DESC, value LIMIT 15"))
def _(spark, sf):
    return agg.top_list_terms(logs(spark, sf), "file_name")


_LISTED = ["tags_text", "host_ip", "user_name", "host_name", "source_ip", "destination_ip", "event_category", "event_action", "event_outcome",
           "event_kind", "process_name", "parent_name", "file_name"]


@query("agg17_all_list_columns", on_logs("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS INTEGER) AS rank FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS field, trim(item, '\'\'\" ') AS value, count(*) AS n FROM (SELECT unnest(string_split(trim({c}, '[]\'\'\"'), "
    f"'\'\', \'\'')) AS item FROM logs WHERE {c} IS NOT NULL) GROUP BY ALL" for c in _LISTED) + ")) WHERE rank <= 15"))
def _(spark, sf):
    return agg.many_list_terms(logs(spark, sf), _LISTED)


@query("agg18_value_distribution", on_logs(
    "SELECT event_outcome AS value, count(*) AS n FROM logs WHERE event_outcome IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return agg.value_counts(logs(spark, sf), "event_outcome")


@query("agg19_timeline", logs_hours("SELECT ts FROM logs"))
def _(spark, sf):
    df = logs(spark, sf)
    return agg.time_histogram(df, "ts", agg.timeline_interval(df, "ts"))


@query("agg19_timeline_short", on_logs("").rstrip() + (
    ", counted AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, count(*) AS n FROM logs "
    "WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 12:00:00' GROUP BY 1), "
    "buckets AS (SELECT unnest(generate_series((SELECT min(bucket) FROM counted), (SELECT max(bucket) FROM counted), "
    "INTERVAL 10 MINUTE)) AS bucket) SELECT bucket, coalesce(n, 0) AS n FROM buckets LEFT JOIN counted USING (bucket)"))
def _(spark, sf):
    df = logs(spark, sf).filter(time_range(F.col("ts"), "2024-01-05 00:00:00", "2024-01-06 12:00:00"))
    return agg.time_histogram(df, "ts", agg.timeline_interval(df, "ts"))


@query("agg21_threat_summary", on_levels("SELECT threat_level AS value, count(*) AS n FROM levels GROUP BY 1"))
def _(spark, sf):
    return agg.value_counts(levels(spark, sf), "threat_level")


@query("agg22_process_tree", on_logs(
    "SELECT parent_name, process_name, count(*) AS n FROM logs WHERE parent_name <> process_name "
    "GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 25"))
def _(spark, sf):
    return agg.edge_counts(logs(spark, sf), "parent_name", "process_name", 25)


@query("agg23_user_process", on_logs(
    "SELECT user_name, process_name, count(*) AS n FROM logs WHERE user_name IS NOT NULL AND process_name IS NOT NULL "
    "GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 50"))
def _(spark, sf):
    return agg.edge_counts(logs(spark, sf), "user_name", "process_name", 50, self_edges=True)


@query("agg24_top_host_ips", on_logs(
    "SELECT ip, count(*) AS n FROM (SELECT unnest(string_split(host_ip, ', ')) AS ip FROM logs WHERE host_ip IS NOT NULL) "
    "WHERE ip NOT IN ('127.0.0.1', '::1') GROUP BY 1 ORDER BY n DESC, ip LIMIT 10"))
def _(spark, sf):
    return agg.top_addresses(logs(spark, sf), "host_ip")


@query("agg24_top_event_ips", on_logs(
    "SELECT source_ip AS ip, count(*) AS n FROM logs WHERE source_ip IS NOT NULL AND source_ip NOT IN ('127.0.0.1', '::1') "
    "GROUP BY 1 ORDER BY n DESC, ip LIMIT 10"))
def _(spark, sf):
    return agg.top_addresses(logs(spark, sf), "source_ip")


@query("agg25_hourly_with_ip", on_logs(
    "SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM logs WHERE host_ip IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return agg.time_histogram(logs(spark, sf).filter(F.col("host_ip").isNotNull()), "ts", "1h", fill=False)


@query("agg26_anomalous_ips", on_levels(
    "SELECT ip, threat_level, count(*) AS n FROM (SELECT unnest(string_split(host_ip, ', ')) AS ip, threat_level "
    "FROM levels WHERE is_anomaly AND host_ip IS NOT NULL) WHERE ip NOT IN ('127.0.0.1', '::1') GROUP BY 1, 2 "
    "ORDER BY n DESC, 1, 2 LIMIT 20"))
def _(spark, sf):
    rows = agg.address_items(levels(spark, sf).filter("is_anomaly"), "host_ip")
    return rows.groupBy("ip", "threat_level").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "ip", "threat_level").limit(20)


@query("agg27_score_histogram", on_scored(
    "SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * w, 6) AS low, round(lo + (b.bin + 1) * w, 6) AS high, "
    "count(s.k) AS n FROM (SELECT unnest(range(20)) AS bin) b CROSS JOIN e LEFT JOIN (SELECT "
    "least(floor((anomaly_score - lo) / w), 19) AS k FROM scored, e) s ON s.k = b.bin GROUP BY b.bin, lo, w",
    e="SELECT min(anomaly_score) AS lo, (max(anomaly_score) - min(anomaly_score)) / 20 AS w FROM scored"))
def _(spark, sf):
    out = agg.value_histogram(scored(logs(spark, sf)), "anomaly_score", 20)
    return out.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query("agg28_anomalies_per_host", on_scored(
    "SELECT host_name AS value, count(*) AS n FROM scored WHERE is_anomaly AND host_name IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return agg.value_counts(scored(logs(spark, sf)).filter("is_anomaly"), "host_name").orderBy(F.col("n").desc(), "value")


@query("agg28_anomalies_per_user", on_scored(
    "SELECT user_name AS value, count(*) AS n FROM scored WHERE is_anomaly AND user_name IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return agg.value_counts(scored(logs(spark, sf)).filter("is_anomaly"), "user_name").orderBy(F.col("n").desc(), "value")


# All columns of the log view; those of a namespace by their dotted names.
_SPACES = ("host", "user", "event", "process", "parent", "network", "file", "source", "destination")
_PROFILED = {(c.replace("_", ".", 1) if c.split("_")[0] in _SPACES else c): c for c in LOG_COLUMNS}


def _space(name: str) -> str:
    return name.split(".")[0] if "." in name else "_root"


def _profile_sql() -> str:
    rest = sorted({_space(c) for c in _PROFILED} - set(NAMESPACE_ORDER))
    places = [*NAMESPACE_ORDER, *rest]
    ordered = sorted(_PROFILED, key=lambda c: (places.index(_space(c)), c))
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{_space(c)}' AS namespace, '{c}' AS \"column\", (SELECT count({_PROFILED[c]}) FROM logs) AS non_null, "
        f"(SELECT round(count({_PROFILED[c]}) * 100.0e0 / count(*), 1) FROM logs) AS fill_pct, "
        f"(SELECT count(DISTINCT {_PROFILED[c]}) FROM logs) AS distinct_values, "
        f"(SELECT string_agg(v || '=' || n, '|' ORDER BY n DESC, full_v) FROM (SELECT substring(CAST({_PROFILED[c]} AS VARCHAR), 1, 80) AS v, "
        f"CAST({_PROFILED[c]} AS VARCHAR) AS full_v, count(*) AS n FROM logs WHERE {_PROFILED[c]} IS NOT NULL GROUP BY ALL "
        f"ORDER BY n DESC, full_v LIMIT 5)) AS top_values" for i, c in enumerate(ordered))


@query("agg29_schema_profile", on_logs(_profile_sql()))
def _(spark, sf):
    df = logs(spark, sf).select(*[F.col(column).alias(name) for name, column in _PROFILED.items()])
    return agg.schema_profile(df, NAMESPACE_ORDER)


_DESCRIBED = ["value", "user_id"]


@query("agg30_describe_features", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
    f"round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, "
    f"round((count(*) - count({c})) * 100e0 / count(*), 1) AS null_pct FROM e" for c in _DESCRIBED
).join(["WITH e AS (SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value, user_id FROM events) ", ""]))
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 9 != 0, F.col("value")))
    return agg.describe_features(df, _DESCRIBED)


@query("agg31_scoring_summary", on_scored(
    "SELECT count(*) AS n_total, count(*) FILTER (WHERE is_anomaly) AS n_anomalies, "
    "round(count(*) FILTER (WHERE is_anomaly) * 100e0 / greatest(count(*), 1), 2) AS anomaly_rate_pct, "
    "round(avg(anomaly_score), 4) AS mean_score, round(max(anomaly_score), 4) AS max_score FROM scored"))
def _(spark, sf):
    return agg.scoring_summary(scored(logs(spark, sf)))


@query("agg32_heat_map", on_scored(
    "SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, " + ", ".join(
        f"round(coalesce(avg(anomaly_score) FILTER (WHERE hour(ts) = {h}), 0), 6) AS \"{h}\"" for h in range(24))
    + " FROM scored GROUP BY 1"))
def _(spark, sf):
    df = scored(logs(spark, sf)).select(
        F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour"), "anomaly_score")
    out = agg.heat_map(df, "hour", "weekday", F.col("anomaly_score"), range(24))
    return out.select("weekday", *[F.round(f"`{h}`", 6).alias(str(h)) for h in range(24)])


@query("agg33_top_for_display", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", "value").orderBy(F.col("value").desc(), "event_id").limit(20)


@query("agg34_safe_percentage", on_logs(
    "SELECT host_name, round(CASE WHEN count(network_bytes) = 0 THEN 0 ELSE "
    "count(*) FILTER (WHERE network_direction = 'outbound') * 100e0 / count(network_bytes) END, 2) AS outbound_pct "
    "FROM logs WHERE host_name IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    out = F.count(F.when(F.col("network_direction") == "outbound", 1))
    return logs(spark, sf).filter("host_name IS NOT NULL").groupBy("host_name").agg(
        percentage(out, F.count("network_bytes")).alias("outbound_pct"))


@query("prj12_observed_types", on_raw(
    "SELECT field, type, count(*) AS n FROM (SELECT 'event' AS field, 'OBJECT' AS type FROM raw_logs WHERE event <> 'oops' "
    + "".join(
        f"UNION ALL SELECT 'event.{k}', 'STRING' FROM raw_logs WHERE event <> 'oops' " for k in ("kind", "category", "action"))
    + "UNION ALL SELECT 'event.tags', 'ARRAY' FROM raw_logs WHERE event <> 'oops' "
    "UNION ALL SELECT 'event.ok', CASE WHEN contains(lower(event), ': true') THEN 'BOOLEAN' ELSE 'VOID' END FROM raw_logs "
    "WHERE event <> 'oops') GROUP BY 1, 2"))
def _(spark, sf):
    from ..operators.flatten import observed_types, parse_dict_text
    from ..sources.logs import raw_logs

    df = raw_logs(spark, sf).select(parse_dict_text(F.col("event")).alias("event"))
    return observed_types(df, "event")
