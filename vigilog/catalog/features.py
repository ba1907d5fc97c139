"""T, U, I, H, P, E, Q, B, C, L: the four feature frames."""

from pyspark.sql import functions as F

from ..operators import features_batch as fb
from ..operators import features_behaviour as beh
from ..operators import features_clean as fc
from ..operators import features_local as fl
from ..sources.logs import afterwards, logs, opening
from .registry import on_logs, query

SPLIT = "TIMESTAMP '2024-01-01 12:00:00'"
BATCH = {
    "seen": f"SELECT * FROM logs WHERE ts < {SPLIT}",
    "b0": f"SELECT * FROM logs WHERE ts >= {SPLIT}",
    "seen_users": "SELECT user_name, count(*) AS user_history FROM seen WHERE user_name IS NOT NULL GROUP BY 1",
    "seen_ips": "SELECT DISTINCT source_ip, true AS ip_seen FROM seen WHERE source_ip IS NOT NULL",
    "user_hosts": "SELECT user_name, count(DISTINCT host_name) AS user_hosts FROM b0 GROUP BY 1",
    "ip_users": "SELECT source_ip, count(DISTINCT user_name) AS ip_users, count(*) AS ip_n FROM b0 GROUP BY 1",
    "ip_ports": "SELECT source_ip, CASE WHEN count(*) > 1 THEN ln(sum(n)) - sum(n * ln(n)) / sum(n) ELSE 0e0 END AS port_entropy "
                "FROM (SELECT source_ip, destination_port, count(*) AS n FROM b0 WHERE destination_port IS NOT NULL GROUP BY 1, 2) "
                "GROUP BY 1",
    "b": "SELECT b0.*, user_history, ip_seen, user_hosts, ip_users, ip_n, port_entropy FROM b0 LEFT JOIN seen_users USING (user_name) "
         "LEFT JOIN seen_ips USING (source_ip) LEFT JOIN user_hosts USING (user_name) LEFT JOIN ip_users USING (source_ip) "
         "LEFT JOIN ip_ports USING (source_ip)",
}


def on_batch(body: str, **ctes: str) -> str:
    return on_logs(body, **BATCH, **ctes)


# Families that know no state are computed over all rows.
WHOLE = {"b0": "SELECT * FROM logs", "b": "SELECT * FROM b0"}


def state_of(df):
    early = opening(df)
    return beh.next_state(early, beh.EntityState())


def family(spark, sf, name):
    df = logs(spark, sf)
    out = beh.behaviour_features(afterwards(df), state_of(df), [name])
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith(beh.PREFIX)])


def whole_family(spark, sf, name):
    out = beh.behaviour_features(logs(spark, sf), beh.EntityState(), [name])
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith(beh.PREFIX)])


PRIVATE = (
    "CASE WHEN regexp_matches(source_ip, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') THEN "
    "CASE WHEN source_ip LIKE '10.%' OR source_ip LIKE '192.168.%' OR source_ip LIKE '198.18.%' THEN 1e0 ELSE 0e0 END "
    "WHEN source_ip = '::1' THEN 1e0 WHEN source_ip LIKE '2001:4860:%' THEN 0e0 END"
)

# SQL of every behaviour feature, by family.
BEHAVIOUR_SQL = {
    "time": {
        "time_hour": "hour(ts) / 24e0",
        "time_is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1e0 ELSE 0e0 END",
        "time_is_night": "CASE WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 1e0 ELSE 0e0 END",
        "time_since_last_event": (
            "CASE WHEN user_name IS NULL THEN 0e0 ELSE least(greatest(coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER "
            "(PARTITION BY user_name ORDER BY ts, doc_id)) / 1e6, 0e0), 0e0), 3600e0) END"),
    },
    "user": {
        "user_is_new": (
            "CASE WHEN user_name IS NOT NULL AND user_history IS NULL THEN 1e0 ELSE 0e0 END"),
        "user_burst_score": (
            "CASE WHEN user_name IS NULL THEN 1e0 ELSE count(*) OVER (PARTITION BY user_name) * 1e0 / "
            "(count(*) OVER (PARTITION BY user_name) + coalesce(user_history, 0)) END"),
        "user_failed_login_ratio": (
            "CASE WHEN user_name IS NULL THEN 0e0 ELSE avg(CASE WHEN lower(event_outcome) = 'failure' THEN 1e0 ELSE 0e0 END) "
            "OVER (PARTITION BY user_name) END"),
        "user_unique_hosts_accessed": (
            "CASE WHEN user_name IS NULL THEN 0e0 ELSE CAST(user_hosts AS DOUBLE) END"),
        "user_priv_escalation_flag": (
            "CASE WHEN lower(event_action) IN ('sudo', 'su', 'elevated', 'privilege_escalation') THEN 1e0 ELSE 0e0 END"),
    },
    "ip": {
        "ip_is_new": (
            "CASE WHEN source_ip IS NOT NULL AND ip_seen IS NULL THEN 1e0 ELSE 0e0 END"),
        "ip_rarity": (
            "CASE WHEN source_ip IS NULL THEN 1e0 ELSE 1e0 - ip_n * 1e0 / (SELECT count(source_ip) FROM b0) END"),
        "ip_unique_users": (
            "CASE WHEN source_ip IS NULL THEN 0e0 ELSE CAST(ip_users AS DOUBLE) END"),
        "ip_is_private": f"coalesce({PRIVATE}, 0e0)",
        "ip_port_entropy": (
            "coalesce(port_entropy, 0e0)"),
        "ip_impossible_travel": "0e0",
    },
    "host": {
        "host_is_new": (
            "CASE WHEN host_name IS NOT NULL AND host_name NOT IN (SELECT host_name FROM seen WHERE host_name IS NOT NULL) "
            "THEN 1e0 ELSE 0e0 END"),
        "host_freq": (
            "CASE WHEN host_name IS NULL THEN 0e0 ELSE count(*) OVER (PARTITION BY host_name) * 1e0 / "
            "(SELECT count(host_name) FROM b0) END"),
        "host_rarity": (
            "CASE WHEN host_name IS NULL THEN 1e0 ELSE 1e0 - count(*) OVER (PARTITION BY host_name) * 1e0 / "
            "(SELECT count(host_name) FROM b0) END"),
    },
    "process": {
        "process_rarity": (
            "CASE WHEN process_name IS NULL THEN 1e0 ELSE 1e0 - count(*) OVER (PARTITION BY process_name) * 1e0 / "
            "(SELECT count(process_name) FROM b0) END"),
        "process_is_script_engine": (
            "CASE WHEN lower(process_name) IN ('powershell.exe', 'pwsh.exe', 'cmd.exe', 'bash', 'sh', 'zsh', "
            "'wscript.exe', 'cscript.exe') THEN 1e0 ELSE 0e0 END"),
        "process_parent_child_rarity": (
            "1e0 - count(*) OVER (PARTITION BY coalesce(parent_name, 'nan'), coalesce(process_name, 'nan')) * 1e0 / "
            "count(*) OVER ()"),
        "process_suspicious_cmd": (
            "CASE WHEN regexp_matches(command_line, '(?i)([A-Za-z0-9+/]{20,}={0,2}|-enc|-ExecutionPolicy\\s+Bypass|-nop|"
            "-hidden|iex|Invoke-WebRequest|wget|curl)') THEN 1e0 ELSE 0e0 END"),
    },
    "event": {
        "event_category_rarity": (
            "CASE WHEN event_category IS NULL THEN 1e0 ELSE 1e0 - count(*) OVER (PARTITION BY event_category) * 1e0 / "
            "(SELECT count(event_category) FROM b0) END"),
        "event_is_file_mod": "CASE WHEN contains(lower(event_category), 'file') THEN 1e0 ELSE 0e0 END",
        "event_is_network": "CASE WHEN contains(lower(event_category), 'network') THEN 1e0 ELSE 0e0 END",
        "event_is_auth_failure": (
            "CASE WHEN regexp_matches(lower(event_action), 'auth|login|logon') AND contains(lower(event_outcome), 'fail') "
            "THEN 1e0 ELSE 0e0 END"),
    },
    "volume": {},
}


def family_sql(*names: str) -> str:
    return ", ".join(f"round({sql}, 6) AS _ml_{feature}" for n in names for feature, sql in BEHAVIOUR_SQL[n].items())


# Per-host volume: mean by recursion over the host's running count, deviation over its last ten counts.
VOLUME_CTES = {
    "counted": "SELECT doc_id, host_name, row_number() OVER (PARTITION BY host_name ORDER BY ts, doc_id) AS t FROM b "
               "WHERE host_name IS NOT NULL",
    "ranks": "SELECT unnest(range(1, (SELECT max(t) FROM counted) + 1)) AS t",
    "walk": "SELECT t, t AS x, stddev_samp(t) OVER (ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM ranks",
}
VOLUME_SQL = (
    ", mean(t, y) AS (SELECT CAST(1 AS BIGINT), 1e0 UNION ALL SELECT t + 1, y * 9 / 11 + (t + 1) * 2e0 / 11 FROM mean "
    "WHERE t < (SELECT max(t) FROM counted)), stat AS (SELECT w.t, y, coalesce(s, 0e0) AS s, (w.t - y) / (coalesce(s, 0e0) + 1e-9) AS z "
    "FROM walk w JOIN mean m ON w.t = m.t) "
)


def on_volume(tail: str, batch: dict[str, str] = BATCH) -> str:
    return on_logs("", **batch, **VOLUME_CTES).replace("WITH logs", "WITH RECURSIVE logs", 1).rstrip() + VOLUME_SQL + tail


_VOLUME_TAIL = (
    "SELECT b.doc_id, round(coalesce(y, 0e0), 6) AS _ml_stat_host_volume_ema, round(coalesce(s, 0e0), 6) AS "
    "_ml_stat_host_volume_std, round(coalesce(z, 0e0), 6) AS _ml_stat_host_volume_zscore FROM b "
    "LEFT JOIN counted c ON b.doc_id = c.doc_id LEFT JOIN stat ON stat.t = c.t"
)


def _register(key, name):
    @query(key, on_batch(f"SELECT doc_id, {family_sql(name)} FROM b"))
    def _(spark, sf):
        return family(spark, sf, name)


def _register_whole(key, name):
    @query(key, on_logs(f"SELECT doc_id, {family_sql(name)} FROM b", **WHOLE))
    def _(spark, sf):
        return whole_family(spark, sf, name)


_register_whole("t1_t4_time_features", "time")
_register("u1_u5_user_features", "user")
_register("i1_i6_address_features", "ip")
_register("h1_h3_host_features", "host")
_register_whole("p1_p4_process_features", "process")
_register_whole("e1_e3_event_features", "event")


@query("q1_host_volume", on_volume(_VOLUME_TAIL, WHOLE))
def _(spark, sf):
    return whole_family(spark, sf, "volume")


_FRAME_TAIL = (
    f"SELECT f.*, v.* EXCLUDE (doc_id) FROM (SELECT doc_id, {family_sql('time', 'user', 'ip', 'host', 'process', 'event')} FROM b) f "
    f"JOIN ({_VOLUME_TAIL}) v ON f.doc_id = v.doc_id")


@query("fx_feature_frame", on_volume(_FRAME_TAIL))
def _(spark, sf):
    df = logs(spark, sf)
    out = beh.behaviour_features(afterwards(df), state_of(df), beh.FAMILIES)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in out.columns if c.startswith(beh.PREFIX)])


@query("fx_state_after_batch", on_logs(
    "SELECT 'user' AS kind, user_name AS value, count(*) AS n FROM logs WHERE user_name IS NOT NULL GROUP BY 2 "
    "UNION ALL SELECT 'ip', source_ip, NULL FROM logs WHERE source_ip IS NOT NULL GROUP BY 2 "
    "UNION ALL SELECT 'host', host_name, NULL FROM logs WHERE host_name IS NOT NULL GROUP BY 2"))
def _(spark, sf):
    df = logs(spark, sf)
    state = beh.next_state(afterwards(df), state_of(df))
    none = F.lit(None).cast("long")
    users = state.users.join(state.user_counts, "user_name", "left")
    return (
        users.select(F.lit("user").alias("kind"), F.col("user_name").alias("value"), "n")
        .unionByName(state.addresses.select(F.lit("ip").alias("kind"), F.col("source_ip").alias("value"), none.alias("n")))
        .unionByName(state.hosts.select(F.lit("host").alias("kind"), F.col("host_name").alias("value"), none.alias("n")))
    )


# --- batch features --------------------------------------------------------------
_FAILURE = ("CASE WHEN lower(coalesce(event_outcome, '')) IN ('failure', 'fail', 'failed', 'error', 'denied', 'reject') "
            "THEN 1e0 ELSE 0e0 END")
_SEVERITY = ("CASE lower(coalesce(event_severity, '')) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 "
             "WHEN 'low' THEN 1 WHEN 'informational' THEN 0 WHEN 'info' THEN 0 WHEN 'debug' THEN -1 WHEN '4' THEN 4 "
             "WHEN '3' THEN 3 WHEN '2' THEN 2 WHEN '0' THEN 0 ELSE 1 END")
BATCH_CTES = {
    "hs": "SELECT host_name, count(*) AS n, count(DISTINCT user_name) AS users FROM logs WHERE host_name IS NOT NULL GROUP BY 1",
    "us": "SELECT user_name, count(*) AS n FROM logs WHERE user_name IS NOT NULL GROUP BY 1",
    "ss": f"SELECT source_ip, count(*) AS n, count(DISTINCT destination_ip) AS dsts, avg({_FAILURE}) AS fails, "
          "ln(1 + sum(coalesce(network_bytes, 0))) AS total_bytes, "
          f"any_value({PRIVATE}) AS private, TRY_CAST(split_part(source_ip, '.', 1) AS INTEGER) AS octet "
          "FROM logs WHERE source_ip IS NOT NULL GROUP BY 1",
    "sr": "SELECT *, 1e0 / (n * 1e0 / (SELECT sum(n) FROM ss)) AS r FROM ss",
    "sn": "SELECT *, (r - (SELECT min(r) FROM sr)) / ((SELECT max(r) FROM sr) - (SELECT min(r) FROM sr) + 1e-9) AS rarity FROM sr",
    "raw": "SELECT logs.*, CAST(hs.n AS DOUBLE) AS host_n, CAST(hs.users AS DOUBLE) AS host_users, CAST(us.n AS DOUBLE) AS user_n, "
           "CAST(sn.n AS DOUBLE) AS src_n, CAST(sn.dsts AS DOUBLE) AS dsts, sn.fails, sn.total_bytes, sn.private, "
           "CAST(sn.octet AS DOUBLE) AS octet, sn.rarity FROM logs LEFT JOIN hs USING (host_name) LEFT JOIN us USING (user_name) "
           "LEFT JOIN sn USING (source_ip)",
}


def _filled(name: str) -> str:
    return f"coalesce({name}, (SELECT median({name}) FROM raw))"


BATCH_SQL = {
    "hour": "CAST(hour(ts) AS DOUBLE)", "day_of_week": "isodow(ts) - 1e0",
    "is_night": "CASE WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 1e0 ELSE 0e0 END",
    "is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1e0 ELSE 0e0 END",
    "is_business_hours": "CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1e0 ELSE 0e0 END",
    "host_event_count": _filled("host_n"), "user_event_count": _filled("user_n"), "src_ip_event_count": _filled("src_n"),
    "src_unique_dst_ips": _filled("dsts"), "host_unique_users": _filled("host_users"), "src_ip_rarity": _filled("rarity"),
    "is_failure": _FAILURE, "src_failure_ratio": _filled("fails"), "severity_score": f"CAST({_SEVERITY} AS DOUBLE)",
    "src_is_private": _filled("private"), "src_first_octet": _filled("octet"),
    "dst_privileged_port": "CASE WHEN destination_port < 1024 THEN 1e0 ELSE 0e0 END",
    "bytes_log": "ln(1 + coalesce(network_bytes, 0))", "src_total_bytes_log": _filled("total_bytes"),
}


def batch_sql(names) -> str:
    return on_logs("SELECT doc_id, " + ", ".join(f"round({BATCH_SQL[n]}, 6) AS _ml_{n}" for n in names) + " FROM raw",
                   **BATCH_CTES)


def feature_matrix(spark, sf):
    """Event number and the batch features."""
    return fb.batch_features(logs(spark, sf)).select("event_no", "doc_id", "ts", *fb.FEATURES)


def _register_batch(key, names):
    @query(key, batch_sql(names))
    def _(spark, sf):
        return feature_matrix(spark, sf).select("doc_id", *[F.round(f"_ml_{n}", 6).alias(f"_ml_{n}") for n in names])


_register_batch("b1_b5_time", ["hour", "day_of_week", "is_night", "is_weekend", "is_business_hours"])
_register_batch("b6_b8_event_counts", ["host_event_count", "user_event_count", "src_ip_event_count"])
_register_batch("b9_b10_diversity", ["src_unique_dst_ips", "host_unique_users"])
_register_batch("b11_rarity", ["src_ip_rarity"])
_register_batch("b12_b13_failures", ["is_failure", "src_failure_ratio"])
_register_batch("b14_severity", ["severity_score"])
_register_batch("b15_b17_network", ["src_is_private", "src_first_octet", "dst_privileged_port"])
_register_batch("b18_b19_bytes", ["bytes_log", "src_total_bytes_log"])
_register_batch("b20_full_matrix", list(BATCH_SQL))


@query("agg30_describe_batch_features", on_logs(" UNION ALL ".join(
    f"SELECT '_ml_{n}' AS feature, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, "
    f"round(max(x), 4) AS max, 0e0 AS null_pct FROM (SELECT {BATCH_SQL[n]} AS x FROM raw)" for n in BATCH_SQL),
    **BATCH_CTES))
def _(spark, sf):
    from ..operators.aggregates import describe_features

    return describe_features(feature_matrix(spark, sf), [f"_ml_{n}" for n in BATCH_SQL])


# --- cleaning features -----------------------------------------------------------
@query("c1_time_features", on_logs(
    "SELECT doc_id, CAST(hour(ts) AS INTEGER) AS _feat_hour, CAST(isodow(ts) - 1 AS INTEGER) AS _feat_day_of_week, "
    "CAST(day(ts) AS INTEGER) AS _feat_day_of_month, CAST(month(ts) AS INTEGER) AS _feat_month, isodow(ts) >= 6 AS _feat_is_weekend, "
    "hour(ts) BETWEEN 9 AND 17 AS _feat_is_business_hours, hour(ts) < 6 OR hour(ts) >= 22 AS _feat_is_night FROM logs"))
def _(spark, sf):
    return fc.time_features(logs(spark, sf).select("doc_id", "ts"), "ts").drop("ts")


def _class(octet: str) -> str:
    return (f"CASE WHEN {octet} < 128 THEN 'A' WHEN {octet} < 192 THEN 'B' WHEN {octet} < 224 THEN 'C' "
            f"WHEN {octet} < 240 THEN 'D' WHEN {octet} IS NOT NULL THEN 'E' END")


_SRC_OCTET = "TRY_CAST(split_part(source_ip, '.', 1) AS INTEGER)"
_DST_OCTET = "TRY_CAST(split_part(destination_ip, '.', 1) AS INTEGER)"


@query("c2_address_features", on_logs(
    f"SELECT doc_id, ({PRIVATE}) = 1 AS _feat_src_ip_is_private, {_class(_SRC_OCTET)} AS _feat_src_ip_class, "
    f"{_SRC_OCTET} AS _feat_src_ip_first_octet, CASE WHEN destination_ip IS NOT NULL THEN true END AS _feat_dst_ip_is_private, "
    f"{_class(_DST_OCTET)} AS _feat_dst_ip_class, {_DST_OCTET} AS _feat_dst_ip_first_octet FROM logs"))
def _(spark, sf):
    return fc.address_features(logs(spark, sf).select("doc_id", "source_ip", "destination_ip")).drop(
        "source_ip", "destination_ip")


@query("c3_frequency_features", on_logs(
    "SELECT doc_id, " + ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN count(*) OVER (PARTITION BY {c}) END AS _feat_{label}_batch_freq"
        for c, label in (("host_name", "hostname"), ("user_name", "username"), ("source_ip", "src_ip"))) + " FROM logs"))
def _(spark, sf):
    return fc.frequency_features(logs(spark, sf).select("doc_id", "host_name", "user_name", "source_ip")).drop(
        "host_name", "user_name", "source_ip")


# --- local features --------------------------------------------------------------
@query("l1_time_features", on_logs(
    "SELECT doc_id, CAST(coalesce(hour(t), 12) AS INTEGER) AS hour, CAST(coalesce(isodow(t) - 1, 0) AS INTEGER) AS day_of_week, "
    "CASE WHEN coalesce(hour(t), 12) < 6 OR coalesce(hour(t), 12) >= 22 THEN 1 ELSE 0 END AS is_night, "
    "CASE WHEN coalesce(isodow(t), 1) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM "
    "(SELECT doc_id, CASE WHEN event_no % 10 <> 3 THEN ts END AS t FROM logs)"))
def _(spark, sf):
    df = logs(spark, sf).select("doc_id", F.when(F.col("event_no") % 10 != 3, F.col("ts")).alias("ts"))
    return fl.time_features(df).drop("ts")


def _code(c: str) -> str:
    return f"dense_rank() OVER (ORDER BY coalesce({c}, 'unknown')) - 1"


@query("l2_category_codes", on_logs(
    f"SELECT doc_id, {_code('host_name')} AS host_enc, {_code('user_name')} AS user_enc, {_code('process_name')} AS proc_enc, "
    f"{_code('event_action')} AS action_enc FROM logs"))
def _(spark, sf):
    return fl.local_features(logs(spark, sf)).select("doc_id", "host_enc", "user_enc", "proc_enc", "action_enc")


@query("l3_frequencies", on_logs(
    "SELECT doc_id, CASE WHEN host_name IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY host_name) END AS host_freq, "
    "CASE WHEN user_name IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY user_name) END AS user_freq, "
    "round(CASE WHEN process_name IS NULL THEN 0 ELSE 1e0 / (count(*) OVER (PARTITION BY process_name) + 1) END, 9) AS proc_rarity "
    "FROM logs"))
def _(spark, sf):
    from ..operators.lookup import profile_keys

    df = logs(spark, sf).select("doc_id", "host_name", "user_name", "process_name")
    out = fl.frequencies(df, df, profile_keys(df, ["host_name", "user_name", "process_name"]))
    return out.select("doc_id", "host_freq", "user_freq", F.round("proc_rarity", 9).alias("proc_rarity"))


@query("l4_sizes", on_logs(
    "SELECT doc_id, CAST(length(coalesce(command_line, '')) AS INTEGER) AS cmd_len, CAST(coalesce(args_count, 0) AS DOUBLE) AS "
    "args_count_num, CAST(coalesce(file_size, 0) AS DOUBLE) AS file_size_num, round(ln(1 + coalesce(file_size, 0)), 6) AS "
    "file_size_log FROM logs"))
def _(spark, sf):
    df = logs(spark, sf).select("doc_id", "command_line", "args_count", "file_size")
    return fl.sizes(df).select("doc_id", "cmd_len", "args_count_num", "file_size_num",
                               F.round("file_size_log", 6).alias("file_size_log"))
