"""CLN: cleaning steps, the full run and its report."""

from pyspark.sql import functions as F

from ..operators import cleaning as cl
from ..sources.logs import LOG_COLUMNS, logs, table
from .registry import on_logs, query

_DT = "CASE WHEN ts_text IN ('', 'bad') THEN NULL ELSE TIMESTAMP '2024-01-02 03:04:05' END"


@query("cln1_parse_time", on_logs(f"SELECT doc_id, ts_text, {_DT} AS ts_text_dt FROM logs"))
def _(spark, sf):
    return cl.add_parsed_time(logs(spark, sf).select("doc_id", "ts_text"), "ts_text")


@query("cln1_parse_counts", on_logs(
    "SELECT count(*) FILTER (WHERE ts_text NOT IN ('', 'bad')) AS parsed, "
    "count(*) FILTER (WHERE ts_text IN ('', 'bad')) AS errors FROM logs"))
def _(spark, sf):
    return cl.time_parse_counts(logs(spark, sf), "ts_text")


@query("cln1_time_formats", (
    "SELECT event_id, date_trunc('second', ts) AS text_dt FROM events"))
def _(spark, sf):
    ts = F.col("ts")
    zoned = F.concat(F.date_format(ts + F.expr("INTERVAL 90 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0130"))
    text = (
        F.when(F.col("event_id") % 4 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 4 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.000000'Z'")).otherwise(zoned)
    )
    return cl.add_parsed_time(table(spark, sf, "events").select("event_id", text.alias("text")), "text").drop("text")


@query("cln2_numeric_coercion", on_logs("SELECT doc_id, host_name, TRY_CAST(bytes_text AS DOUBLE) AS bytes_text FROM logs"))
def _(spark, sf):
    return cl.coerce_numbers(logs(spark, sf).select("doc_id", "host_name", "bytes_text"))[0]


_NULL_COLUMNS = list(LOG_COLUMNS)


@query("cln3_null_profile", on_logs(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, round((count(*) - count({c})) * 1e0 / count(*), 4) "
    "AS null_share FROM logs" for c in _NULL_COLUMNS)))
def _(spark, sf):
    return cl.null_profile(logs(spark, sf).select(*_NULL_COLUMNS))


@query("cln4_drop_sparse", on_logs("SELECT doc_id, user_name FROM logs"))
def _(spark, sf):
    df = logs(spark, sf).select("doc_id", "user_name", F.when(F.col("event_no") % 50 == 0, "x").alias("rare"))
    return cl.drop_sparse(df, 0.95)


@query("cln5_fill_default", on_logs(
    "SELECT doc_id, coalesce(user_name, '<missing>') AS user_name, coalesce(network_bytes, 0) AS network_bytes FROM logs"))
def _(spark, sf):
    return cl.handle_missing(logs(spark, sf).select("doc_id", "user_name", "network_bytes"), "fill_default")


@query("cln5_drop_rows", on_logs(
    "SELECT doc_id, user_name, network_bytes FROM logs WHERE user_name IS NOT NULL AND network_bytes IS NOT NULL"))
def _(spark, sf):
    return cl.handle_missing(logs(spark, sf).select("doc_id", "user_name", "network_bytes"), "drop")


def with_copies(df):
    return df.unionByName(df.filter(F.col("event_no") % 100 == 7))


@query("cln6_duplicates_all_columns", on_logs("SELECT doc_id, ts, user_name FROM logs"))
def _(spark, sf):
    return cl.deduplicate(with_copies(logs(spark, sf)).select("doc_id", "ts", "user_name"))


@query("cln6_duplicates_by_key", on_logs(
    "SELECT host_name, event_action, doc_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY host_name, event_action "
    "ORDER BY ts, doc_id) AS r FROM logs) WHERE r = 1"))
def _(spark, sf):
    df = with_copies(logs(spark, sf)).select("host_name", "event_action", "doc_id", "ts")
    return cl.deduplicate(df, ["host_name", "event_action"], ["ts", "doc_id"])


def _fields(condition: str) -> str:
    """How many of the reported columns meet a condition on their counts."""
    return "CAST(" + " + ".join(f"(CASE WHEN {condition.format(c=c)} THEN 1 ELSE 0 END)" for c in _REPORT) + " AS BIGINT)"


_REPORT = ["doc_id", "event_no", "user_name", "network_bytes", "file_name", "ts_text"]


@query("cln7_quality_report", on_logs(
    "SELECT count(*) AS input_count, (SELECT count(*) FROM logs) AS output_count, "
    "count(*) - (SELECT count(*) FROM logs) AS duplicates_removed, (SELECT count(*) FROM (DESCRIBE SELECT " + ", ".join(_REPORT) + " FROM logs)) AS total_fields, "
    "" + _fields("count({c}) = 0") + " AS fully_null_fields, " + _fields("count({c}) > 0 AND round((count(*) - count({c})) * 1e0 / count(*), 4) >= 0.5e0") + " AS high_null_fields, "
    "round((SELECT count(*) FROM logs) * 100e0 / count(*), 1) AS retention_rate, "
    "round(100e0 - (" + " + ".join(f"round((count(*) - count({c})) * 1e0 / count(*), 4)" for c in _REPORT)
    + ") / 6 * 100, 1) AS coverage_score, "
    "round((count(*) - (SELECT count(*) FROM logs)) * 100e0 / count(*), 1) AS dedup_rate FROM c",
    c="SELECT * FROM logs UNION ALL SELECT * FROM logs WHERE event_no % 100 = 7"))
def _(spark, sf):
    raw = with_copies(logs(spark, sf)).select(*_REPORT)
    return cl.quality_report(raw, cl.deduplicate(raw))


_FREQ = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN count(*) OVER (PARTITION BY {c}) END AS _feat_{label}_batch_freq"
    for c, label in (("host_name", "hostname"), ("user_name", "username"), ("source_ip", "src_ip")))


@query("cln8_full_cleaning", on_logs(
    f"SELECT doc_id, ts_text, TRY_CAST(bytes_text AS DOUBLE) AS bytes_text, user_name AS username, {_DT} AS ts_text_dt, "
    f"CAST(hour({_DT}) AS INTEGER) AS _feat_hour, CAST(isodow({_DT}) - 1 AS INTEGER) AS _feat_day_of_week, "
    f"hour({_DT}) < 6 OR hour({_DT}) >= 22 AS _feat_is_night, {_FREQ} FROM logs"))
def _(spark, sf):
    from ..plans.cleaning import cleaning_run

    df = with_copies(logs(spark, sf)).select(
        "event_no", "doc_id", "ts_text", "bytes_text", "user_name", "host_name", "source_ip", F.lit("x").alias("_index"),
        F.when(F.col("event_no") % 50 == 0, "x").alias("rare"))
    plan = cl.CleaningPlan(time_column="ts_text", renames={"user_name": "username"}, dedup_keys=["doc_id"])
    return cleaning_run(df, plan).features.select(
        "doc_id", "ts_text", "bytes_text", "username", "ts_text_dt", "_feat_hour", "_feat_day_of_week", "_feat_is_night",
        "_feat_hostname_batch_freq", "_feat_username_batch_freq", "_feat_src_ip_batch_freq")
