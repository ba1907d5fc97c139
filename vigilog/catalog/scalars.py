"""FUN: scalar functions."""

from pyspark.sql import functions as F

from ..functions import net, scalar
from ..operators.features_behaviour import port_entropy
from ..operators.features_local import category_codes
from ..sources.logs import logs, scored, table
from .features import PRIVATE, _SEVERITY, _SRC_OCTET, _class
from ..operators.rules import SAMPLE_RULES, with_rule_details
from .registry import on_logs, on_scored, query
from .rules import matches, on_matches

COL = F.col


@query("fun1_private_ip", on_logs(f"SELECT doc_id, ({PRIVATE}) = 1 AS private FROM logs"))
def _(spark, sf):
    return logs(spark, sf).select("doc_id", net.is_private_ip(COL("source_ip")).alias("private"))


@query("fun2_ip_class", on_logs(f"SELECT doc_id, {_class(_SRC_OCTET)} AS class FROM logs"))
def _(spark, sf):
    return logs(spark, sf).select("doc_id", net.ip_class(COL("source_ip")).alias("class"))


@query("fun3_first_octet", on_logs(f"SELECT doc_id, {_SRC_OCTET} AS octet FROM logs"))
def _(spark, sf):
    return logs(spark, sf).select("doc_id", net.first_octet(COL("source_ip")).alias("octet"))


@query("fun4_severity_number", on_logs(f"SELECT doc_id, {_SEVERITY} AS severity FROM logs"))
def _(spark, sf):
    return logs(spark, sf).select("doc_id", scalar.severity_number(COL("event_severity")).alias("severity"))


@query("fun5_time_parts", (
    "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(day(ts) AS INTEGER) AS day, "
    "CAST(month(ts) AS INTEGER) AS month, isodow(ts) >= 6 AS weekend, hour(ts) < 6 OR hour(ts) >= 22 AS night, "
    "hour(ts) BETWEEN 9 AND 17 AS business FROM events"))
def _(spark, sf):
    ts = COL("ts")
    return table(spark, sf, "events").select(
        "event_id", scalar.hour_of(ts).alias("hour"), scalar.weekday_of(ts).alias("weekday"), F.dayofmonth(ts).alias("day"),
        F.month(ts).alias("month"), scalar.is_weekend(ts).alias("weekend"), scalar.is_night(ts).alias("night"),
        scalar.is_business_hour(ts).alias("business"))


@query("fun6_night_by_hours", (
    "SELECT event_id, hour(ts) IN (22, 23, 0, 1, 2, 3, 4, 5) AS night, round(hour(ts) / 24e0, 6) AS day_part FROM events"))
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", scalar.is_night(COL("ts")).alias("night"), F.round(F.hour("ts") / 24.0, 6).alias("day_part"))


@query("fun7_iso_round_trip", (
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_trunc('second', ts) AS back FROM events"))
def _(spark, sf):
    iso = scalar.to_iso(COL("ts"))
    return table(spark, sf, "events").select("event_id", iso.alias("iso"), scalar.parse_timestamp(iso).alias("back"))


@query("fun10_suspicious_command", (
    "SELECT doc_id, regexp_matches(text, '(?i)([A-Za-z0-9+/]{20,}={0,2}|-enc|-ExecutionPolicy\\s+Bypass|-nop|-hidden|iex|"
    "Invoke-WebRequest|wget|curl)') AS odd FROM documents"))
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalar.suspicious_command(COL("text")).alias("odd"))


@query("fun11_base64_run", "SELECT doc_id, regexp_matches(text, '([A-Za-z0-9+/]{30,}={0,2})') AS run FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalar.has_base64_run(COL("text")).alias("run"))


@query("fun12_first_keyword", on_logs(
    "SELECT doc_id, CASE WHEN contains(lower(command_line), '-enc') THEN '-enc' WHEN contains(lower(command_line), "
    "'-executionpolicy bypass') THEN '-ExecutionPolicy Bypass' WHEN contains(lower(command_line), 'wget') THEN 'wget' "
    "WHEN contains(lower(command_line), 'curl') THEN 'curl' WHEN contains(lower(command_line), 'invoke-webrequest') THEN "
    "'Invoke-WebRequest' END AS keyword FROM logs"))
def _(spark, sf):
    return logs(spark, sf).select("doc_id", scalar.first_keyword(COL("command_line")).alias("keyword"))


@query("fun13_command_families", on_logs(
    "SELECT doc_id, regexp_matches(c, 'base64|encodedcommand|-enc |iex |invoke-expression') AS encoded, "
    "regexp_matches(c, 'wget|curl|downloadstring|bitstransfer') AS download, "
    "regexp_matches(c, '-w hidden|-windowstyle hidden|bypass') AS hidden FROM (SELECT doc_id, lower(coalesce(command_line, '')) AS c FROM logs)"))
def _(spark, sf):
    return logs(spark, sf).select("doc_id", *[
        test.alias(name) for name, test in scalar.command_families(COL("command_line")).items()])


@query("fun14_numbers", (
    "SELECT event_id, round(ln(1 + value), 6) AS log_value, round(least(greatest(value, 5e0), 20e0), 6) AS clipped, "
    "round(value / (user_id + 1e-9), 6) AS ratio FROM events"))
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.round(F.log1p("value"), 6).alias("log_value"), F.round(scalar.clip(COL("value"), 5, 20), 6).alias("clipped"),
        F.round(scalar.safe_ratio(COL("value"), COL("user_id")), 6).alias("ratio"))


@query("fun15_entropy", on_logs(
    "SELECT source_ip, round(CASE WHEN count(destination_port) > 1 THEN ln(sum(n)) - sum(n * ln(n)) / sum(n) ELSE 0e0 END, 6) AS entropy "
    "FROM (SELECT source_ip, destination_port, count(*) AS n FROM logs WHERE source_ip IS NOT NULL AND destination_port IS NOT NULL "
    "GROUP BY 1, 2) GROUP BY 1"))
def _(spark, sf):
    df = logs(spark, sf).filter("destination_port IS NOT NULL")
    return port_entropy(df, "source_ip", "destination_port", "entropy").select(
        "source_ip", F.round("entropy", 6).alias("entropy"))


@query("fun18_category_codes", on_logs(
    "SELECT user_name, dense_rank() OVER (ORDER BY user_name) - 1 AS code FROM "
    "(SELECT DISTINCT coalesce(user_name, 'unknown') AS user_name FROM logs)"))
def _(spark, sf):
    return category_codes(logs(spark, sf), "user_name", "code").drop("_key_rows")


@query("fun19_min_max_scaling", (
    "SELECT event_id, round((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - "
    "(SELECT min(value) FROM events) + 1e-9), 6) AS scaled FROM events"))
def _(spark, sf):
    from ..operators.detectors.scaling import min_max

    return min_max(table(spark, sf, "events").select("event_id", "value"), "value", "scaled").select(
        "event_id", F.round("scaled", 6).alias("scaled"))


@query("fun20_tactic_of_tag", on_matches(
    "SELECT doc_id, replace(tag, 'attack.', '') AS tactic FROM (SELECT doc_id, unnest(tags) AS tag FROM matches)"))
def _(spark, sf):
    found = with_rule_details(matches(logs(spark, sf)), SAMPLE_RULES).select("doc_id", F.explode("tags").alias("tag"))
    return found.select("doc_id", scalar.tactic_of(COL("tag")).alias("tactic"))


@query("fun21_score_level", on_scored(
    "SELECT doc_id, CASE WHEN s >= 80 THEN 'Critical' WHEN s >= 60 THEN 'High' WHEN s >= 40 THEN 'Medium' WHEN s >= 20 THEN 'Low' "
    "ELSE 'Info' END AS level FROM (SELECT doc_id, anomaly_score * 100 AS s FROM scored)"))
def _(spark, sf):
    return scored(logs(spark, sf)).select("doc_id", scalar.score_level(COL("anomaly_score") * 100).alias("level"))
