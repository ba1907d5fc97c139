"""JON: look-ups and joins between results."""

from pyspark.sql import functions as F

from ..operators import lookup
from ..operators.rules import SAMPLE_RULES, with_rule_details
from ..sources.logs import opening, afterwards, logs, scores, table
from .registry import on_logs, query
from .rules import MATCH_CTES, matches, on_threats, threats
from ..sources.logs import SCORE_SQL


@query("jon1_aggregate_look_back", (
    "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey) AS supplier_rows, "
    "max(l_quantity) OVER (PARTITION BY l_suppkey) AS supplier_max FROM lineitem"))
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return lookup.attach(df, "l_suppkey", {
        "supplier_rows": F.count(F.lit(1)), "supplier_max": F.max("l_quantity")}).drop("l_suppkey", "l_quantity")


@query("jon1_look_back_many_keys", (
    "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS order_rows FROM lineitem"))
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return lookup.attach(df, "l_orderkey", {"order_rows": F.count(F.lit(1))}, broadcast_keys=1_000)


@query("jon2_events_with_matches", on_logs(
    "SELECT logs.doc_id, rule_id FROM logs LEFT JOIN matches USING (doc_id)", **MATCH_CTES))
def _(spark, sf):
    df = logs(spark, sf)
    return df.select("doc_id").join(matches(df), "doc_id", "left")


@query("jon3_events_with_scores", on_logs(
    f"SELECT doc_id, CASE WHEN event_no % 3 = 0 THEN 0e0 ELSE round({SCORE_SQL}, 9) END AS anomaly_score FROM logs"))
def _(spark, sf):
    df = logs(spark, sf)
    some = scores(df.filter(F.col("event_no") % 3 != 0))
    return lookup.left_with_default(df.select("doc_id"), some, "doc_id", {"anomaly_score": 0.0}).withColumn(
        "anomaly_score", F.round("anomaly_score", 9))


@query("jon5_matches_events_rules", on_logs("SELECT doc_id, host_name, title, level FROM matches", **MATCH_CTES))
def _(spark, sf):
    df = logs(spark, sf)
    found = with_rule_details(matches(df), SAMPLE_RULES)
    return df.select("doc_id", "host_name").join(found, "doc_id").select("doc_id", "host_name", "title", "level")


@query("jon6_membership", on_logs(
    "SELECT doc_id, CASE WHEN source_ip IS NOT NULL AND source_ip NOT IN (SELECT source_ip FROM logs WHERE source_ip IS NOT NULL "
    "AND ts < TIMESTAMP '2024-01-01 12:00:00') THEN 1e0 ELSE 0e0 END AS fresh FROM logs WHERE ts >= TIMESTAMP '2024-01-01 12:00:00'"))
def _(spark, sf):
    df = logs(spark, sf).select("doc_id", "source_ip", "ts")
    known = opening(df).filter("source_ip IS NOT NULL").select("source_ip")
    return lookup.new_key_flag(afterwards(df), "source_ip", known, "fresh").select("doc_id", "fresh")


@query("jon7_counts_with_max_threat", on_threats(
    "SELECT host_name AS value, count(*) AS n, coalesce(max(t.threat_score), 0) AS max_threat FROM logs "
    "LEFT JOIN (SELECT doc_id, threat_score FROM threats) t USING (doc_id) WHERE host_name IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    from ..plans.reports import entity_counts_with_threat

    df = logs(spark, sf)
    return entity_counts_with_threat(df, threats(spark, sf), "host_name")
