"""INV: investigation reports."""

from pyspark.sql import functions as F

from ..operators.rules import SAMPLE_RULES, rule_table, tactic_counts
from ..plans import reports as rep
from ..sources.logs import SCORE_SQL, logs, scored
from .paging import levels, on_levels
from .registry import on_logs, on_scored, query
from .rules import matches, on_matches, on_threats, threats

_SCORED = f"SELECT *, {SCORE_SQL} AS s, ({SCORE_SQL}) > 0.95e0 AS is_anomaly FROM logs"


@query("inv1_session_overview", on_threats(
    "SELECT (SELECT count(*) FROM logs) AS rows, (SELECT min(ts) FROM logs) AS first_ts, (SELECT max(ts) FROM logs) AS last_ts, "
    "(SELECT count(*) FROM sc WHERE is_anomaly) AS anomalies, (SELECT round(count(*) FILTER (WHERE is_anomaly) * 100e0 / count(*), 2) "
    "FROM sc) AS anomaly_rate_pct, (SELECT round(max(s), 4) FROM sc) AS max_score, count(*) AS alerts, "
    + ", ".join(f"count(*) FILTER (WHERE risk_level = '{lv}') AS {lv.lower()}" for lv in ("Critical", "High", "Medium", "Low"))
    + " FROM threats", sc=_SCORED))
def _(spark, sf):
    df = logs(spark, sf)
    return rep.session_overview(df, scored(df), threats(spark, sf))


@query("inv1_top_entities", on_logs(
    "SELECT field, value, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS INTEGER) AS rank "
    "FROM (SELECT 'source_ip' AS field, source_ip AS value, count(*) AS n FROM logs WHERE source_ip IS NOT NULL GROUP BY 2 "
    "UNION ALL SELECT 'user', user_name, count(*) FROM logs WHERE user_name IS NOT NULL GROUP BY 2 "
    "UNION ALL SELECT 'host', host_name, count(*) FROM logs WHERE host_name IS NOT NULL GROUP BY 2)) WHERE rank <= 5"))
def _(spark, sf):
    return rep.overview_entities(logs(spark, sf))


_ENTITY = {
    "per_entity": "SELECT user_name AS value, count(*) AS n, coalesce(max(t.threat_score), 0) AS max_threat FROM logs "
                  "LEFT JOIN (SELECT doc_id, threat_score FROM threats) t USING (doc_id) WHERE user_name IS NOT NULL GROUP BY 1"}


@query("inv2_entity_table", on_threats(
    "SELECT *, max_threat >= 60 AS high_risk FROM per_entity ORDER BY n DESC, value LIMIT 15", **_ENTITY))
def _(spark, sf):
    return rep.top_entities(logs(spark, sf), threats(spark, sf), "user_name")


@query("inv2_high_risk_share", on_threats(
    "SELECT count(*) AS entities, count(*) FILTER (WHERE max_threat >= 60) AS high_risk, "
    "round(count(*) FILTER (WHERE max_threat >= 60) * 100e0 / count(*), 2) AS high_risk_pct FROM per_entity", **_ENTITY))
def _(spark, sf):
    return rep.high_risk_share(logs(spark, sf), threats(spark, sf), "user_name")


@query("inv3_score_composition", on_threats(
    "SELECT count(*) FILTER (WHERE rule_points > 0 AND ml_points = 0) AS rule_only, count(*) FILTER (WHERE ml_points > 0 AND "
    "rule_points = 0) AS ml_only, count(*) FILTER (WHERE rule_points > 0 AND ml_points > 0) AS both_parts FROM threats"))
def _(spark, sf):
    return rep.score_composition(threats(spark, sf))


@query("inv4_top_rules", on_matches(
    "SELECT title, level, count(*) AS hits FROM matches GROUP BY 1, 2 ORDER BY hits DESC, title LIMIT 10"))
def _(spark, sf):
    return rep.top_rules(matches(logs(spark, sf)), rule_table(spark, SAMPLE_RULES))


@query("inv5_tactic_hints", on_matches(
    "SELECT replace(tag, 'attack.', '') AS tactic, count(*) AS n, CASE WHEN tag LIKE '%initial_access%' THEN "
    "'check external-facing services' WHEN tag LIKE '%lateral%' THEN 'trace internal network pivots' WHEN tag LIKE '%exfil%' "
    "THEN 'check outbound data transfers' WHEN tag LIKE '%persistence%' THEN 'check scheduled tasks, startup items' END AS hint "
    "FROM (SELECT unnest(tags) AS tag FROM matches) GROUP BY 1, 3"))
def _(spark, sf):
    return rep.tactic_hints(tactic_counts(matches(logs(spark, sf)), SAMPLE_RULES))


@query("inv6_top_anomalies", on_scored(
    "SELECT doc_id, ts, round(anomaly_score, 4) AS anomaly_score FROM scored ORDER BY scored.anomaly_score DESC, doc_id LIMIT 5"))
def _(spark, sf):
    return scored(logs(spark, sf)).orderBy(F.col("anomaly_score").desc(), "doc_id").limit(5).select(
        "doc_id", "ts", F.round("anomaly_score", 4).alias("anomaly_score"))


@query("inv6_anomaly_band", on_scored(
    "SELECT r AS rate_pct, CASE WHEN r > 10 THEN 'high' WHEN r > 3 THEN 'moderate' ELSE 'low' END AS band FROM "
    "(SELECT round(count(*) FILTER (WHERE is_anomaly) * 100e0 / count(*), 2) AS r FROM scored)"))
def _(spark, sf):
    return rep.anomaly_band(scored(logs(spark, sf)))


_DETAIL = ["doc_id", "ts", "risk_level", "threat_score", "rule_points", "ml_points", "user_name", "host_name", "source_ip",
           "event_category", "command_line", "explanation"]


@query("inv7_top_event", on_threats(
    f"SELECT {', '.join(_DETAIL)} FROM threats ORDER BY threat_score DESC, doc_id LIMIT 1"))
def _(spark, sf):
    return rep.event_detail(threats(spark, sf), _DETAIL)


@query("inv7_event_by_id", on_threats(
    f"SELECT {', '.join(_DETAIL)} FROM threats WHERE doc_id = (SELECT min(doc_id) FROM threats WHERE rule_points > 0)"))
def _(spark, sf):
    found = threats(spark, sf)
    wanted = found.filter("rule_points > 0").agg(F.min("doc_id")).first()[0]
    return rep.event_detail(found, _DETAIL, wanted)


@query("inv8_priority_alerts", on_threats(
    "SELECT doc_id, risk_level, threat_score, explanation FROM threats WHERE risk_level IN ('Critical', 'High') "
    "ORDER BY threat_score DESC, doc_id LIMIT 5"))
def _(spark, sf):
    return rep.priority_alerts(threats(spark, sf), 5).select("doc_id", "risk_level", "threat_score", "explanation")


@query("inv9_digest", on_levels(
    "SELECT 'level' AS part, threat_level AS name, count(*) AS n, CAST(NULL AS VARCHAR) AS command FROM levels GROUP BY 2 "
    "UNION ALL SELECT 'anomalies', 'all', count(*) FILTER (WHERE is_anomaly), NULL FROM levels UNION ALL "
    "SELECT * FROM (SELECT 'critical', doc_id, CAST(NULL AS BIGINT), CASE WHEN length(coalesce(command_line, 'none')) > 200 THEN "
    "concat(substring(command_line, 1, 200), '...') ELSE coalesce(command_line, 'none') END FROM levels "
    "WHERE threat_level IN ('Critical', 'High Threat') ORDER BY anomaly_score DESC, doc_id LIMIT 5)"))
def _(spark, sf):
    return rep.digest(levels(spark, sf))
