"""RUL and THR: detection rules and unified threat scores."""

from pyspark.sql import functions as F

from ..operators import rules as rul
from ..operators.rules import SAMPLE_RULES
from ..operators.threat import scores_by_row, unified_scores
from ..sources.logs import SCORE_SQL, logs, scores
from .registry import on_logs, query

_R1 = "event_category = 'authentication' AND event_outcome = 'failure' AND event_kind = 'info'"
_R2 = "event_category = 'process' AND process_name IN ('cmd.exe', 'powershell.exe')"
_R3 = "event_category = 'network' AND network_direction = 'outbound' AND network_bytes > 1000000"
MATCH_CTES = {
    "matches": " UNION ALL ".join(
        f"SELECT doc_id, host_name, user_name, '{r.rule_id}' AS rule_id, '{r.title}' AS title, '{r.level}' AS level, {points} AS points, "
        f"{rank} AS rk, {list(r.tags)} AS tags FROM logs WHERE {sql}"
        for r, sql, points, rank in zip(SAMPLE_RULES, (_R1, _R2, _R3), (60, 80, 40), (3, 4, 2))),
}
_NOTE = "CASE WHEN {p} = 80 THEN 'Critical' WHEN {p} = 60 THEN 'High' WHEN {p} = 40 THEN 'Medium' ELSE 'Low' END".format(p="rule_points")
THREAT_CTES = {
    **MATCH_CTES,
    "per_event": "SELECT doc_id, max(points) AS rule_points, array_to_string(list_sort(list(title)), ', ') AS rules FROM matches GROUP BY 1",
    "both_": f"SELECT logs.*, coalesce(rule_points, 0) AS rule_points, coalesce(rules, '') AS rules, {SCORE_SQL} AS anomaly_score, "
             f"CASE WHEN ({SCORE_SQL}) >= 0.7e0 THEN CAST(floor((({SCORE_SQL}) - 0.7e0) / 0.300000001e0 * 40) AS INTEGER) ELSE 0 END "
             "AS ml_points FROM logs LEFT JOIN per_event USING (doc_id)",
    "threats": "SELECT *, least(100, rule_points + ml_points) AS threat_score, CASE WHEN least(100, rule_points + ml_points) >= 80 "
               "THEN 'Critical' WHEN least(100, rule_points + ml_points) >= 60 THEN 'High' WHEN least(100, rule_points + ml_points) >= 40 "
               "THEN 'Medium' WHEN least(100, rule_points + ml_points) >= 20 THEN 'Low' ELSE 'Info' END AS risk_level, "
               "concat('Flagged with score ', least(100, rule_points + ml_points), '/100 because the event ', concat_ws(' and ', "
               f"CASE WHEN rule_points > 0 THEN concat('matched ', {_NOTE}, '-severity Sigma rules (', rules, ') contributing ', "
               "rule_points, ' pts') END, CASE WHEN ml_points > 0 THEN concat('exhibited high behavioral anomaly (score: ', "
               "printf('%.2f', anomaly_score), ') contributing ', ml_points, ' pts') END), '.') AS explanation "
               "FROM both_ WHERE rule_points + ml_points > 0",
}


def on_matches(body: str) -> str:
    return on_logs(body, **MATCH_CTES)


def on_threats(body: str, **more: str) -> str:
    return on_logs(body, **THREAT_CTES, **more)


def matches(df, keep=("doc_id",)):
    return rul.match_rules(df, SAMPLE_RULES, keep)


def threats(spark, sf, df=None):
    df = logs(spark, sf) if df is None else df
    return scores_by_row(df, SAMPLE_RULES, F.expr(SCORE_SQL))


def joined_threats(spark, sf):
    """The form for matches and scores that come as tables."""
    df = logs(spark, sf)
    detailed = rul.with_rule_details(matches(df), SAMPLE_RULES)
    return unified_scores(df, detailed.select("doc_id", "title", "level"), scores(logs(spark, sf)))


@query("rul1_rule_predicate", on_logs(f"SELECT doc_id FROM logs WHERE {_R3}"))
def _(spark, sf):
    df = logs(spark, sf)
    return df.filter(SAMPLE_RULES[2].predicate(df)).select("doc_id")


@query("rul2_many_rules", on_matches("SELECT doc_id, rule_id FROM matches"))
def _(spark, sf):
    return matches(logs(spark, sf))


@query("rul3_totals", on_matches(
    "SELECT (SELECT count(*) FROM logs) AS input_hits, count(DISTINCT doc_id) AS matched_hits, count(*) AS total_triggers FROM matches"))
def _(spark, sf):
    return rul.match_totals(logs(spark, sf), SAMPLE_RULES)


@query("rul3_triggers_per_rule", on_matches("SELECT rule_id, count(*) AS n FROM matches GROUP BY 1"))
def _(spark, sf):
    return rul.triggers_per_rule(matches(logs(spark, sf)))


@query("rul4_severity_distribution", on_matches(
    "SELECT level, count(*) AS n FROM (SELECT doc_id, arg_max(level, rk) AS level FROM matches GROUP BY 1) GROUP BY 1"))
def _(spark, sf):
    return rul.severity_distribution(logs(spark, sf), SAMPLE_RULES)


@query("rul4_level_per_event", on_matches("SELECT doc_id, arg_max(level, rk) AS level FROM matches GROUP BY 1"))
def _(spark, sf):
    return rul.level_of_matches(rul.with_rule_details(matches(logs(spark, sf)), SAMPLE_RULES).select("doc_id", "level"))


@query("rul5_tactics", on_matches(
    "SELECT replace(tag, 'attack.', '') AS tactic, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM matches) GROUP BY 1"))
def _(spark, sf):
    return rul.tactic_counts(matches(logs(spark, sf)), SAMPLE_RULES)


@query("rul6_affected_hosts", on_matches(
    "SELECT host_name AS value, count(DISTINCT doc_id) AS n FROM matches WHERE host_name IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return rul.affected(logs(spark, sf), SAMPLE_RULES, "host_name")


@query("rul6_affected_users", on_matches(
    "SELECT user_name AS value, count(DISTINCT doc_id) AS n FROM matches WHERE user_name IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return rul.affected(logs(spark, sf), SAMPLE_RULES, "user_name")


@query("thr2_unified_score", on_threats("SELECT doc_id, rule_points, ml_points, threat_score FROM threats"))
def _(spark, sf):
    return threats(spark, sf).select("doc_id", "rule_points", "ml_points", "threat_score")


@query("thr2_unified_score_of_tables", on_threats("SELECT doc_id, rule_points, ml_points, threat_score FROM threats"))
def _(spark, sf):
    return joined_threats(spark, sf).select("doc_id", "rule_points", "ml_points", "threat_score")


@query("thr3_scored_levels", on_threats("SELECT doc_id, threat_score, risk_level FROM threats"))
def _(spark, sf):
    return threats(spark, sf).select("doc_id", "threat_score", "risk_level").orderBy(F.col("threat_score").desc(), "doc_id")


@query("thr4_explanations", on_threats("SELECT doc_id, rules, explanation FROM threats"))
def _(spark, sf):
    return threats(spark, sf).select("doc_id", F.array_join("rules", ", ").alias("rules"), "explanation")


@query("top8_threats_by_score", on_threats(
    "SELECT doc_id, threat_score, explanation FROM threats ORDER BY threat_score DESC, doc_id LIMIT 200"))
def _(spark, sf):
    return threats(spark, sf).select("doc_id", "threat_score", "explanation").orderBy(
        F.col("threat_score").desc(), "doc_id").limit(200)
