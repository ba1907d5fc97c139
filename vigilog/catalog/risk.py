"""RSK and WIN7: pillars, fold over the user's past, report."""

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import features_behaviour as beh
from ..operators import risk
from ..sources.logs import SCORE_SQL, afterwards, spread_logs
from .features import BEHAVIOUR_SQL, on_batch, state_of
from .registry import query
from .windows import FAILED_SQL

_U, _I, _P = BEHAVIOUR_SQL["user"], BEHAVIOUR_SQL["ip"], BEHAVIOUR_SQL["process"]
_WORDS = ["-enc", "-ExecutionPolicy Bypass", "wget", "curl", "Invoke-WebRequest", "/etc/shadow", "chmod 777"]
_KEYWORD = "CASE " + " ".join(f"WHEN contains(lower(cmd), lower('{w}')) THEN '{w}'" for w in _WORDS) + " END"
RISK_CTES = {
    "f": f"SELECT *, {SCORE_SQL} AS conf, {_U['user_is_new']} AS new_user, {_I['ip_is_new']} AS new_ip, "
         f"{_P['process_suspicious_cmd']} AS odd, {_U['user_failed_login_ratio']} AS ratio, {FAILED_SQL} AS failed, "
         "coalesce(user_name, 'unknown') AS who, coalesce(command_line, '') AS cmd, "
         "row_number() OVER (ORDER BY ts, doc_id) AS rn FROM b",
    "g": f"SELECT *, regexp_matches(cmd, '([A-Za-z0-9+/]{{30,}}={{0,2}})') AS b64, {_KEYWORD} AS keyword, "
         "coalesce(destination_port IN (4444, 3389, 22, 23), false) AS bad_port, "
         "coalesce(host_name LIKE 'DC-%' OR host_name LIKE 'PROD-%', false) AS asset, "
         "coalesce(sum(failed) OVER (PARTITION BY who ORDER BY rn RANGE BETWEEN 1000 PRECEDING AND 1 PRECEDING), 0) AS recent FROM f",
    "p": "SELECT *, conf * 100e0 AS ml_pillar, least(100e0, CASE WHEN new_user > 0 THEN 30e0 ELSE 0e0 END + "
         "CASE WHEN new_ip > 0 THEN 20e0 ELSE 0e0 END + CASE WHEN odd > 0 THEN 50e0 ELSE 0e0 END + "
         "CASE WHEN ratio > 0.5e0 THEN 40e0 ELSE 0e0 END) AS behaviour_pillar, "
         "least(100e0, CASE WHEN b64 THEN 60e0 ELSE 0e0 END + CASE WHEN keyword IS NOT NULL THEN 40e0 ELSE 0e0 END + "
         "CASE WHEN bad_port THEN 30e0 ELSE 0e0 END) AS intel_pillar, CASE WHEN asset THEN 50e0 ELSE 0e0 END AS asset_points, "
         "CASE WHEN failed = 0 AND recent >= 3 THEN 80e0 ELSE 0e0 END AS temporal_pillar, "
         "row_number() OVER (PARTITION BY who ORDER BY ts, doc_id) AS k FROM g",
}
_RISK_OF = ("least(greatest(0.25e0 * ml_pillar + 0.2e0 * behaviour_pillar + 0.25e0 * intel_pillar + "
            "0.15e0 * least(100e0, asset_points + CASE WHEN {past} > 80 THEN 40e0 ELSE 0e0 END) + 0.15e0 * temporal_pillar, 0e0), 100e0)")
_CALM, _TENSE = _RISK_OF.format(past="0e0"), _RISK_OF.format(past="100e0")
_FOLD = (
    f", q AS (SELECT *, {_CALM} AS calm, {_TENSE} AS tense FROM p), "
    "fold(doc_id, who, k, past, risk, mean) AS (SELECT doc_id, who, k, 0e0, calm, calm * 0.9e0 + calm * 0.1e0 FROM q WHERE k = 1 "
    "UNION ALL SELECT q.doc_id, q.who, q.k, fold.mean, CASE WHEN fold.mean > 80 THEN q.tense ELSE q.calm END, "
    "fold.mean * 0.9e0 + (CASE WHEN fold.mean > 80 THEN q.tense ELSE q.calm END) * 0.1e0 "
    "FROM fold JOIN q ON q.who = fold.who AND q.k = fold.k + 1), "
    "r AS (SELECT q.*, past, risk, mean, least(100e0, asset_points + CASE WHEN past > 80 THEN 40e0 ELSE 0e0 END) AS history_pillar, "
    "CASE WHEN risk >= 80 THEN 'Critical' WHEN risk >= 60 THEN 'High' WHEN risk >= 40 THEN 'Medium' WHEN risk >= 20 THEN 'Low' "
    "ELSE 'Info' END AS risk_level FROM q JOIN fold USING (doc_id)) "
)


def on_risk(tail: str) -> str:
    return on_batch("", **RISK_CTES).replace("WITH logs", "WITH RECURSIVE logs", 1).rstrip() + _FOLD + tail


def featured(spark, sf):
    df = spread_logs(spark, sf)
    ready = beh.behaviour_features(afterwards(df), state_of(df), ["user", "ip", "process"])
    return ready.withColumn("ml_confidence", F.expr(SCORE_SQL))


def pillars(spark, sf):
    return risk.with_pillars(featured(spark, sf), afterwards(spread_logs(spark, sf)))


def _pillar(key, column):
    @query(key, on_batch(f"SELECT doc_id, round({column}, 6) AS {column} FROM p", **RISK_CTES))
    def _(spark, sf):
        return pillars(spark, sf).select("doc_id", F.round(column, 6).alias(column))


_pillar("rsk1_ml_pillar", "ml_pillar")
_pillar("rsk2_behaviour_pillar", "behaviour_pillar")
_pillar("rsk3_intel_pillar", "intel_pillar")
_pillar("rsk5_temporal_pillar", "temporal_pillar")


@query("rsk4_history_pillar", on_risk("SELECT doc_id, history_pillar FROM r"))
def _(spark, sf):
    return risk.scored_risk(featured(spark, sf)).select("doc_id", "history_pillar")


@query("win7_user_risk_fold", on_risk(
    "SELECT doc_id, round(past, 6) AS past_risk, round(risk, 6) AS final_risk, round(mean, 6) AS user_risk FROM r"))
def _(spark, sf):
    return risk.scored_risk(featured(spark, sf)).select(
        "doc_id", *[F.round(c, 6).alias(c) for c in ("past_risk", "final_risk", "user_risk")])


@query("rsk6_risk_score", on_risk(
    "SELECT doc_id, CAST(floor(risk) AS INTEGER) AS risk_score, risk_level, CAST(floor(conf * 100) AS INTEGER) AS confidence FROM r"))
def _(spark, sf):
    return risk.scored_risk(featured(spark, sf)).select("doc_id", "risk_score", "risk_level", "confidence")


def _detail(*cases: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} END" for c in cases) + "], lambda x: x IS NOT NULL), ', ')"


_BEHAVIOUR = _detail("new_user > 0 THEN 'New user detection'", "new_ip > 0 THEN 'New IP detection'",
                     "odd > 0 THEN 'Suspicious command structure'", "ratio > 0.5e0 THEN 'High failed login ratio'")
_INTEL = _detail("b64 THEN 'Base64 payload detected'", "keyword IS NOT NULL THEN concat('Suspicious keyword: ', keyword)",
                 "bad_port THEN concat('Suspicious port connection: ', destination_port)")
_PAST = _detail("asset THEN 'Target is a highly critical asset'", "past > 80 THEN 'User has a history of high-risk behavior'")
_CONTRIBUTORS = (
    "array_to_string(list_transform(list_sort(list_filter(["
    "CASE WHEN ml_pillar > 60 THEN {'s': -ml_pillar, 'i': 0, 'n': 'Machine Learning', 'd': 'High ML ensemble anomaly confidence.'} END, "
    f"CASE WHEN behaviour_pillar > 0 THEN {{'s': -behaviour_pillar, 'i': 1, 'n': 'Behavioural', 'd': {_BEHAVIOUR}}} END, "
    f"CASE WHEN intel_pillar > 0 THEN {{'s': -intel_pillar, 'i': 2, 'n': 'Threat Intelligence', 'd': {_INTEL}}} END, "
    f"CASE WHEN history_pillar > 0 THEN {{'s': -history_pillar, 'i': 3, 'n': 'Historical Context', 'd': {_PAST}}} END, "
    "CASE WHEN temporal_pillar > 0 THEN {'s': -temporal_pillar, 'i': 4, 'n': 'Temporal Correlation', 'd': 'Brute-force success pattern'} END], "
    "lambda x: x IS NOT NULL)), lambda x: concat(x.n, ' ', CAST(round(-x.s * 100) AS BIGINT), ': ', x.d)), ' > ')"
)
_REASONS = (
    "list_filter([CASE WHEN ml_pillar > 60 THEN 'was flagged by multiple ML anomaly detection models' END, "
    "CASE WHEN new_user > 0 THEN 'logged in as a completely new user' END, "
    "CASE WHEN new_ip > 0 THEN 'originated from a previously unseen IP address' END, "
    "CASE WHEN odd > 0 THEN 'executed an obfuscated or suspicious command' END, "
    "CASE WHEN ratio > 0.5e0 THEN 'triggered multiple authentication failures' END, "
    "CASE WHEN b64 THEN 'utilized a Base64 encoded payload' END, "
    "CASE WHEN keyword IS NOT NULL THEN concat('executed known suspicious command ''', keyword, '''') END, "
    "CASE WHEN bad_port THEN concat('connected to sensitive port ', destination_port) END, "
    "CASE WHEN asset THEN 'targeted a critical production asset' END, "
    "CASE WHEN past > 80 THEN 'is an account with a history of severe security violations' END, "
    "CASE WHEN temporal_pillar > 0 THEN 'successfully authenticated immediately following a brute-force sequence' END], "
    "lambda x: x IS NOT NULL)"
)
_REPORT = (
    f"SELECT doc_id, {_CONTRIBUTORS} AS contributors, "
    f"array_to_string(list_filter([CASE WHEN b64 THEN '{K.TECHNIQUE_BASE64}' END, CASE WHEN keyword IS NOT NULL THEN '{K.TECHNIQUE_KEYWORD}' END, "
    f"CASE WHEN bad_port THEN '{K.TECHNIQUE_PORT}' END, CASE WHEN asset THEN '{K.TECHNIQUE_ASSET}' END, CASE WHEN temporal_pillar > 0 THEN '{K.TECHNIQUE_BRUTE_FORCE}' END], "
    "lambda x: x IS NOT NULL), ',') AS mitre, "
    "CASE WHEN b64 THEN 'Isolate endpoint immediately' WHEN keyword IS NOT NULL THEN 'Review process tree' "
    "WHEN bad_port THEN 'Block port at firewall' WHEN asset THEN 'Escalate to Tier 3 Incident Response' "
    "WHEN temporal_pillar > 0 THEN 'Force password reset and revoke active sessions' ELSE 'Standard log review' END "
    "AS recommended_action, CASE WHEN len(points) = 0 THEN "
    "'Event occurred within normal baseline parameters with no significant threat indicators.' "
    "WHEN len(points) = 1 THEN concat('Risk increased because the activity ', points[1], '.') "
    "ELSE concat('Risk increased because the activity ', array_to_string(points[1:len(points) - 1], ', '), ', and ', "
    f"points[len(points)], '.') END AS explanation FROM (SELECT *, {_REASONS} AS points FROM r)"
)


@query("rsk7_risk_report", on_risk(_REPORT))
def _(spark, sf):
    out = risk.with_report(risk.scored_risk(featured(spark, sf)))
    return out.select(
        "doc_id", F.array_join(F.transform("contributors", lambda c: F.concat(
            c["pillar"], F.lit(" "), F.round(c["score"] * 100).cast("bigint").cast("string"), F.lit(": "), c["detail"])), " > ").alias("contributors"),
        F.array_join("mitre", ",").alias("mitre"),
        "recommended_action", "explanation")


