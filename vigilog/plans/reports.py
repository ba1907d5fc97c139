"""Investigation reports over logs, matches and threat scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import percentage
from ..operators.aggregates import many_top_terms
from ..operators.lookup import side_by_side

HIGH_RISK = 60


def entity_counts_with_threat(logs: DataFrame, threats: DataFrame, entity: str) -> DataFrame:
    """Events per entity and the highest threat among them; 0 when none was scored."""
    counts = logs.filter(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    worst = threats.filter(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("value")).agg(
        F.max("threat_score").alias("max_threat"))
    return counts.join(worst, "value", "left").withColumn("max_threat", F.coalesce("max_threat", F.lit(0)))


def top_entities(logs: DataFrame, threats: DataFrame, entity: str, n: int = 15) -> DataFrame:
    """The busiest entities with their highest threat and whether that is high."""
    table = entity_counts_with_threat(logs, threats, entity)
    return table.withColumn("high_risk", F.col("max_threat") >= HIGH_RISK).orderBy(
        F.col("n").desc(), "value").limit(n)


def high_risk_share(logs: DataFrame, threats: DataFrame, entity: str) -> DataFrame:
    """How many entities reach high risk, absolutely and in percent."""
    table = entity_counts_with_threat(logs, threats, entity)
    high = F.count(F.when(F.col("max_threat") >= HIGH_RISK, 1))
    total = F.count(F.lit(1))
    return table.agg(total.alias("entities"), high.alias("high_risk"), percentage(high, total).alias("high_risk_pct"))


def session_overview(logs: DataFrame, scored: DataFrame, threats: DataFrame) -> DataFrame:
    """One row: rows, time range, anomalies, alerts per level."""
    base = logs.agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    hits = F.count(F.when(F.col("is_anomaly"), 1))
    anomalies = scored.agg(
        hits.alias("anomalies"), percentage(hits, F.count(F.lit(1))).alias("anomaly_rate_pct"),
        F.round(F.max("anomaly_score"), 4).alias("max_score"))
    levels = threats.agg(F.count(F.lit(1)).alias("alerts"), *[
        F.count(F.when(F.col("risk_level") == level, 1)).alias(level.lower())
        for level in ("Critical", "High", "Medium", "Low")])
    return side_by_side([base, anomalies, levels])


def overview_entities(logs: DataFrame, n: int = 5) -> DataFrame:
    """Top source addresses, users and hosts in one scan."""
    return many_top_terms(logs, {"source_ip": "source_ip", "user": "user_name", "host": "host_name"}, n)


def score_composition(threats: DataFrame) -> DataFrame:
    """Alerts by origin: rules only, anomalies only, both."""
    rule, ml = F.col("rule_points") > 0, F.col("ml_points") > 0
    return threats.agg(
        F.count(F.when(rule & ~ml, 1)).alias("rule_only"), F.count(F.when(ml & ~rule, 1)).alias("ml_only"),
        F.count(F.when(rule & ml, 1)).alias("both_parts"))


def top_rules(matches: DataFrame, rules: DataFrame, n: int = 10) -> DataFrame:
    """Rules by hits."""
    counts = matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    return counts.join(F.broadcast(rules), "rule_id").select("title", "level", "hits").orderBy(
        F.col("hits").desc(), "title").limit(n)


# Parts of tactic names and the advice they lead to.
TACTIC_HINTS = [
    ("initial_access", "check external-facing services"),
    ("lateral", "trace internal network pivots"),
    ("exfil", "check outbound data transfers"),
    ("persistence", "check scheduled tasks, startup items"),
]


def tactic_hints(tactics: DataFrame) -> DataFrame:
    """Tactic counts with the first hint that fits the name."""
    hint = F.lit(None).cast("string")
    for part, text in reversed(TACTIC_HINTS):
        hint = F.when(F.col("tactic").contains(part), text).otherwise(hint)
    return tactics.withColumn("hint", hint)


def anomaly_band(scored: DataFrame) -> DataFrame:
    """Anomaly rate and its band."""
    hits = F.count(F.when(F.col("is_anomaly"), 1))
    rate = percentage(hits, F.count(F.lit(1)))
    return scored.agg(rate.alias("rate_pct")).withColumn(
        "band", F.when(F.col("rate_pct") > 10, "high").when(F.col("rate_pct") > 3, "moderate").otherwise("low"))


def event_detail(threats: DataFrame, columns: list[str], doc_id: str | None = None) -> DataFrame:
    """One event by id; the top threat when no id is given."""
    rows = threats if doc_id is None else threats.filter(F.col("doc_id") == doc_id)
    return rows.orderBy(F.col("threat_score").desc(), "doc_id").limit(1).select(*columns)


def priority_alerts(threats: DataFrame, n: int) -> DataFrame:
    """Top alerts among critical and high ones."""
    return threats.filter(F.col("risk_level").isin("Critical", "High")).orderBy(
        F.col("threat_score").desc(), "doc_id").limit(n)


def digest(levels: DataFrame, n: int = 5, width: int = 200) -> DataFrame:
    """Counts per threat level, the anomaly total and the top critical events, as one long table."""
    counts = levels.groupBy(F.col("threat_level").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("level").alias("part"), "name", "n", F.lit(None).cast("string").alias("command"))
    total = levels.agg(F.count(F.when(F.col("is_anomaly"), 1)).alias("n")).select(
        F.lit("anomalies").alias("part"), F.lit("all").alias("name"), "n", F.lit(None).cast("string").alias("command"))
    command = F.coalesce("command_line", F.lit("none"))
    cut = F.when(F.length(command) > width, F.concat(F.substring(command, 1, width), F.lit("..."))).otherwise(command)
    top = levels.filter(F.col("threat_level").isin("Critical", "High Threat")).orderBy(
        F.col("anomaly_score").desc(), "doc_id").limit(n).select(
        F.lit("critical").alias("part"), F.col("doc_id").alias("name"), F.lit(None).cast("long").alias("n"),
        cut.alias("command"))
    return counts.unionByName(total).unionByName(top)
