"""Threat level by precedence, and the unified score of rules and anomalies."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ANOMALY_THRESHOLD,
    EPSILON,
    LIVING_OFF_THE_LAND,
    PRIVILEGED_USERS,
    RULE_LEVEL_POINTS,
    RULE_LEVEL_RANK,
)
from ..functions.fields import field
from ..functions.scalar import command_families, score_level
from .lookup import left_with_default

if TYPE_CHECKING:
    from .rules import Rule


def threat_level(df: DataFrame, anomaly: Column | None = None) -> Column:
    """Level of an event; the strongest reason is tested first."""
    anomaly = F.coalesce(F.col("is_anomaly") if anomaly is None else anomaly, F.lit(False))
    command, user, process = (field(df, n) for n in ("command_line", "username", "process_name"))
    level = F.lit("Normal")
    if process is not None:
        tool = F.lower(process).isin(LIVING_OFF_THE_LAND)
        level = F.when(tool & anomaly, "High Threat").when(tool, "Suspicious").otherwise(level)
    if user is not None:
        level = F.when(user.isin(PRIVILEGED_USERS) & anomaly, "Critical").otherwise(level)
    if command is not None:
        families = command_families(command)
        dangerous = families["encoded"] | families["download"] | families["hidden"]
        level = F.when(dangerous, "Critical").otherwise(level)
    return level


def with_threat_level(df: DataFrame) -> DataFrame:
    return df.withColumn("threat_level", threat_level(df))


def anomaly_points(score: Column, threshold: float = ANOMALY_THRESHOLD) -> Column:
    """0 to 40 points for scores from the threshold to 1."""
    share = (score - F.lit(threshold)) / F.lit(1.0 - threshold + EPSILON)
    return F.when(score >= threshold, F.floor(share * 40)).otherwise(0).cast("int")


def level_points(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RULE_LEVEL_POINTS.items() for x in pair])
    return F.coalesce(table[F.lower(level)], F.lit(0))


def level_rank(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in RULE_LEVEL_RANK.items() for x in pair])
    return F.coalesce(table[F.lower(level)], F.lit(-1))


def explain_threat(rule_points: Column, titles: Column, points: Column, raw: Column, total: Column) -> Column:
    """Readable reason for a unified score."""
    word = (
        F.when(rule_points == 80, "Critical").when(rule_points == 60, "High")
        .when(rule_points == 40, "Medium").otherwise("Low")
    )
    by_rule = F.when(rule_points > 0, F.concat(
        F.lit("matched "), word, F.lit("-severity Sigma rules ("), F.array_join(titles, ", "),
        F.lit(") contributing "), rule_points.cast("string"), F.lit(" pts")))
    by_score = F.when(points > 0, F.concat(
        F.lit("exhibited high behavioral anomaly (score: "), F.format_string("%.2f", raw),
        F.lit(") contributing "), points.cast("string"), F.lit(" pts")))
    reason = F.concat_ws(" and ", by_rule, by_score)
    return F.when(reason == "", "No significant threat detected.").otherwise(F.concat(
        F.lit("Flagged with score "), total.cast("string"), F.lit("/100 because the event "), reason, F.lit(".")))


def scores_by_row(events: DataFrame, rules: Sequence[Rule], anomaly: Column, keep_zero: bool = False) -> DataFrame:
    """The same fusion where rules are predicates and the score is a column: one scan, no join and no shuffle."""
    hits = [rule.predicate(events) for rule in rules]
    points = [F.when(hit, level_points(F.lit(rule.level))).otherwise(0) for hit, rule in zip(hits, rules)]
    titles = F.array(*[F.when(hit, F.lit(rule.title)) for hit, rule in zip(hits, rules)])
    return _fused(events.withColumns({
        "rule_points": F.greatest(F.lit(0), *points), "rules": F.sort_array(F.array_distinct(F.array_compact(titles))),
        "anomaly_score": anomaly, "ml_points": anomaly_points(anomaly),
    }), keep_zero)


def unified_scores(events: DataFrame, matches: DataFrame, anomaly: DataFrame, keep_zero: bool = False) -> DataFrame:
    """Fuse rule matches (doc_id, title, level) and anomaly scores (doc_id, anomaly_score) per event.

    Matches are combined per event before the join: an event carries at most one row per rule.
    """
    per_event = matches.groupBy("doc_id").agg(
        F.max(level_points(F.col("level"))).alias("rule_points"),
        F.sort_array(F.collect_set("title")).alias("rules"),
    )
    joined = left_with_default(events.join(per_event, "doc_id", "left"), anomaly, "doc_id", {"anomaly_score": 0.0})
    scored = joined.withColumns({
        "rule_points": F.coalesce("rule_points", F.lit(0)),
        "rules": F.coalesce("rules", F.array().cast("array<string>")),
        "ml_points": anomaly_points(F.col("anomaly_score")),
    })
    return _fused(scored, keep_zero)


def _fused(scored: DataFrame, keep_zero: bool) -> DataFrame:
    """Total, level and explanation from the two kinds of points."""
    scored = scored.withColumn("threat_score", F.least(F.lit(100), F.col("rule_points") + F.col("ml_points")))
    scored = scored.withColumns({
        "risk_level": score_level(F.col("threat_score")),
        "explanation": explain_threat(
            F.col("rule_points"), F.col("rules"), F.col("ml_points"), F.col("anomaly_score"), F.col("threat_score")),
    })
    return scored if keep_zero else scored.filter(F.col("threat_score") > 0)
