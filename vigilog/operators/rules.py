"""Detection rules as predicates, many rules in one pass, and the report over the matches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import col_of, resolve
from ..functions.scalar import tactic_of
from .threat import level_rank

_COMPARE = {
    ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class Rule:
    """Named selections and how they combine.

    A selection maps fields to a value, a list (any of), or a pair like ``(">", 10)``; all fields of a
    selection must match. ``require`` lists selections that must all hold, ``any_of`` of which one must
    hold, ``exclude`` that must not hold.
    """

    rule_id: str
    title: str
    level: str
    selections: dict[str, dict[str, object]]
    require: Sequence[str] = ()
    any_of: Sequence[str] = ()
    exclude: Sequence[str] = ()
    tags: Sequence[str] = field(default_factory=tuple)
    status: str = "stable"
    ignore_case: bool = False

    def _test(self, column: Column, wanted: object) -> Column:
        if isinstance(wanted, tuple):
            sign, bound = wanted
            return _COMPARE[sign](column, F.lit(bound))
        values = wanted if isinstance(wanted, list) else [wanted]
        if self.ignore_case and all(isinstance(v, str) for v in values):
            return F.lower(column).isin([v.lower() for v in values])
        return column.isin(values)

    def _selection(self, df: DataFrame, name: str) -> Column:
        tests = []
        for logical, wanted in self.selections[name].items():
            column = resolve(df.columns, logical)
            tests.append(F.lit(False) if column is None else self._test(col_of(column), wanted))
        return reduce(lambda a, b: a & b, tests)

    def predicate(self, df: DataFrame) -> Column:
        parts = [self._selection(df, n) for n in self.require]
        if self.any_of:
            parts.append(reduce(lambda a, b: a | b, [self._selection(df, n) for n in self.any_of]))
        parts += [~F.coalesce(self._selection(df, n), F.lit(False)) for n in self.exclude]
        return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


# The three sample rules.
SAMPLE_RULES = [
    Rule(
        rule_id="11111111-2222-3333-4444-555555555555", title="Suspicious SSH Login Attempts", level="high",
        status="experimental", tags=("attack.credential_access", "attack.t1110"), require=("selection",),
        selections={"selection": {
            "event.category": "authentication", "event.outcome": "failure", "event.kind": "info"}},
    ),
    Rule(
        rule_id="66666666-7777-8888-9999-000000000000", title="Critical Process Execution", level="critical",
        tags=("attack.execution", "attack.t1059"), require=("selection",),
        selections={"selection": {"event.category": "process", "process.name": ["cmd.exe", "powershell.exe"]}},
    ),
    Rule(
        rule_id="aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee", title="Large Network Transfer", level="medium", status="test",
        tags=("attack.exfiltration", "attack.t1048"), require=("selection", "filter_bytes"),
        selections={
            "selection": {"event.category": "network", "network.direction": "outbound"},
            "filter_bytes": {"network.bytes": (">", 1000000)},
        },
    ),
]


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """The rules as a small table; its size is the number of rules."""
    rows = [(r.rule_id, r.title, r.level, r.status, list(r.tags)) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, title string, level string, status string, tags array<string>")


def match_rules(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per (event, matching rule): all predicates run in one scan, no shuffle."""
    hits = F.array_compact(F.array(*[F.when(r.predicate(df), F.lit(r.rule_id)) for r in rules]))
    return df.withColumn("_hits", hits).filter(F.size("_hits") > 0).select(
        *keep, F.explode("_hits").alias("rule_id")
    )


def with_rule_details(matches: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return matches.join(F.broadcast(rule_table(matches.sparkSession, rules)), "rule_id")


def match_totals(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Input rows, matched rows and triggers, in the matching scan itself."""
    count = reduce(lambda a, b: a + b, [r.predicate(df).cast("int") for r in rules])
    return df.select(count.alias("c")).agg(
        F.count(F.lit(1)).alias("input_hits"), F.count(F.when(F.col("c") > 0, 1)).alias("matched_hits"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("total_triggers"),
    )


def triggers_per_rule(matches: DataFrame) -> DataFrame:
    return matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def worst_level(df: DataFrame, rules: Sequence[Rule]) -> Column:
    """Highest level among the rules an event matches, read off the row itself."""
    expr = F.lit(None).cast("string")
    ranked = sorted(rules, key=lambda r: _rank(r.level))
    for rule in ranked:
        expr = F.when(rule.predicate(df), F.lit(rule.level)).otherwise(expr)
    return expr


def _rank(level: str) -> int:
    from ..constants import RULE_LEVEL_RANK

    return RULE_LEVEL_RANK.get(level.lower(), -1)


def severity_distribution(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Matched events by their highest level."""
    return df.select(worst_level(df, rules).alias("level")).filter(F.col("level").isNotNull()).groupBy("level").agg(
        F.count(F.lit(1)).alias("n"))


def tactic_counts(matches: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Attack tags per match. Matches are counted per rule before the tags multiply them."""
    per_rule = with_rule_details(triggers_per_rule(matches), rules)
    tagged = per_rule.select("n", F.explode("tags").alias("tag"))
    return tagged.select("n", tactic_of(F.col("tag")).alias("tactic")).filter(
        F.col("tactic").isNotNull()).groupBy("tactic").agg(F.sum("n").alias("n"))


def affected(df: DataFrame, rules: Sequence[Rule], entity: str) -> DataFrame:
    """Matched events per entity; an event counts once however many rules it matches."""
    hit = reduce(lambda a, b: a | b, [r.predicate(df) for r in rules])
    return df.filter(hit & F.col(entity).isNotNull()).groupBy(F.col(entity).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))


def level_of_matches(matches: DataFrame) -> DataFrame:
    """Highest level per event from a table of matches (doc_id, level)."""
    return matches.groupBy("doc_id").agg(F.max_by("level", level_rank(F.col("level"))).alias("level"))
