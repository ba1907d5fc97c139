"""Time, text and number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    BASE64_RUN,
    COMMAND_KEYWORDS,
    DOWNLOAD_COMMAND,
    ENCODED_COMMAND,
    EPSILON,
    HIDDEN_COMMAND,
    SCORE_LEVEL_REST,
    SCORE_LEVELS,
    SEVERITY_DEFAULT,
    SEVERITY_NUMBERS,
    SUSPICIOUS_COMMAND,
)

# Accepted timestamp shapes: date with optional time, T or blank between, fraction and zone after T only.
_TIMESTAMP_SHAPE = (
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    r"(T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}((\.[0-9]{1,6})?Z|[+-][0-9]{2}:?[0-9]{2})?"
    r"| [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})?$"
)


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (null counts as not holding)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


# --- time ------------------------------------------------------------------------
def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def weekday_of(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def is_night(ts: Column) -> Column:
    return (F.hour(ts) < 6) | (F.hour(ts) >= 22)


def is_business_hour(ts: Column) -> Column:
    return F.hour(ts).between(9, 17)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since the epoch, reading zone-free values as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def parse_timestamp(text: Column) -> Column:
    """UTC time (zone-free) of a text in one of the accepted shapes, else null."""
    trimmed = F.trim(text)
    zoned = F.regexp_replace(trimmed, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    zoned = F.when(trimmed.contains("T"), zoned).otherwise(trimmed)
    return F.when(trimmed.rlike(_TIMESTAMP_SHAPE), zoned.try_cast("timestamp")).cast("timestamp_ntz")


def to_iso(ts: Column) -> Column:
    """ISO text in UTC ending in Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# --- text ------------------------------------------------------------------------
def suspicious_command(command: Column) -> Column:
    return F.coalesce(command.rlike(SUSPICIOUS_COMMAND), F.lit(False))


def has_base64_run(text: Column) -> Column:
    return F.coalesce(text.rlike(BASE64_RUN), F.lit(False))


def first_keyword(text: Column, words: list[str] = COMMAND_KEYWORDS) -> Column:
    """First word of the ordered list contained in the text, ignoring case."""
    lowered = F.lower(text)
    found = F.lit(None).cast("string")
    for word in reversed(words):
        found = F.when(lowered.contains(word.lower()), F.lit(word)).otherwise(found)
    return found


def command_families(command: Column) -> dict[str, Column]:
    """The three families of dangerous command lines: encoded, download, hidden."""
    lowered = F.lower(F.coalesce(command, F.lit("")))
    return {
        "encoded": lowered.rlike(ENCODED_COMMAND),
        "download": lowered.rlike(DOWNLOAD_COMMAND),
        "hidden": lowered.rlike(HIDDEN_COMMAND),
    }


def tactic_of(tag: Column) -> Column:
    """Attack tag without its namespace; null for other tags."""
    return F.when(tag.startswith("attack."), F.replace(tag, F.lit("attack."), F.lit("")))


# --- numbers ---------------------------------------------------------------------
def severity_number(severity: Column) -> Column:
    lowered = F.lower(severity.cast("string"))
    table = F.create_map(*[F.lit(part) for pair in SEVERITY_NUMBERS.items() for part in pair])
    return F.coalesce(table[F.coalesce(lowered, F.lit(""))], F.lit(SEVERITY_DEFAULT))


def score_level(score: Column) -> Column:
    expr = F.lit(SCORE_LEVEL_REST)
    for name, bound in reversed(SCORE_LEVELS):
        expr = F.when(score >= bound, F.lit(name)).otherwise(expr)
    return expr


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def safe_ratio(part: Column, whole: Column) -> Column:
    """Ratio whose denominator never reaches zero."""
    return part / (whole + F.lit(EPSILON))


def percentage(part: Column, total: Column, digits: int = 2) -> Column:
    """Share in percent, 0 when there is nothing to share."""
    return F.when(total == 0, F.lit(0.0)).otherwise(
        F.round(part.cast("double") / F.when(total != 0, total) * F.lit(100.0), digits)
    )


def finite(value: Column) -> Column:
    """Infinities and NaN become null."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)
