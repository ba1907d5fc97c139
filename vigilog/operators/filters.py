"""Predicates. Each function returns one column, so Catalyst can push it into the scan."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LOOPBACK
from ..functions.fields import col_of, resolve
from ..functions.scalar import finite

BIG_LIST = 1_000


def ntz(moment: str) -> Column:
    """A zone-free UTC timestamp literal."""
    return F.lit(moment).cast("timestamp_ntz")


def time_range(column: Column, start: str, end: str) -> Column:
    """Both ends inclusive."""
    return column.between(ntz(start), ntz(end))


def term(column: Column, value: object) -> Column:
    return column == F.lit(value)


def terms(column: Column, values: Iterable[object]) -> Column:
    return column.isin(list(values))


def terms_semi(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """In-list as a semi join once the list is too long for a literal predicate."""
    if len(values) <= BIG_LIST:
        return df.filter(terms(col_of(column), values))
    kind = df.schema[column].dataType
    table = df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` {kind.simpleString()}")
    return df.join(table.distinct(), column, "left_semi")


def match_text(column: Column, text: str) -> Column:
    """Any word of ``text`` occurs as a word of the field, ignoring case."""
    words = [w for w in re.split(r"\W+", text.lower()) if w]
    return F.arrays_overlap(F.split(F.lower(column), r"\W+"), F.array(*[F.lit(w) for w in words]))


def wildcard(column: Column, pattern: str) -> Column:
    """``*`` any run, ``?`` one character, everything else literal."""
    out = []
    for ch in pattern:
        out.append({"*": "%", "?": "_"}.get(ch, "\\" + ch if ch in "%_\\" else ch))
    return column.like("".join(out))


def exists(column: Column) -> Column:
    return column.isNotNull()


def combine(
    must: Sequence[Column] = (),
    filter: Sequence[Column] = (),  # noqa: A002 - the usual name of this clause
    should: Sequence[Column] = (),
    must_not: Sequence[Column] = (),
    minimum: int | None = None,
) -> Column:
    """Boolean clause: all of must and filter, enough of should, none of must_not."""
    known = lambda c: F.coalesce(c, F.lit(False))
    wanted = [known(c) for c in (*must, *filter)] + [~known(c) for c in must_not]
    if should:
        need = minimum if minimum is not None else (0 if must or filter else 1)
        if need == 1:
            wanted.append(reduce(lambda a, b: a | b, [known(c) for c in should]))
        elif need > 1:
            wanted.append(reduce(lambda a, b: a + b, [known(c).cast("int") for c in should]) >= need)
    return reduce(lambda a, b: a & b, wanted, F.lit(True))


def contains_text(column: Column, value: str, regex: bool = False) -> Column:
    """Case-insensitive contains after dropping wildcard signs; literal unless ``regex``."""
    bare = value.replace("*", "").replace("?", "")
    text = column.cast("string")
    if regex:
        return F.coalesce(text, F.lit("nan")).rlike("(?i)" + bare)
    return F.coalesce(F.lower(text).contains(bare.lower()), F.lit(False))


def one_of_ignoring_case(column: Column, values: Iterable[str]) -> Column:
    return F.lower(column.cast("string")).isin([v.lower() for v in values])


def any_column_contains(df: DataFrame, value: str) -> Column:
    """Any column, as text, contains the value; case ignored."""
    wanted = value.lower()
    tests = [F.coalesce(F.lower(col_of(c).cast("string")).contains(wanted), F.lit(False)) for c in df.columns]
    return reduce(lambda a, b: a | b, tests)


def not_loopback(ip: Column) -> Column:
    return ~ip.isin(LOOPBACK)


def sanitize(df: DataFrame, max_rows: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Infinities become null; if asked for, only the first ``max_rows`` rows in ``order``."""
    numeric = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    cleaned = df.select(*[(finite(col_of(c)).alias(c) if c in numeric else col_of(c)) for c in df.columns])
    if max_rows is None:
        return cleaned
    return (cleaned.orderBy(*order) if order else cleaned).limit(max_rows)


@dataclass
class LogQuery:
    """What a reader asks for; compiled to one predicate."""

    start: str | None = None
    end: str | None = None
    hostname: str = ""
    username: str = ""
    source_ip: str = ""
    dest_ip: str = ""
    event_id: str = ""
    severities: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    text: str = ""
    columns: list[str] = field(default_factory=list)
    descending: bool = True
    page_size: int = 100

    def predicate(self, df: DataFrame) -> Column:
        found = lambda logical: resolve(df.columns, logical)
        tests: list[Column] = []
        if self.start and self.end and found("timestamp"):
            tests.append(time_range(col_of(found("timestamp")), self.start, self.end))
        for logical, value in (
            ("hostname", self.hostname), ("username", self.username), ("src_ip", self.source_ip),
            ("dst_ip", self.dest_ip), ("event_id", self.event_id),
        ):
            if value and found(logical):
                tests.append(contains_text(col_of(found(logical)), value))
        for logical, values in (("severity", self.severities), ("category", self.categories)):
            if values and found(logical):
                tests.append(one_of_ignoring_case(col_of(found(logical)), values))
        if self.text:
            tests.append(any_column_contains(df, self.text))
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.predicate(df))
