"""Aggregations of the dashboards: histograms over time and value, top terms, profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import INTERVAL_BY_HOURS, INTERVAL_REST
from ..functions.fields import col_of
from ..functions.scalar import percentage
from ..session import durable

# Calendar unit for truncation, or a fixed length in minutes.
_UNITS = {"1M": ("month", "1 month"), "1w": ("week", "7 days"), "1d": ("day", "1 day"), "1h": ("hour", "1 hour"),
          "1m": ("minute", "1 minute")}
_MINUTES = {"6h": 360, "10min": 10}


def bucket_start(ts: Column, interval: str) -> Column:
    """Start of the bucket holding ``ts`` (zone-free UTC)."""
    if interval in _UNITS:
        return F.date_trunc(_UNITS[interval][0], ts).cast("timestamp_ntz")
    seconds = _MINUTES[interval] * 60
    whole = F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds
    return F.timestamp_seconds(whole).cast("timestamp_ntz")


def interval_step(interval: str) -> str:
    return _UNITS[interval][1] if interval in _UNITS else f"{_MINUTES[interval]} minutes"


def auto_interval(hours: float) -> str:
    """Bucket size for a range of this length."""
    return next((name for limit, name in INTERVAL_BY_HOURS if hours <= limit), INTERVAL_REST)


def time_histogram(
    df: DataFrame, ts: str, interval: str, aggregates: dict[str, Column] | None = None, fill: bool = True
) -> DataFrame:
    """Rows per bucket, empty buckets between the first and the last included as 0.

    The counts are computed once and are as small as the number of buckets; each bucket fills the gap
    up to the next one.
    """
    aggregates = aggregates or {"n": F.count(F.lit(1))}
    counted = (
        df.filter(F.col(ts).isNotNull()).groupBy(bucket_start(F.col(ts), interval).alias("bucket"))
        .agg(*[expr.alias(name) for name, expr in aggregates.items()])
    )
    if not fill:
        return counted
    return _without_gaps(counted, interval, list(aggregates))


#: Buckets that one row fills: longer gaps are cut, and the parts dealt out, before they are filled.
GAP_BUCKETS = 10_000


def _without_gaps(counted: DataFrame, interval: str, names: Sequence[str]) -> DataFrame:
    """Every bucket of the interval between the first and the last, new ones with 0.

    The following bucket is looked up inside each calendar year; the last of a year is followed by the first of the next
    year that has any. Times have fewer than 10,000 years, which bounds that table.
    """
    count, unit = interval_step(interval).split()
    step, stride = (F.expr(f"INTERVAL {n} {unit}") for n in (int(count), int(count) * GAP_BUCKETS))
    counted = durable(counted.withColumn("_year", F.year("bucket")))
    years = sorted(counted.groupBy("_year").agg(F.min("bucket"), F.max("bucket"), F.count(F.lit(1))).collect())
    jumps = [(year[0], later[1]) for year, later in zip(years, years[1:])]
    # How many buckets are missing at most, by the shortest step of the unit.
    shortest = int(count) * {"month": 28 * 86400, "days": 86400, "day": 86400, "hour": 3600, "minute": 60, "minutes": 60}[unit]
    missing = ((years[-1][2] - years[0][1]).total_seconds() / shortest + 1 - sum(y[3] for y in years)) if years else 0
    kept = counted.select("bucket", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])
    if missing < 1:
        return kept
    table = counted.sparkSession.createDataFrame(jumps, "_year int, _jump timestamp_ntz")
    inside = F.lead("bucket").over(Window.partitionBy("_year").orderBy("bucket"))
    placed = counted.withColumn("_inside", inside).join(F.broadcast(table), "_year", "left").withColumn("_next", F.coalesce("_inside", "_jump"))
    gaps = placed.filter(F.col("_next") > F.col("bucket") + step).select((F.col("bucket") + step).alias("_from"), (F.col("_next") - step).alias("_to"))
    parts = gaps.select(F.explode(F.sequence("_from", "_to", stride)).alias("_start"), "_to")
    if missing > GAP_BUCKETS:  # a stated number of tasks, as so few bytes would be merged to one again
        tasks = min(int(missing / GAP_BUCKETS) + 1, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        parts = parts.repartition(tasks, "_start")
    filled = parts.select(F.explode(F.sequence("_start", F.least("_to", F.col("_start") + stride - step), step)).alias("bucket"))
    return kept.unionByName(filled.select("bucket", *[F.lit(0).cast(kept.schema[n].dataType).alias(n) for n in names]))


def time_histogram_by(df: DataFrame, ts: str, interval: str, by: str, values: Sequence[str] | None = None, most: int = 10) -> DataFrame:
    """Wide trend: total and one column per value; a value absent from a bucket is null.

    Unless given, the values are the ``most`` frequent ones of the data, ties by value. The rows are read once, counted
    by bucket and value.
    """
    start = bucket_start(F.col(ts), interval).alias("bucket")
    pairs = durable(df.filter(F.col(ts).isNotNull()).groupBy(start, F.col(by).alias("value")).agg(F.count(F.lit(1)).alias("n")))
    if values is None:
        terms = pairs.where(F.col("value").isNotNull()).groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(most)
        values = [r[0] for r in terms.collect()]
    hits = [F.sum(F.when(F.col("value") == v, F.col("n"))).alias(f"n_{v.lower()}") for v in values]
    return pairs.groupBy("bucket").agg(F.sum("n").alias("total"), *hits)


def timeline_interval(df: DataFrame, ts: str) -> str:
    """Resolution from the covered span: days over 30 d, hours over 2 d, else ten minutes."""
    row = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count(ts).alias("n")).first()
    if row["n"] <= 1:
        return "1h"
    seconds = (row["hi"] - row["lo"]).total_seconds()
    return "1d" if seconds > 30 * 86400 else "1h" if seconds > 2 * 86400 else "10min"


def top_terms(
    df: DataFrame, field: str, n: int = 20, order_by: str = "n", ascending: bool = False,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Most frequent values with optional further metrics; ties by value."""
    grouped = df.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), *[e.alias(a) for a, e in (extra or {}).items()]
    )
    lead = F.col(order_by).asc() if ascending else F.col(order_by).desc()
    return grouped.orderBy(lead, F.col("value")).limit(n)


def value_counts(df: DataFrame, field: str) -> DataFrame:
    return df.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def top_list_terms(df: DataFrame, field: str, n: int = 15) -> DataFrame:
    """Top terms of list-like text such as ``['a', 'b']``.

    Equal texts are counted first, so splitting touches each distinct text once.
    """
    texts = df.filter(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("text")).agg(
        F.count(F.lit(1)).alias("n")
    )
    bare = F.regexp_replace("text", r"^[\[\]'\"]+|[\[\]'\"]+$", "")
    items = F.explode(F.split(bare, "', '"))
    value = F.regexp_replace("item", r"^['\" ]+|['\" ]+$", "")
    return (
        texts.select("n", items.alias("item")).select("n", value.alias("value"))
        .groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "value").limit(n)
    )


def many_list_terms(df: DataFrame, fields: Sequence[str], n: int = 15) -> DataFrame:
    """Top terms of several fields of list-like text in one scan: (field, value, n, rank)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in fields])).alias("p")).select("p.*")
    texts = long.filter(F.col("text").isNotNull()).groupBy("field", "text").agg(F.count(F.lit(1)).alias("n"))
    items = F.explode(F.split(F.regexp_replace("text", r"^[\[\]'\"]+|[\[\]'\"]+$", ""), "', '"))
    value = F.regexp_replace("item", r"^['\" ]+|['\" ]+$", "")
    counted = texts.select("field", "n", items.alias("item")).groupBy("field", value.alias("value")).agg(F.sum("n").alias("n"))
    best = Window.partitionBy("field").orderBy(F.col("n").desc(), "value")
    return counted.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def distinct_sketches(df: DataFrame, by: Column, columns: Sequence[str], size: int = 18) -> DataFrame:
    """(part, one sketch a column): mergeable distinct counts of each part, to be kept as a table and united later.

    ``size`` is the logarithm of a sketch's registers; the estimates have a relative error of 1.04 / sqrt(2**size), and
    are all but exact below an eighth of that number.
    """
    return df.groupBy(by.alias("part")).agg(*[F.hll_sketch_agg(F.col(c), size).alias(c) for c in columns])


def united_distinct(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the estimates over all given parts."""
    return sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])


def address_items(df: DataFrame, field: str) -> DataFrame:
    """One row per address of a comma-separated address text, loopback left out."""
    from .filters import not_loopback

    return df.filter(F.col(field).isNotNull()).withColumn("ip", F.explode(F.split(F.col(field), ", "))).filter(
        not_loopback(F.col("ip"))
    )


def top_addresses(df: DataFrame, field: str, n: int = 10) -> DataFrame:
    """Most frequent addresses; equal texts are combined before they are split."""
    texts = df.groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    return address_items(texts, field).groupBy("ip").agg(F.sum("n").alias("n")).orderBy(
        F.col("n").desc(), "ip"
    ).limit(n)


def many_top_terms(df: DataFrame, fields: dict[str, str], n: int = 15) -> DataFrame:
    """Top-n lists of several fields in one scan and one shuffle: (field, value, n, rank).

    The per-field cut runs as a grouped limit before its shuffle, so a field with very many values
    sends only its best candidates.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(label).alias("field"), F.col(name).cast("string").alias("value"))
        for label, name in fields.items()
    ])).alias("pair")).select("pair.*")
    counted = long.filter(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy("field").orderBy(F.col("n").desc(), "value")
    return counted.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


#: Accuracy of the sketch that encloses a rank: the error is a rank share of 1 / SKETCH.
SKETCH = 5_000


def exact_percentiles(
    df: DataFrame, column: str, percents: Sequence[float], local_values: int = 20_000, sketch: int = SKETCH
) -> dict[float, float]:
    """Exact interpolated percentiles; only a narrow bracket of values around each wanted rank is ever shuffled.

    A mergeable sketch of the rows encloses the rank; the next pass counts what lies below and inside the bracket, where
    the rows are. A bracket that holds more than ``local_values`` rows of several values is sketched again, some
    ``sketch / 4`` times narrower each time. What is left is counted by value.
    """
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    brackets = _brackets(rows, percents, local_values, sketch)
    if not brackets:
        return {p: None for p in percents}
    wanted = reduce(lambda a, b: a | b, [F.col("v").between(b.low, b.high) for b in brackets.values()])
    counted = rows.filter(wanted).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
    out = {}
    for p, bracket in brackets.items():
        end, at = bracket.below, []
        for value, n in ((r.v, r.n) for r in counted if bracket.low <= r.v <= bracket.high):
            end += n
            at += [value] * (sum(rank < end for rank in bracket.ranks) - len(at))
        share = bracket.target - int(bracket.target)
        out[p] = at[0] + (at[1] - at[0]) * share
    return out


@dataclass
class _Bracket:
    """A range of values that holds a fractional rank: rows below it and inside, and the margin of the next sketch."""

    target: float
    rows: int
    low: float
    high: float
    below: int
    inside: int
    margin: int = 2

    @property
    def ranks(self) -> tuple[int, int]:
        return int(self.target), min(int(self.target) + 1, self.rows - 1)


def _brackets(rows: DataFrame, percents: Sequence[float], most: int, sketch: int) -> dict[float, _Bracket]:
    size = rows.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    total = size["n"]
    found = {p: _Bracket(p / 100.0 * (total - 1), total, size["lo"], size["hi"], 0, total) for p in percents} if total else {}
    while large := {p: b for p, b in found.items() if b.inside > most and b.low < b.high}:
        cuts, next_ = [], {}
        for i, b in enumerate(large.values()):
            slack = b.margin * (b.inside // sketch + 1)
            shares = [max(0.0, (b.ranks[0] - b.below - slack) / b.inside), min(1.0, (b.ranks[1] + 1 - b.below + slack) / b.inside)]
            cuts.append(F.percentile_approx(F.when(F.col("v").between(b.low, b.high), F.col("v")), shares, sketch).alias(f"c{i}"))
        ends = dict(zip(large, rows.agg(*cuts).first()))
        checks = [e.alias(f"{k}{i}") for i, (low, high) in enumerate(ends.values()) for k, e in (
            ("b", F.count(F.when(F.col("v") < low, 1))), ("i", F.count(F.when(F.col("v").between(low, high), 1))))]
        row = rows.agg(*checks).first()
        for i, (p, b) in enumerate(large.items()):
            (low, high), below, inside = ends[p], row[f"b{i}"], row[f"i{i}"]
            if below <= b.ranks[0] and b.ranks[1] < below + inside and inside < b.inside:
                next_[p] = _Bracket(b.target, b.rows, low, high, below, inside)
            else:  # the sketch was off or could not part the values: ask for more room
                next_[p] = replace(b, margin=b.margin * 4)
                if b.margin * (b.inside // sketch + 1) > b.inside:
                    next_[p] = replace(b, inside=min(b.inside, most))
        found |= next_
    return found


def percentiles_of_counts(
    counted: DataFrame, percents: Sequence[float], local_values: int = 1_000_000
) -> dict[float, float]:
    """Exact percentiles of a table of distinct values ``v`` with counts ``n``."""
    counted = counted.persist()
    try:
        size = counted.agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows")).first()
        if not size["rows"]:
            return {p: None for p in percents}
        targets = {p: p / 100.0 * (size["rows"] - 1) for p in percents}
        if size["values"] <= local_values:
            return _values_at(counted, targets, 0, size["rows"])
        return {p: _select_percentile(counted, size["rows"], t, local_values) for p, t in targets.items()}
    finally:
        counted.unpersist()


def _values_at(counted: DataFrame, targets: dict[float, float], below: int, rows: int) -> dict[float, float]:
    """Interpolated values at fractional ranks of a bounded list of (value, count)."""
    window = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counted.withColumn("end", F.sum("n").over(window) + below)
    pick = lambda rank: F.min(F.when(F.col("end") > rank, F.col("v")))
    row = ends.agg(*[e for i, t in enumerate(targets.values()) for e in (
        pick(int(t)).alias(f"a{i}"), pick(min(int(t) + 1, rows - 1)).alias(f"b{i}"))]).first()
    return {p: row[f"a{i}"] + (row[f"b{i}"] - row[f"a{i}"]) * (t - int(t)) for i, (p, t) in enumerate(targets.items())}


def _select_percentile(counted: DataFrame, rows: int, target: float, local_values: int) -> float:
    """Value at a fractional rank of (value, count) rows by closing in on it from both sides."""
    below, kept = 0, counted
    while True:
        info = kept.agg(F.count(F.lit(1)).alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        if info["values"] <= local_values or info["lo"] == info["hi"]:
            break
        # Evenly spaced cuts over the values still in question; counts decide which gap holds the target.
        cuts = kept.agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 1000).alias("c")).first()["c"]
        cuts = sorted(set(cuts))
        sums = kept.agg(*[F.sum(F.when(F.col("v") <= c, F.col("n")).otherwise(0)).alias(f"c{i}")
                          for i, c in enumerate(cuts)]).first()
        low, high, skipped = None, None, 0
        for i, cut in enumerate(cuts):
            if below + sums[f"c{i}"] <= int(target):
                low, skipped = cut, sums[f"c{i}"]
            elif high is None and below + sums[f"c{i}"] >= int(target) + 2:
                high = cut
        if low is not None:
            kept = kept.filter(F.col("v") > low)
        if high is not None:
            kept = kept.filter(F.col("v") <= high)
        below += skipped
        if low is None and high is None:
            break
    return _values_at(kept, {0.0: target}, below, rows)[0.0]


def percentile_table(df: DataFrame, column: str, percents: Sequence[float]) -> DataFrame:
    values = exact_percentiles(df, column, percents)
    return df.sparkSession.createDataFrame([(float(p), values[p]) for p in percents], "percent double, value double")


def value_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over min..max, last bin closed, empty bins present."""
    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    # A constant column gets a unit-wide range around its value.
    bounds = bounds.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo, hi = bounds.first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    width = (hi - lo) / bins
    number = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = df.filter(F.col(column).isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + F.col("id") * F.lit(width)).alias("low"),
        (F.lit(lo) + (F.col("id") + 1) * F.lit(width)).alias("high"),
    )
    return edges.join(F.broadcast(counted), "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def edge_counts(df: DataFrame, left: str, right: str, n: int, self_edges: bool = False) -> DataFrame:
    """Most frequent pairs of two fields; ties by the pair."""
    pairs = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    if not self_edges:
        pairs = pairs.filter(F.col(left) != F.col(right))
    return pairs.groupBy(left, right).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), left, right
    ).limit(n)


def schema_profile(df: DataFrame, namespaces: Sequence[str] = (), top: int = 5, width: int = 80) -> DataFrame:
    """Per column: filled rows, fill share, distinct values and the most frequent values.

    Two passes: one aggregation for all counts, one counted unpivot for the frequent values. No
    sample is taken. Columns are listed namespace by namespace.
    """
    names = df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(col_of(c)).alias(f"f{i}") for i, c in enumerate(names)],
    )
    wide = counts.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("filled")) for i, c in enumerate(names)
    ])).alias("p")).select("_rows", "p.*")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col_of(c).cast("string").alias("value")) for c in names
    ])).alias("p")).select("p.*").filter(F.col("value").isNotNull())
    valued = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    distinct = valued.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    window = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    best = (
        valued.withColumn("r", F.row_number().over(window)).filter(F.col("r") <= top)
        .groupBy("column").agg(F.sort_array(F.collect_list(F.struct("r", "value", "n"))).alias("best"))
    )
    known = {name: i for i, name in enumerate(namespaces)}
    prefix = {c: (c.split(".")[0] if "." in c else "_root") for c in names}
    rest = sorted(set(prefix.values()) - set(known))
    rank = {**known, **{name: len(known) + i for i, name in enumerate(rest)}}
    order = {c: i for i, c in enumerate(sorted(names, key=lambda c: (rank[prefix[c]], c)))}
    place = F.create_map(*[F.lit(x) for c in names for x in (c, order[c])])
    group = F.create_map(*[F.lit(x) for c in names for x in (c, prefix[c])])
    return (
        wide.join(F.broadcast(distinct), "column", "left").join(F.broadcast(best), "column", "left")
        .select(
            place[F.col("column")].alias("position"), group[F.col("column")].alias("namespace"), "column",
            F.col("filled").alias("non_null"),
            F.coalesce(percentage(F.col("filled"), F.col("_rows"), 1), F.lit(0.0)).alias("fill_pct"),
            F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
            F.array_join(F.transform("best", lambda b: F.concat(
                F.substring(b["value"], 1, width), F.lit("="), b["n"].cast("string"))), "|").alias("top_values"),
        )
    )


def describe_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, range and null share per feature, in one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[e.alias(f"{k}{i}") for i, c in enumerate(features) for k, e in (
            ("m", F.avg(c)), ("s", F.stddev_samp(c)), ("a", F.min(c)), ("z", F.max(c)), ("c", F.count(c)))],
    )
    return row.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.round(f"m{i}", 4).alias("mean"), F.round(f"s{i}", 4).alias("std"),
                 F.round(F.col(f"a{i}").cast("double"), 4).alias("min"),
                 F.round(F.col(f"z{i}").cast("double"), 4).alias("max"),
                 F.round((F.col("_rows") - F.col(f"c{i}")) / F.col("_rows") * 100.0, 1).alias("null_pct"))
        for i, c in enumerate(features)
    ])).alias("p")).select("p.*")


def heat_map(df: DataFrame, x: str, y: str, z: Column, x_values: Sequence[object]) -> DataFrame:
    """Pivot of y by x with the mean of z; absent cells are 0."""
    table = df.groupBy(y).pivot(x, list(x_values)).agg(F.avg(z))
    return table.na.fill(0.0)


def scoring_summary(df: DataFrame, score: str = "anomaly_score", flag: str = "is_anomaly") -> DataFrame:
    total = F.count(F.lit(1))
    hits = F.count(F.when(F.col(flag), 1))
    return df.agg(
        total.alias("n_total"), hits.alias("n_anomalies"),
        F.round(hits / F.greatest(total, F.lit(1)) * 100.0, 2).alias("anomaly_rate_pct"),
        F.round(F.avg(score), 4).alias("mean_score"), F.round(F.max(score), 4).alias("max_score"),
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
