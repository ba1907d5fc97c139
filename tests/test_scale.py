"""What the plans promise: narrow brackets, gaps filled by many tasks, few scans, fits that equal a plain version."""

import numpy as np
from pyspark.sql import functions as F

from vigilog.operators import aggregates
from vigilog.operators.detectors import density
from vigilog.operators.features_behaviour import EntityState, KeyTable, behaviour_features
from vigilog.sources.logs import logs as log_view


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_percentiles_shuffle_only_a_bracket(spark):
    """All values differ, so counting them by value would shuffle every row."""
    rows = 300_000
    df = spark.range(rows, numPartitions=6).select(((F.col("id") * 7_368_787) % rows + F.col("id") / 1e7).alias("v"))
    wanted = [1, 50, 99.9]
    brackets = aggregates._brackets(df, wanted, 2_000, 5_000)
    assert all(b.inside <= 2_000 and b.below <= b.ranks[0] and b.ranks[1] < b.below + b.inside for b in brackets.values())
    got = aggregates.exact_percentiles(df, "v", wanted, local_values=2_000)
    want = np.percentile([r.v for r in df.collect()], wanted)
    assert np.allclose([got[p] for p in wanted], want, atol=1e-9)


def test_percentiles_of_few_values_and_of_hardly_any(spark):
    df = spark.range(50_000).select((F.col("id") % 3).cast("double").alias("v"), (F.col("id") * 0).alias("same"), F.lit(None).cast("double").alias("none"))
    assert aggregates.exact_percentiles(df, "v", [0, 50, 100], local_values=10) == {0: 0.0, 50: 1.0, 100: 2.0}
    assert aggregates.exact_percentiles(df, "same", [37], local_values=10) == {37: 0.0}
    assert aggregates.exact_percentiles(df, "none", [50]) == {50: None}
    assert aggregates.exact_percentiles(df.limit(1), "v", [10, 90], local_values=10) == {10: 0.0, 90: 0.0}


def test_a_stray_time_is_filled_by_many_tasks(spark):
    """Hours from 1900 to 2024: no window over all buckets, and no task fills the whole gap."""
    df = spark.sql("SELECT CAST(t AS TIMESTAMP_NTZ) AS ts FROM VALUES ('1900-01-01 05:10:00'), ('1900-01-01 05:50:00'), ('2024-03-01 01:00:00'), ('2024-03-01 03:00:00') AS v(t)")
    out = aggregates.time_histogram(df, "ts", "1h")
    each = {r["p"]: r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    total = sum(each.values())
    assert total == out.select("bucket").distinct().count() == (np.datetime64("2024-03-01T03") - np.datetime64("1900-01-01T05")).astype(int) + 1
    assert max(each.values()) < total / 2
    assert {str(r.bucket): r.n for r in out.where("n > 0").collect()} == {"1900-01-01 05:00:00": 2, "2024-03-01 01:00:00": 1, "2024-03-01 03:00:00": 1}


def test_months_and_weeks_have_no_gaps(spark):
    df = spark.sql("SELECT CAST(t AS TIMESTAMP_NTZ) AS ts FROM VALUES ('2019-12-31 05:10:00'), ('2020-03-01 01:00:00'), ('2021-01-31 01:00:00') AS v(t)")
    months = [str(r.bucket)[:7] for r in aggregates.time_histogram(df, "ts", "1M").orderBy("bucket").collect()]
    assert months == [f"{y}-{m:02d}" for y in (2019, 2020, 2021) for m in range(1, 13) if (2019, 12) <= (y, m) <= (2021, 1)]
    weeks = [r.bucket for r in aggregates.time_histogram(df, "ts", "1w").orderBy("bucket").collect()]
    assert {(b - a).days for a, b in zip(weeks, weeks[1:])} == {7}
    assert aggregates.time_histogram(df.limit(0), "ts", "1d").count() == 0


def test_sketches_of_days_unite(spark):
    df = spark.range(40_000).select((F.col("id") % 9_000).alias("k"), (F.col("id") % 7).alias("day"))
    days = aggregates.distinct_sketches(df, F.col("day"), ["k"], 12)
    for some, want in (([0], df.where("day = 0")), ([1, 2, 5], df.where("day IN (1, 2, 5)")), (list(range(7)), df)):
        got = aggregates.united_distinct(days.where(F.col("part").isin(some)), ["k"]).first().k
        exact = want.select("k").distinct().count()
        assert abs(got / exact - 1) < 4 * 1.04 / 2**6


def test_features_scan_the_rows_twice(spark, sf):
    """Once for the table of key statistics, once for the rows; all families read the stored statistics."""
    df = log_view(spark, sf)
    plan = executed(behaviour_features(df, EntityState()))
    plan = plan.split("== Initial Plan ==")[0]
    assert plan.count("events.parquet") == 1, plan.count("events.parquet")
    keys = KeyTable(df)
    assert keys.profile.rows == df.count() and keys.profile.filled["host_name"] == df.where("host_name IS NOT NULL").count()
    assert keys.largest("user_name") == df.groupBy("user_name").count().agg(F.max("count")).first()[0]


def test_trend_scans_the_rows_once(spark, sf):
    plan = executed(aggregates.time_histogram_by(log_view(spark, sf), "ts", "1d", "event_severity"))
    assert "events.parquet" not in plan  # the counts are stored


def test_boundary_fit_equals_a_plain_version(spark):
    """The same subgradient steps on one matrix."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    frame = spark.createDataFrame([(*map(float, r),) for r in x], "a double, b double").repartition(3)
    model = density.OneClassBoundary(["a", "b"], nu=0.1, width=16, steps=5).fit(frame)
    z, n = model._map(x), 400
    w, best = z.mean(axis=0), (np.inf, None, None)
    for step in range(5):
        edges = density._edges(w)
        counts = np.cumsum(np.histogram(z @ w, bins=edges)[0])
        rho = edges[min(int(np.searchsorted(counts, 0.1 * n)) + 1, len(edges) - 1)]
        outside = z @ w < rho
        loss = 0.5 * w @ w - rho + (rho - (z @ w)[outside]).sum() / (0.1 * n)
        if loss < best[0]:
            best = (loss, w, rho)
        rate = 1 / (step + 2)
        w = (1 - rate) * w + rate * z[outside].sum(axis=0) / (0.1 * n)
    assert np.allclose(model.w, best[1]) and abs(model.rho - best[2]) < 1e-9
