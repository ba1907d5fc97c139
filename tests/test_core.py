"""Look-ups, ordered frames and percentiles: the scalable path equals the plain one, also with hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.operators import aggregates, lookup, ordered, windows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, some keys are null."""
    key = (F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 31 == 0, F.lit(None))
           .otherwise((F.col("id") % 1700).cast("string")))
    return spark.range(6000).select("id", key.alias("k"), F.pmod(F.xxhash64("id"), F.lit(100)).alias("x")).persist()


def rows(df):
    return df.orderBy("id").collect()


def test_attach_with_many_keys_equals_broadcast(skewed):
    aggs = {"n": F.count(F.lit(1)), "top": F.max("x")}
    profile = lookup.profile_keys(skewed, ["k"])
    plain = lookup.attach(skewed, "k", aggs, profile).select("id", "k", "n", "top")
    shuffled = lookup.attach(skewed, "k", aggs, profile, broadcast_keys=1).select("id", "k", "n", "top")
    assert rows(plain) == rows(shuffled)
    assert plain.filter("k is null and n is not null").isEmpty()


def test_profile_counts_filled_rows(skewed):
    profile = lookup.profile_keys(skewed, ["k"])
    assert profile.rows == 6000 and profile.filled["k"] == skewed.filter("k is not null").count()


def test_new_key_is_flagged_on_every_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id int, k string")
    known = spark.createDataFrame([("a",)], "k string")
    got = lookup.new_key_flag(df, "k", known, "fresh").orderBy("id").collect()
    assert [r.fresh for r in got] == [0.0, 1.0, 1.0, 0.0]


def test_global_position(skewed):
    got = ordered.global_position(skewed, ["x", "id"]).orderBy("_pos").collect()
    assert [r["_pos"] for r in got] == list(range(6000))
    assert [(r.x, r.id) for r in got] == sorted((r.x, r.id) for r in got)


def test_per_key_frames_in_buckets_equal_plain_windows(skewed):
    def build(df, w):
        return df.withColumns({
            "before": F.lag("x").over(w), "sd": F.round(F.stddev_samp("x").over(w.rowsBetween(-9, 0)), 9), "r": F.col("_rank")})

    plain = ordered.per_key_frames(skewed, "k", ["id"], 10, build).select("id", "before", "sd", "r")
    cut = ordered.per_key_frames(skewed, "k", ["id"], 10, build, group_limit=5, bucket_rows=64).select("id", "before", "sd", "r")
    assert rows(plain) == rows(cut)


def test_failures_window_buckets(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7 == 0).alias("f"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        (F.col("id") % 11).cast("string")).alias("k"))
    whole = windows.failures_in_window(df, "k", "f", ["id"], "n", 100, bucket_rows=100_000).select("id", "n")
    cut = windows.failures_in_window(df, "k", "f", ["id"], "n", 100, bucket_rows=150).select("id", "n")
    assert rows(whole) == rows(cut)
    last, seen = [], {}
    for r in df.orderBy("id").collect():
        assert sum(1 for k, f in last[-100:] if k == r.k and f) == seen.setdefault(r.id, rows(whole)[r.id].n) if r.id < 300 else True
        last.append((r.k, r.f))


def test_rolling_deviation_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    got = [r.d for r in windows.rolling_deviation(df, ["id"], ["a", "b"], "d", bucket_rows=150).orderBy("id").collect()]
    want = []
    for i in range(len(x)):
        hist = x[max(0, i - 99):i + 1]
        want.append(0.0 if len(hist) < 10 else float(np.max(np.abs(
            (hist[-10:].mean(axis=0) - hist.mean(axis=0)) / (hist.std(axis=0) + 1e-9)))))
    assert np.allclose(got, want, atol=1e-9)


def test_volume_per_host_equals_the_recursion(spark):
    df = spark.range(60).select("id", F.lit("h").alias("k"))
    got = windows.volume_statistics(df, "k", ["id"], "v").orderBy("id").collect()
    mean, counts = None, []
    for r in got:
        t = r.id + 1
        counts.append(t)
        mean = float(t) if mean is None else mean * 9 / 11 + t * 2 / 11
        std = float(np.std(counts[-10:], ddof=1)) if len(counts) > 1 else 0.0
        assert abs(r.v_ema - mean) < 1e-9 and abs(r.v_std - std) < 1e-9


def test_volume_in_row_order_with_gaps(spark):
    df = spark.range(700).select("id", F.when(F.col("id") % 13 != 5, F.when(F.col("id") % 3 == 0, "a").otherwise("b")).alias("k"))
    got = windows.volume_statistics_row_order(df, "k", ["id"], "v").orderBy("id").collect()
    counts, mean, gap = {}, None, 0
    for r in got:
        if r.k is None:
            gap += 1
        else:
            counts[r.k] = counts.get(r.k, 0) + 1
            old = (9 / 11) ** (gap + 1)
            mean = float(counts[r.k]) if mean is None else (old * mean + 2 / 11 * counts[r.k]) / (old + 2 / 11)
            gap = 0
        assert abs(r.v_ema - (mean or 0.0)) < 1e-8


def test_mean_is_carried_over_long_gaps(spark):
    df = spark.range(1_500).select("id", F.when((F.col("id") < 20) | (F.col("id") >= 1_400), "a").alias("k"))
    got = windows.volume_statistics_row_order(df, "k", ["id"], "v").orderBy("id").collect()
    assert got[19].v_ema > 0 and all(abs(r.v_ema - got[19].v_ema) < 1e-9 for r in got[20:1_400])


def test_a_run_leaves_no_files(spark):
    from pathlib import Path

    from vigilog import session

    assert session.durable(spark.range(5)).count() == 5
    assert list(Path(session.run_folder(spark)).glob("cut-*"))
    session.remove_scratch(spark)
    assert not Path(session.run_folder(spark)).exists()


def test_last_known_over_several_levels(spark):
    rng = np.random.default_rng(3)
    values = [float(i) if rng.random() < 0.01 else None for i in range(2_000)]
    df = spark.createDataFrame(list(enumerate(values)), "_pos long, v double")
    last, want = None, []
    for v in values:
        last = v if v is not None else last
        want.append(last)
    assert [r.c for r in ordered.last_known(df, "v", "c", rows=7).orderBy("_pos").collect()] == want


@pytest.mark.parametrize("local", [1_000_000, 50])
def test_percentiles_are_exact(spark, local):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 900, 3000).astype(float), np.full(1500, 400.0)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    wanted = [0, 5, 33.3, 50, 90, 99.9, 100]
    got = aggregates.exact_percentiles(df, "v", wanted, local_values=local)
    assert np.allclose([got[p] for p in wanted], np.percentile(values, wanted))


def test_time_intervals():
    assert [aggregates.auto_interval(h) for h in (1, 24, 100, 700, 2000, 9000)] == ["1m", "1h", "6h", "1d", "1w", "1M"]


def test_constant_histogram(spark):
    got = aggregates.value_histogram(spark.range(5).select(F.lit(2.0).alias("x")), "x", 4).orderBy("bin").collect()
    assert [r.n for r in got] == [0, 0, 5, 0] and got[0].low == 1.5


def test_position_does_not_depend_on_partitions(spark, skewed):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        few = rows(ordered.global_position(skewed, ["x", "id"]).select("id", "_pos"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert few == rows(ordered.global_position(skewed, ["x", "id"]).select("id", "_pos"))
