import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilog.operators import risk
from vigilog.operators.risk import latest_user_risk, user_risk_fold


def loop(rows, start=None):
    mean, out = dict(start or {}), {}
    for doc, who, _, calm, tense in rows:
        past = mean.get(who, 0)
        risk = tense if past > 80 else calm
        mean[who] = mean.get(who, risk) * 0.9 + risk * 0.1
        out[doc] = (past, risk, mean[who])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    made = []
    for i in range(1500):
        who = "hot" if i % 3 else f"u{i % 7}"
        # Long spells around the limit, so that the past really switches the branch.
        calm = float(np.clip(rng.normal(88 if (i // 150) % 2 == 0 else 70, 9), 0, 94))
        made.append((f"{i:05d}", who, i, calm, min(100.0, calm + 6.0)))
    return made


SCHEMA = "doc_id string, _who string, ts int, _calm double, _tense double"


@pytest.mark.parametrize("bucket", [1_000_000, 100, 17])
def test_fold_equals_the_loop(spark, rows, bucket):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.past_risk, r.final_risk, r.user_risk) for r in user_risk_fold(df, ("ts", "doc_id"), bucket_rows=bucket).collect()}
    want = loop(rows)
    assert any(past > 80 for past, _, _ in want.values()) and any(past < 80 for past, _, _ in want.values())
    assert all(np.allclose(got[d], want[d], atol=1e-9) for d in want)


@pytest.mark.parametrize("bucket", [1_000_000, 40])
def test_fold_continues_from_state(spark, rows, bucket):
    first, second = rows[:700], rows[700:]
    folded = user_risk_fold(spark.createDataFrame(first, SCHEMA), ("ts", "doc_id"), bucket_rows=bucket)
    state = latest_user_risk(folded)
    got = user_risk_fold(spark.createDataFrame(second, SCHEMA), ("ts", "doc_id"), state, bucket_rows=bucket)
    want = loop(rows)
    assert all(np.allclose((r.past_risk, r.final_risk, r.user_risk), want[r.doc_id], atol=1e-9) for r in got.collect())


def test_one_user_in_a_thousand_buckets(spark):
    """Runs of at most eight summaries, in a tree of several levels; the same values as the loop."""
    rng = np.random.default_rng(5)
    made = []
    for i in range(6000):
        calm = float(np.clip(rng.normal(86 if (i // 400) % 2 == 0 else 72, 8), 0, 94))
        made.append((f"{i:05d}", "one" if i % 500 else "two", i, calm, min(100.0, calm + 6.0)))
    df = spark.createDataFrame(made, SCHEMA)
    state = spark.createDataFrame([("one", 91.0)], "_who string, initial double")
    got = {r.doc_id: (r.past_risk, r.final_risk, r.user_risk) for r in user_risk_fold(df, ("ts", "doc_id"), state, bucket_rows=6, scan_block=8).collect()}
    want = loop(made, {"one": 91.0})
    assert all(np.allclose(got[d], want[d], atol=1e-9) for d in want)


def test_no_run_is_longer_than_a_block(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    chain = risk._chain

    def watched(pdf):
        sizes.add(len(pdf) > 8)
        return chain(pdf)

    monkeypatch.setattr(risk, "_chain", watched)
    df = spark.range(3000).select(F.format_string("%05d", "id").alias("doc_id"), F.lit("one").alias("_who"), F.col("id").cast("int").alias("ts"),
                                  F.lit(90.0).alias("_calm"), F.lit(95.0).alias("_tense"))
    assert user_risk_fold(df, ("ts", "doc_id"), bucket_rows=5, scan_block=8).count() == 3000
    assert sizes.value == 0


def test_composition_is_the_same_as_one_run():
    rng = np.random.default_rng(2)
    for _ in range(200):
        calm = rng.uniform(60, 100, 12)
        tense = np.minimum(100, calm + 8)
        whole = risk._summarise("u", calm.tolist(), tense.tolist(), 0)[0]
        parts = [risk._summarise("u", calm[a:b].tolist(), tense[a:b].tolist(), i)[0] for i, (a, b) in enumerate([(0, 3), (3, 4), (4, 9), (9, 12)])]
        one = risk._compose_run(pd.DataFrame(parts).assign(_run=0)).iloc[0]
        for past in rng.uniform(0, 120, 20):
            assert abs(risk._arrive(past, whole["slope"], whole["starts"], whole["shifts"]) - risk._arrive(past, one.slope, one.starts, one.shifts)) < 1e-9
        assert abs(whole["fresh"] - one.fresh) < 1e-9
