"""STR and SRC7: streams replayed in three runs over new files."""

from pyspark.sql import functions as F

from ..operators.features_behaviour import is_auth_failure
from ..operators.risk import history_points, weighted_risk
from ..session import scratch_path
from ..sources.logs import logs, table
from ..streaming import keyed
from ..streaming import streams as st
from .registry import on_logs, query
from .risk import on_risk, pillars
from .windows import FAILED_SQL

CUTS = ["2024-01-03", "2024-01-10"]
_PART = "CASE WHEN ts < TIMESTAMP '2024-01-03' THEN 0 WHEN ts < TIMESTAMP '2024-01-10' THEN 1 ELSE 2 END"


def replay(spark, df, run):
    """Write one period after the other as new files and run the stream after each."""
    base = scratch_path(spark, "stream")
    source, out, state, checkpoint = (f"{base}/{n}" for n in ("in", "out", "state", "checkpoint"))
    # The first and the last period are open, so that every row is replayed.
    for i, (start, stop) in enumerate(zip([None, *CUTS], [*CUTS, None])):
        part = df if start is None else df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        part = part if stop is None else part.filter(F.col("ts") < F.lit(stop).cast("timestamp_ntz"))
        part.write.parquet(f"{source}/part{i}")
        run(st.file_stream(spark, f"{source}/*", df.schema), out, state, checkpoint)
    return out, state


@query("src7_new_files", on_logs(f"SELECT CAST(part AS INTEGER) AS batch, count(*) AS n FROM (SELECT {_PART} AS part FROM logs) GROUP BY 1"))
def _(spark, sf):
    out, _ = replay(spark, logs(spark, sf).select("ts"), lambda s, o, _s, c: st.batch_sizes(s, o, c))
    return spark.read.parquet(out)


@query("str1_new_users", on_logs(
    "SELECT doc_id, CASE WHEN user_name IS NOT NULL AND part = min(part) OVER (PARTITION BY user_name) THEN 1e0 ELSE 0e0 END AS is_new "
    f"FROM (SELECT *, {_PART} AS part FROM logs)"))
def _(spark, sf):
    df = logs(spark, sf).select("doc_id", "user_name", "ts")
    out, _ = replay(spark, df, lambda s, o, _s, c: keyed.new_entities(s, "user_name", o, c))
    return spark.read.parquet(out).select("doc_id", "is_new")


@query("str2_burst_score", on_logs(
    "SELECT doc_id, round(CASE WHEN user_name IS NULL THEN 1e0 ELSE count(*) OVER (PARTITION BY user_name, part) * 1e0 / count(*) OVER "
    f"(PARTITION BY user_name ORDER BY part) END, 6) AS burst FROM (SELECT *, {_PART} AS part FROM logs)"))
def _(spark, sf):
    df = logs(spark, sf).select("doc_id", "user_name", "ts")
    out, _ = replay(spark, df, lambda s, o, _s, c: keyed.burst_scores(s, "user_name", o, c))
    return spark.read.parquet(out).select("doc_id", F.round("burst", 6).alias("burst"))


@query("str3_running_moments", (
    "SELECT 'value' AS feature, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 5) AS variance FROM events"))
def _(spark, sf):
    df = table(spark, sf, "events").select("ts", "value")
    _, state = replay(spark, df, lambda s, _o, state, c: st.running_moments(s, ["value"], st.moments_state(spark, state), c))
    return st.moments_state(spark, state).before().select(
        "feature", "n", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"))


@query("str4_user_risk", on_risk("SELECT doc_id, round(risk, 6) AS final_risk, round(mean, 6) AS user_risk FROM r"))
def _(spark, sf):
    df = pillars(spark, sf).withColumns({
        "_calm": weighted_risk(history_points(F.lit(0.0))), "_tense": weighted_risk(history_points(F.lit(100.0)))})
    df = df.select("doc_id", "ts", "_who", "_calm", "_tense")
    out, _ = replay(spark, df, lambda s, o, state, c: st.user_risk(s, st.risk_state(spark, state), o, c))
    return spark.read.parquet(out).select(
        "doc_id", F.round("final_risk", 6).alias("final_risk"), F.round("user_risk", 6).alias("user_risk"))


@query("str4_failure_windows", on_logs(
    f"SELECT date_trunc('hour', ts) AS bucket, user_name, count(*) AS n FROM logs WHERE {FAILED_SQL} = 1 GROUP BY 1, 2"))
def _(spark, sf):
    df = logs(spark, sf).select("ts", "user_name", is_auth_failure().alias("failed"))
    keys = ["bucket", "user_name"]
    out, _ = replay(spark, df, lambda s, o, _s, c: st.keep_latest(st.failure_windows(s, "failed"), keys, o, c))
    return st.latest_windows(spark, out, keys)


@query("str6_volume_over_time", on_logs("SELECT date_trunc('hour', ts) AS bucket, count(*) AS n FROM logs GROUP BY 1"))
def _(spark, sf):
    out, _ = replay(spark, logs(spark, sf).select("ts"), lambda s, o, _s, c: st.keep_latest(
        st.volume_over_time(s), ["bucket"], o, c))
    return st.latest_windows(spark, out, ["bucket"])
