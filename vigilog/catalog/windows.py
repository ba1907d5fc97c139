"""WIN: ordered operators."""

from pyspark.sql import functions as F

from ..operators import ordered
from ..operators import windows as win
from ..operators.features_behaviour import is_auth_failure
from ..sources.logs import logs, table
from .registry import on_logs, query


@query("win1_gap_per_user", on_logs(
    "SELECT doc_id, CASE WHEN user_name IS NULL THEN 0e0 ELSE round(least(greatest(coalesce((epoch_us(ts) - "
    "lag(epoch_us(ts)) OVER (PARTITION BY user_name ORDER BY ts, doc_id)) / 1e6, 0e0), 0e0), 3600e0), 6) END AS gap FROM logs"))
def _(spark, sf):
    df = logs(spark, sf).select("doc_id", "user_name", "ts")
    return win.seconds_since_previous(df, "user_name", "ts", "doc_id", "gap").select(
        "doc_id", F.round("gap", 6).alias("gap"))


@query("win1_gap_in_conversation", (
    "SELECT conv_id, turn, CAST(turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS step FROM conversations"))
def _(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn")
    return ordered.per_key_frames(df, "conv_id", ["turn"], 1, lambda part, w: part.withColumn(
        "step", F.col("turn") - F.lag("turn").over(w)))


@query("win2_running_count", on_logs(
    "SELECT doc_id, CASE WHEN host_name IS NOT NULL THEN row_number() OVER (PARTITION BY host_name ORDER BY ts, doc_id) END "
    "AS so_far FROM logs"))
def _(spark, sf):
    df = logs(spark, sf).select("doc_id", "host_name", "ts")
    return win.running_count(df, "host_name", ["ts", "doc_id"], "so_far").select("doc_id", "so_far")


_ROWS = ("SELECT event_no, row_number() OVER (ORDER BY ts, event_no) - 1 AS pos, CASE WHEN host_name IS NOT NULL THEN "
         "row_number() OVER (PARTITION BY host_name ORDER BY ts, event_no) END AS x FROM logs")
_SEQ = ("SELECT *, row_number() OVER (ORDER BY pos) - 1 AS seq, pow(9e0 / 11, coalesce(pos - lag(pos) OVER (ORDER BY pos), 1)) AS old "
        "FROM r WHERE x IS NOT NULL")
# Logarithms are summed per block of 1,000 rows; sums over everything would lose digits.
_COEF = ("SELECT pos, seq, seq // 1000 AS blk, w, sum(l) OVER (PARTITION BY seq // 1000 ORDER BY seq) AS lp, "
         "sum(l) OVER (PARTITION BY seq // 1000) AS total FROM (SELECT pos, seq, CASE WHEN seq = 0 THEN x * 1e0 ELSE "
         "x * (2e0 / 11) / (old + 2e0 / 11) END AS w, CASE WHEN seq = 0 THEN 0e0 ELSE ln(old / (old + 2e0 / 11)) END AS l FROM s)")
_MEAN = ("SELECT a.pos, sum(b.w * exp(CASE WHEN a.blk = b.blk THEN a.lp - b.lp ELSE a.lp + b.total - b.lp END)) AS y "
         "FROM c a JOIN c b ON b.seq BETWEEN a.seq - 300 AND a.seq GROUP BY a.pos, a.seq")
_FRAME = ("SELECT r.event_no, r.x, last_value(y IGNORE NULLS) OVER (ORDER BY r.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y, "
          "coalesce(stddev_samp(r.x) OVER (ORDER BY r.pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0e0) AS s "
          "FROM r LEFT JOIN m USING (pos)")
_MIXED = {"r": _ROWS, "s": _SEQ, "c": _COEF, "m": _MEAN, "f": _FRAME}


def mixed_volume(spark, sf):
    df = logs(spark, sf).select("event_no", "host_name", "ts")
    return win.volume_statistics_row_order(df, "host_name", ["ts", "event_no"], "volume")


@query("win3_exponential_mean", on_logs("SELECT event_no, round(coalesce(y, 0e0), 6) AS volume_ema FROM f", **_MIXED))
def _(spark, sf):
    return mixed_volume(spark, sf).select("event_no", F.round("volume_ema", 6).alias("volume_ema"))


@query("win4_rolling_deviation", on_logs("SELECT event_no, round(s, 6) AS volume_std FROM f", **_MIXED))
def _(spark, sf):
    return mixed_volume(spark, sf).select("event_no", F.round("volume_std", 6).alias("volume_std"))


WIN5_FEATURES = ["bytes", "args", "port"]
_WIN5_BASE = ("SELECT event_no, ts, coalesce(network_bytes, 0) AS bytes, coalesce(args_count, 0) AS args, "
              "coalesce(destination_port, 0) AS port, row_number() OVER (ORDER BY ts, event_no) AS rn FROM logs")


def deviation_sql(features, base: str) -> str:
    frame = "OVER (ORDER BY ts, event_no ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    parts = ", ".join(
        f"abs((avg({f}) {frame.format(9)} - avg({f}) {frame.format(99)}) / (stddev_pop({f}) {frame.format(99)} + 1e-9))"
        for f in features)
    return f"SELECT event_no, CASE WHEN rn >= 10 THEN greatest({parts}) ELSE 0e0 END AS deviation FROM {base}"


def win5_input(spark, sf):
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return logs(spark, sf).select("event_no", "ts", zero("network_bytes").alias("bytes"), zero("args_count").alias("args"),
                                  zero("destination_port").alias("port"))


@query("win5_short_against_long", on_logs(
    "SELECT event_no, round(deviation, 6) AS deviation FROM d", base=_WIN5_BASE, d=deviation_sql(WIN5_FEATURES, "base")))
def _(spark, sf):
    out = win.rolling_deviation(win5_input(spark, sf), ["ts", "event_no"], WIN5_FEATURES)
    return out.select("event_no", F.round("deviation", 6).alias("deviation"))


FAILED_SQL = ("CASE WHEN regexp_matches(lower(event_action), 'auth|login|logon') AND contains(lower(event_outcome), 'fail') "
              "THEN 1 ELSE 0 END")
WINDOW_CTES = {
    "o": f"SELECT *, coalesce(user_name, 'unknown') AS who, {FAILED_SQL} AS failed, "
         "row_number() OVER (ORDER BY ts, event_no) AS rn FROM logs",
    "w": "SELECT *, coalesce(sum(failed) OVER (PARTITION BY who ORDER BY rn RANGE BETWEEN 1000 PRECEDING AND 1 PRECEDING), 0) "
         "AS recent FROM o",
}


@query("win6_recent_failures", on_logs("SELECT event_no, CAST(recent AS BIGINT) AS recent FROM w", **WINDOW_CTES))
def _(spark, sf):
    df = logs(spark, sf).select(
        "event_no", "ts", F.coalesce("user_name", F.lit("unknown")).alias("who"),
        F.coalesce(is_auth_failure(), F.lit(False)).alias("failed"))
    return win.failures_in_window(df, "who", "failed", ["ts", "event_no"], "recent").select("event_no", "recent")


@query("win8_global_position", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS pos FROM events")
def _(spark, sf):
    return ordered.global_position(table(spark, sf, "events").select("event_id", "value"), ["value", "event_id"], "pos").select(
        "event_id", "pos")


@query("win9_latest_rows", on_logs("SELECT event_no, ts FROM logs ORDER BY ts DESC, event_no DESC LIMIT 3000"))
def _(spark, sf):
    from ..operators.filters import ntz
    from ..sources.state import append_history

    df = logs(spark, sf).select("event_no", "ts", F.struct("ts", "event_no").alias("k"))
    old, new = df.filter(F.col("ts") < ntz("2024-01-25")), df.filter(F.col("ts") >= ntz("2024-01-25"))
    return append_history(old, new, "k", 3000).drop("k")
