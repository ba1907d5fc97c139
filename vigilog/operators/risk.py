"""Risk of an event from five pillars, with the user's past risk fed back.

The fold over a user's events (an exponential mean of the risk, which itself raises the risk once it
is over 80) is sequential. It is made parallel by splitting the ordered events into buckets: what a
bucket does to the mean entering it is a step function with one common slope, and two such functions
one after the other are one again. Buckets are summarised in parallel, runs of ``SCAN_BLOCK``
summaries are composed to one summary, level by level, and the values entering the runs come down the
same tree; then all buckets are replayed in parallel with their entry values. No task holds more than
one bucket of rows or one run of summaries, however large a user is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar
from ..session import durable
from .features_behaviour import is_auth_failure
from .ordered import global_position
from .windows import failures_in_window

_PAST_LIMIT = 80.0
BUCKET_ROWS = 200_000
#: Summaries of one user that a task composes or chains.
SCAN_BLOCK = 1_000


def _points(parts: list[tuple[Column, float]]) -> Column:
    total = F.lit(0.0)
    for condition, points in parts:
        total = total + F.when(condition, F.lit(points)).otherwise(F.lit(0.0))
    return F.least(F.lit(100.0), total)


def _texts(parts: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, text) for condition, text in parts]))


@dataclass(frozen=True)
class Signals:
    """Row conditions the pillars are made of."""

    new_user: Column
    new_ip: Column
    odd_command: Column
    failed_often: Column
    base64: Column
    keyword: Column
    port: Column
    critical_host: Column
    brute_force: Column


def signals() -> Signals:
    feature = lambda n: F.coalesce(F.col(f"_ml_{n}"), F.lit(0.0))
    return Signals(
        new_user=feature("user_is_new") > 0, new_ip=feature("ip_is_new") > 0,
        odd_command=feature("process_suspicious_cmd") > 0, failed_often=feature("user_failed_login_ratio") > 0.5,
        base64=F.col("_base64"), keyword=F.col("_keyword").isNotNull(),
        port=F.coalesce(F.col("destination_port").isin(K.SENSITIVE_PORTS), F.lit(False)),
        critical_host=F.coalesce(_critical_host(), F.lit(False)),
        brute_force=(~F.col("_failed")) & (F.col("_recent") >= K.FAILURES_BEFORE_SUCCESS),
    )


def _critical_host() -> Column:
    test = F.lit(False)
    for prefix in K.CRITICAL_HOST_PREFIXES:
        test = test | F.col("host_name").startswith(prefix)
    return test


def recent_failures(logs: DataFrame, number: str, order: tuple[str, ...], window: int = K.FAILURE_WINDOW) -> DataFrame:
    """Per event: failures of the same user among the events before it. Only the needed columns are ordered."""
    narrow = logs.select(
        number, *[c for c in order if c != number], F.coalesce("user_name", F.lit("unknown")).alias("_who"),
        F.coalesce(is_auth_failure(), F.lit(False)).alias("_failed"))
    return failures_in_window(narrow, "_who", "_failed", list(order), "_recent", window).select(number, "_recent")


def with_pillars(
    df: DataFrame, logs: DataFrame | None = None, order: tuple[str, ...] = ("ts", "doc_id"), number: str = "doc_id",
    window: int = K.FAILURE_WINDOW,
) -> DataFrame:
    """Add the five pillars; history holds the asset part only until the fold has run.

    Needs ``ml_confidence`` and the behaviour features of users, addresses and processes. ``logs`` are
    the rows before the features were added: ordering them is cheaper than ordering ``df``.
    """
    recent = recent_failures(df if logs is None else logs, number, order, window)
    return _temporal(_static(df).join(recent, number))


def _static(df: DataFrame) -> DataFrame:
    """What the pillars need of a row alone, and all pillars but the temporal one."""
    message = [F.col("message")] if "message" in df.columns else []
    command = F.coalesce(F.col("command_line"), *message, F.lit(""))
    df = df.withColumns({
        "_who": F.coalesce("user_name", F.lit("unknown")), "_failed": F.coalesce(is_auth_failure(), F.lit(False)),
        "_base64": scalar.has_base64_run(command), "_keyword": scalar.first_keyword(command),
    })
    s = signals()
    return df.withColumns({
        "ml_pillar": F.col("ml_confidence") * 100.0,
        "behaviour_pillar": _points([(s.new_user, 30.0), (s.new_ip, 20.0), (s.odd_command, 50.0), (s.failed_often, 40.0)]),
        "intel_pillar": _points([(s.base64, 60.0), (s.keyword, 40.0), (s.port, 30.0)]),
        "asset_points": _points([(s.critical_host, 50.0)]),
    })


def _temporal(df: DataFrame) -> DataFrame:
    return df.withColumn("temporal_pillar", _points([(signals().brute_force, 80.0)]))


def weighted_risk(history: Column, weights: dict[str, float] = K.RISK_WEIGHTS) -> Column:
    total = (
        F.lit(weights["ml"]) * F.col("ml_pillar") + F.lit(weights["behaviour"]) * F.col("behaviour_pillar")
        + F.lit(weights["threat_intel"]) * F.col("intel_pillar") + F.lit(weights["historical"]) * history
        + F.lit(weights["temporal"]) * F.col("temporal_pillar")
    )
    return scalar.clip(total, 0, 100)


def history_points(past: Column) -> Column:
    return F.least(F.lit(100.0), F.col("asset_points") + F.when(past > _PAST_LIMIT, F.lit(40.0)).otherwise(F.lit(0.0)))


# --- the fold --------------------------------------------------------------------
def _step(past: float | None, calm: float, tense: float) -> tuple[float, float]:
    """Risk of one event and the mean after it."""
    risk = tense if past is not None and past > _PAST_LIMIT else calm
    return risk, (risk if past is None else past) * K.RISK_MEMORY + risk * (1.0 - K.RISK_MEMORY)


def _summarise(who: str, calm: list[float], tense: list[float], bucket: int) -> list[dict]:
    """What a run of events does to any mean entering it: pieces of one slope, and a fresh start."""
    slope, pieces = 1.0, [(0.0, 0.0)]
    fresh = None
    for low, high in zip(calm, tense):
        _, fresh = _step(fresh, low, high)
        split: list[tuple[float, float]] = []
        for i, (start, shift) in enumerate(pieces):
            stop = pieces[i + 1][0] if i + 1 < len(pieces) else float("inf")
            # Entries above this value arrive at over 80 here.
            turn = (_PAST_LIMIT - shift) / slope if slope > 1e-300 else (float("inf") if shift <= _PAST_LIMIT else -1.0)
            if turn > start:
                split.append((start, shift * K.RISK_MEMORY + low * (1.0 - K.RISK_MEMORY)))
            if turn < stop:
                split.append((max(start, turn), shift * K.RISK_MEMORY + high * (1.0 - K.RISK_MEMORY)))
        pieces = [p for i, p in enumerate(split) if i == 0 or p[1] != split[i - 1][1]]
        slope *= K.RISK_MEMORY
    return [{
        "_who": who, "_bucket": bucket, "slope": slope, "fresh": fresh,
        "starts": [p[0] for p in pieces], "shifts": [p[1] for p in pieces],
    }]


def _run_summaries(pdf: pd.DataFrame) -> pd.DataFrame:
    """Summaries of the runs touching the edges of a bucket; inner users are complete anyway."""
    pdf = pdf.sort_values("_pos")
    edges = dict.fromkeys([pdf["_who"].iloc[0], pdf["_who"].iloc[-1]])
    out = []
    for who in edges:
        run = pdf[pdf["_who"] == who]
        out += _summarise(who, run["_calm"].tolist(), run["_tense"].tolist(), int(pdf["_bucket"].iloc[0]))
    return pd.DataFrame(out)


def _arrive(past: float, slope: float, starts, shifts) -> float:
    """The mean after a run that ``past`` enters."""
    return slope * past + shifts[max(int(np.searchsorted(starts, past)) - 1, 0)]


def _compose(slope: float, starts: list[float], shifts: list[float], then) -> tuple[float, list[float], list[float]]:
    """One summary of two runs: the values leaving the first enter the second (a row with slope, starts and shifts)."""
    new_starts: list[float] = []
    new_shifts: list[float] = []
    for i, (start, shift) in enumerate(zip(starts, shifts)):
        stop = starts[i + 1] if i + 1 < len(starts) else float("inf")
        for j, (turn, extra) in enumerate(zip(then.starts, then.shifts)):
            # Entries above ``low`` and up to ``high`` leave the first run inside this piece of the second.
            if slope > 1e-300:
                low = (turn - shift) / slope if j else float("-inf")
                high = (then.starts[j + 1] - shift) / slope if j + 1 < len(then.starts) else float("inf")
            else:
                inside = (not j or shift > turn) and (j + 1 == len(then.starts) or shift <= then.starts[j + 1])
                low, high = (float("-inf"), float("inf")) if inside else (float("inf"), float("inf"))
            if low < stop and high > start:
                value = shift * then.slope + extra
                if not new_shifts or new_shifts[-1] != value:
                    new_starts.append(max(start, low))
                    new_shifts.append(value)
    return slope * then.slope, new_starts, new_shifts


def _compose_run(pdf: pd.DataFrame) -> pd.DataFrame:
    """The summary of a run of one user's summaries."""
    rows = list(pdf.sort_values("_bucket").itertuples(index=False))
    slope, starts, shifts, fresh = rows[0].slope, list(rows[0].starts), list(rows[0].shifts), rows[0].fresh
    for row in rows[1:]:
        slope, starts, shifts = _compose(slope, starts, shifts, row)
        fresh = _arrive(fresh, row.slope, row.starts, row.shifts)
    return pd.DataFrame([{"_who": rows[0][0], "_bucket": int(pdf["_run"].iloc[0]), "slope": slope, "fresh": fresh, "starts": starts, "shifts": shifts}])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The value entering each summary of a run, from the value entering the run."""
    pdf = pdf.sort_values("_bucket")
    past, rows = pdf["_entry"].iloc[0], []
    past = None if pd.isna(past) else float(past)
    columns = zip(pdf["_bucket"], pdf["_who"], pdf["fresh"], pdf["slope"], pdf["starts"], pdf["shifts"])
    for bucket, who, fresh, slope, starts, shifts in columns:
        rows.append((bucket, who, past))
        past = fresh if past is None else _arrive(past, slope, starts, shifts)
    return pd.DataFrame(rows, columns=["_bucket", "_who", "_entry"])


_SUMMARY = "_who string, _bucket long, slope double, fresh double, starts array<double>, shifts array<double>"


def _entries(runs: DataFrame, start: DataFrame, block: int) -> DataFrame:
    """(_bucket, _who, _entry): the value entering each summary, by a tree of runs of ``block`` summaries of a user.

    ``start`` (_who, initial) enters the first one. A user without it enters with null.
    """
    placed = runs.withColumn("_run", F.floor(F.col("_bucket") / block).cast("long"))
    if (runs.agg(F.max("_bucket")).first()[0] or 0) < block:
        above = placed.select("_who", "_run").distinct().join(start, "_who", "left").withColumnRenamed("initial", "_entry")
    else:
        composed = durable(placed.groupBy("_who", "_run").applyInPandas(_compose_run, _SUMMARY))
        above = _entries(composed, start, block).withColumnRenamed("_bucket", "_run")
    return placed.join(above, ["_who", "_run"]).groupBy("_who", "_run").applyInPandas(_chain, "_bucket long, _who string, _entry double")


def _replay(pdf: pd.DataFrame, number: str) -> pd.DataFrame:
    """Risk, past risk and mean of every event of a bucket, users one after the other."""
    pdf = pdf.sort_values("_pos")
    current, past, before, risks, after = None, None, [], [], []
    for who, low, high, entry in zip(pdf["_who"], pdf["_calm"], pdf["_tense"], pdf["_entry"]):
        if who != current:
            current, past = who, (None if pd.isna(entry) else float(entry))
        before.append(0.0 if past is None else past)
        risk, past = _step(past, low, high)
        risks.append(risk)
        after.append(past)
    return pd.DataFrame({number: pdf[number], "past_risk": before, "final_risk": risks, "user_risk": after})


def user_risk_fold(
    df: DataFrame, order: tuple[str, ...], initial: DataFrame | None = None, bucket_rows: int = BUCKET_ROWS,
    number: str = "doc_id", scan_block: int = SCAN_BLOCK,
) -> DataFrame:
    """Fold the risk per ``_who`` in order. Needs ``_calm`` and ``_tense``: the risk without and with a bad past.

    ``initial`` (``_who``, ``initial``) carries the mean of earlier batches. Adds ``past_risk``,
    ``final_risk`` and ``user_risk`` (the mean after the event). Only the narrow columns are ordered;
    the result returns to the rows by their unique ``number``.
    """
    spark = df.sparkSession
    columns = list(dict.fromkeys([number, "_who", *order, "_calm", "_tense"]))
    placed = global_position(df.select(*columns), ["_who", *order])
    narrow = placed.select(
        number, "_pos", F.floor(F.col("_pos") / bucket_rows).cast("long").alias("_bucket"), "_who", "_calm", "_tense")
    start = initial if initial is not None else spark.createDataFrame([], "_who string, initial double")
    entries = _entries(durable(narrow.groupBy("_bucket").applyInPandas(_run_summaries, _SUMMARY)), start, scan_block)
    # Users inside one bucket have no run of their own in ``entries``; they only need the initial value.
    with_entry = narrow.join(entries, ["_bucket", "_who"], "left")
    if initial is not None:
        with_entry = with_entry.join(start, "_who", "left").withColumn(
            "_entry", F.coalesce("_entry", "initial")).drop("initial")
    kind = df.schema[number].dataType.simpleString()

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        return _replay(pdf, number)

    folded = with_entry.groupBy("_bucket").applyInPandas(
        replay, f"{number} {kind}, past_risk double, final_risk double, user_risk double")
    return df.join(folded, number)


def scored_risk(
    df: DataFrame, order: tuple[str, ...] = ("ts", "doc_id"), initial: DataFrame | None = None,
    bucket_rows: int = BUCKET_ROWS, number: str = "doc_id", window: int = K.FAILURE_WINDOW,
) -> DataFrame:
    """Pillars and final risk at once. Needs the same columns as ``with_pillars``.

    The rows are stored once. Both orders, by time for the failures and by user for the fold, run over the few numbers
    they need; their outcome meets the rows in one join.
    """
    ready = durable(_static(df))
    pillars = ["ml_pillar", "behaviour_pillar", "intel_pillar", "asset_points"]
    narrow = ready.select(number, *[c for c in order if c != number], "_who", "_failed", *pillars)
    narrow = _temporal(failures_in_window(narrow, "_who", "_failed", list(order), "_recent", window))
    narrow = durable(_calm_and_tense(narrow).select(number, *[c for c in order if c != number], "_who", "_recent", "temporal_pillar", "_calm", "_tense"))
    folded = user_risk_fold(narrow, order, initial, bucket_rows, number)
    return _finished(ready.join(folded.select(number, "_recent", "temporal_pillar", "past_risk", "final_risk", "user_risk"), number))


def _calm_and_tense(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "_calm": weighted_risk(history_points(F.lit(0.0))), "_tense": weighted_risk(history_points(F.lit(100.0))),
    })


def _finished(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "history_pillar": history_points(F.col("past_risk")),
        "risk_score": F.floor("final_risk").cast("int"), "risk_level": scalar.score_level(F.col("final_risk")),
        "confidence": F.floor(F.col("ml_confidence") * 100).cast("int"),
    })


def latest_user_risk(df: DataFrame, order: tuple[str, ...] = ("ts", "doc_id")) -> DataFrame:
    """Mean of each user after its last event: the state for the next batch."""
    return df.groupBy("_who").agg(F.max_by("user_risk", F.struct(*order)).alias("initial"))


# --- texts -----------------------------------------------------------------------
def with_report(df: DataFrame) -> DataFrame:
    """Contributors by score, techniques, action and explanation of rows with risk."""
    s = signals()
    past = F.col("past_risk") > _PAST_LIMIT
    port = F.col("destination_port").cast("string")
    detail = lambda parts: F.array_join(_texts(parts), ", ")
    behaviour = detail([
        (s.new_user, F.lit(K.REPORT_NEW_USER)), (s.new_ip, F.lit(K.REPORT_NEW_IP)),
        (s.odd_command, F.lit(K.REPORT_ODD_COMMAND)), (s.failed_often, F.lit(K.REPORT_FAILED_OFTEN))])
    intel = detail([
        (s.base64, F.lit(K.REPORT_BASE64)),
        (s.keyword, F.concat(F.lit(K.REPORT_KEYWORD), F.col("_keyword"))),
        (s.port, F.concat(F.lit(K.REPORT_PORT), port))])
    history = detail([
        (s.critical_host, F.lit(K.REPORT_ASSET)),
        (past, F.lit(K.REPORT_PAST))])
    pillar = lambda place, name, score, shown, text: F.when(shown, F.struct(
        (-score).alias("rank"), F.lit(place).alias("place"), F.lit(name).alias("pillar"), score.alias("score"),
        text.alias("detail")))
    listed = F.array_compact(F.array(
        pillar(0, "Machine Learning", F.col("ml_pillar"), F.col("ml_pillar") > 60,
               F.lit(K.REPORT_MODELS)),
        pillar(1, "Behavioural", F.col("behaviour_pillar"), F.col("behaviour_pillar") > 0, behaviour),
        pillar(2, "Threat Intelligence", F.col("intel_pillar"), F.col("intel_pillar") > 0, intel),
        pillar(3, "Historical Context", F.col("history_pillar"), F.col("history_pillar") > 0, history),
        pillar(4, "Temporal Correlation", F.col("temporal_pillar"), F.col("temporal_pillar") > 0,
               F.lit(K.REPORT_BRUTE_FORCE)),
    ))
    points = _texts([
        (F.col("ml_pillar") > 60, F.lit(K.REASON_MODELS)),
        (s.new_user, F.lit(K.REASON_NEW_USER)),
        (s.new_ip, F.lit(K.REASON_NEW_IP)),
        (s.odd_command, F.lit(K.REASON_ODD_COMMAND)),
        (s.failed_often, F.lit(K.REASON_FAILED_OFTEN)),
        (s.base64, F.lit(K.REASON_BASE64)),
        (s.keyword, F.concat(F.lit(K.REASON_KEYWORD), F.col("_keyword"), F.lit("'"))),
        (s.port, F.concat(F.lit(K.REASON_PORT), port)),
        (s.critical_host, F.lit(K.REASON_ASSET)),
        (past, F.lit(K.REASON_PAST)),
        (s.brute_force, F.lit(K.REASON_BRUTE_FORCE)),
    ])
    df = df.withColumn("_points", points)
    n = F.size("_points")
    lead = F.lit(K.REASON_LEAD)
    explanation = (
        F.when(n == 0, K.REASON_NONE)
        .when(n == 1, F.concat(lead, F.get("_points", F.lit(0)), F.lit(".")))
        .otherwise(F.concat(lead, F.array_join(F.slice("_points", F.lit(1), n - 1), ", "), F.lit(", and "),
                            F.element_at("_points", -1), F.lit("."))))
    hits = [s.base64, s.keyword, s.port, s.critical_host, s.brute_force]
    techniques = [K.TECHNIQUE_BASE64, K.TECHNIQUE_KEYWORD, K.TECHNIQUE_PORT, K.TECHNIQUE_ASSET, K.TECHNIQUE_BRUTE_FORCE]
    actions = [K.ACTION_BASE64, K.ACTION_KEYWORD, K.ACTION_PORT, K.ACTION_ASSET, K.ACTION_BRUTE_FORCE]
    return df.withColumns({
        "contributors": F.transform(F.array_sort(listed), lambda c: F.struct(c["pillar"], c["score"], c["detail"])),
        "mitre": _texts(list(zip(hits, map(F.lit, techniques)))),
        "recommended_action": F.coalesce(*[F.when(h, a) for h, a in zip(hits, actions)], F.lit(K.ACTION_DEFAULT)),
        "explanation": explanation,
    }).drop("_points")
