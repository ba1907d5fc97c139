"""PRJ: nested text to columns, field resolution, projections."""

from pyspark.sql import functions as F

from ..functions import fields
from ..operators import flatten as fl
from ..sources.logs import logs, raw_logs
from .registry import on_logs, on_raw, query

_JSON = "CASE WHEN event LIKE '%\"%' THEN event ELSE replace(replace(replace(event, chr(39), '\"'), 'True', 'true'), 'None', 'null') END"


def _get(path: str, source: str = "j") -> str:
    return f"json_extract_string({source}, '{path}')"


_PARSED = f"SELECT event_no, CASE WHEN event = 'oops' THEN NULL ELSE {_JSON} END AS j, host, \"user\" AS u, process FROM raw_logs"


@query("prj1_parse_dict_text", on_raw(
    f"SELECT event_no, {_get('$.kind')} AS kind, {_get('$.category')} AS category, {_get('$.ok')} AS ok, "
    "j IS NOT NULL AS parsed FROM p", p=_PARSED))
def _(spark, sf):
    df = raw_logs(spark, sf).select("event_no", fl.parse_dict_text(F.col("event")).alias("v"))
    return df.select("event_no", *[fl.path_value(F.col("v"), c).alias(c) for c in ("kind", "category", "ok")],
                     F.col("v").isNotNull().alias("parsed"))


_TAGS = "CASE WHEN j IS NULL THEN NULL WHEN event_no % 2 = 0 THEN 'a, b' ELSE 'a, b, c, d, e, f' END"
_HOST_Q = "CASE WHEN event_no % 2 = 0 THEN replace(host, chr(39), '\"') ELSE host END"
_HOST_IP = "CASE WHEN event_no % 2 = 0 THEN concat('10.1.0.', event_no % 40, ', ::1') ELSE '' END"


@query("prj2_flatten", on_raw(
    f"SELECT event_no, {_get('$.action')} AS event_action, {_get('$.category')} AS event_category, "
    f"{_get('$.kind')} AS event_kind, CAST({_get('$.ok')} AS BOOLEAN) AS event_ok, {_TAGS} AS event_tags, "
    f"{_HOST_IP} AS host_ip, {_get('$.name', _HOST_Q)} AS host_name, "
    f"CAST({_get('$.os.build.major', _HOST_Q)} AS BIGINT) AS host_os_build_major, "
    f"{_get('$.os.family', _HOST_Q)} AS host_os_family FROM p", p=_PARSED))
def _(spark, sf):
    return fl.flatten_text(raw_logs(spark, sf).select("event_no", "event", "host"), ["event", "host"])


@query("prj3_flatten_limited", on_raw(
    f"SELECT event_no, {_get('$.action')} AS event_action, {_get('$.category')} AS event_category, "
    f"{_get('$.kind')} AS event_kind, CAST({_get('$.ok')} AS BOOLEAN) AS event_ok, "
    f"CASE WHEN j IS NULL THEN NULL WHEN event_no % 2 = 0 THEN 'a, b' ELSE '[6 items]' END AS event_tags, "
    f"{_HOST_IP} AS host_ip, {_get('$.name', _HOST_Q)} AS host_name, "
    f"concat('{{\"major\":', event_no % 4, '}}') AS host_os_build, {_get('$.os.family', _HOST_Q)} AS host_os_family, "
    f"'{{}}' AS user_meta, {_get('$.name', 'replace(u, chr(39), chr(34))')} AS user_name FROM p", p=_PARSED))
def _(spark, sf):
    df = raw_logs(spark, sf).select("event_no", "event", "host", "user")
    return fl.flatten_text(df, ["event", "host", "user"], depth=2, long_lists=5)


_PROC = "replace(process, chr(39), '\"')"


@query("prj4_side_by_side", on_raw(
    f"SELECT event_no, ts, {_get('$.name', _PROC)} AS process_name, CAST({_get('$.args_count', _PROC)} AS BIGINT) "
    f"AS process_args_count, {_get('$.parent.name', _PROC)} AS process_parent_name FROM raw_logs"))
def _(spark, sf):
    return fl.flatten_text(raw_logs(spark, sf).select("event_no", "ts", "process"), ["process"])


@query("prj5_hits_to_rows", on_raw(
    f"SELECT CAST(event_no AS VARCHAR) AS _id, 'logs' AS _index, {_get('$.name', _PROC)} AS name, "
    f"CAST({_get('$.args_count', _PROC)} AS BIGINT) AS args_count, {_get('$.parent.name', _PROC)} AS parent_name FROM raw_logs"))
def _(spark, sf):
    hits = raw_logs(spark, sf).select(
        F.col("event_no").cast("string").alias("_id"), F.lit("logs").alias("_index"),
        fl.parse_dict_text(F.col("process")).alias("source"))
    return fl.hits_to_rows(hits)


@query("prj6_alias_resolution", on_logs(
    "SELECT doc_id, host_name AS host, coalesce(user_name, host_name) AS entity FROM logs"))
def _(spark, sf):
    df = logs(spark, sf).select(
        "doc_id", F.col("host_name"), F.col("user_name").alias("user.name"), F.col("host_name").alias("username"))
    return df.select("doc_id", fields.field(df, "hostname").alias("host"),
                     fields.first_filled(df, "username").alias("entity"))


@query("prj7_rename", on_logs("SELECT doc_id, source_ip AS src FROM logs"))
def _(spark, sf):
    df = logs(spark, sf).select("doc_id", "source_ip")
    return fields.rename_existing(df, {"source_ip": "src", "absent": "x"})


@query("prj8_drop_metadata", on_logs("SELECT doc_id, ts FROM logs"))
def _(spark, sf):
    from ..constants import METADATA_COLUMNS

    df = logs(spark, sf).select("doc_id", "ts", F.col("doc_id").alias("_id"), F.lit("logs").alias("_index"))
    return fields.drop_metadata(df, METADATA_COLUMNS)


@query("prj9_select_existing", on_logs("SELECT doc_id, event_action FROM logs"))
def _(spark, sf):
    return fields.keep_existing(logs(spark, sf), ["doc_id", "absent", "event_action"])


@query("prj10_nested_path", on_raw(
    f"SELECT event_no, {_get('$.parent.name', _PROC)} AS parent, CAST(NULL AS VARCHAR) AS missing FROM raw_logs"))
def _(spark, sf):
    v = fl.parse_dict_text(F.col("process"))
    return raw_logs(spark, sf).select("event_no", v.alias("v")).select(
        "event_no", fl.path_value(F.col("v"), "parent.name").alias("parent"),
        fl.path_value(F.col("v"), "parent.name.first").alias("missing"))


@query("prj11_entity", on_raw(
    f"SELECT event_no, coalesce(nullif({_get('$.name', 'replace(u, chr(39), chr(34))')}, ''), "
    "concat('flat-', event_no)) AS entity FROM p", p=_PARSED))
def _(spark, sf):
    v = fl.parse_dict_text(F.col("user"))
    df = raw_logs(spark, sf).select("event_no", v.alias("v"), F.concat(F.lit("flat-"), "event_no").alias("flat"))
    return df.select("event_no", fields.entity_of(fl.path_value(F.col("v"), "name"), F.col("flat")).alias("entity"))
