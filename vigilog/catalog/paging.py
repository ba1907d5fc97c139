"""TOP: sorted pages, cursors and top-k lists."""

from pyspark.sql import functions as F

from ..operators import paging
from ..operators.filters import LogQuery
from ..operators.threat import threat_level, with_threat_level
from ..sources.logs import logs, scored, table
from .registry import on_logs, on_scored, query

TOP_COLUMNS = ["doc_id", "ts", "host_name", "user_name", "anomaly_score", "threat_level"]
LEVEL_SQL = (
    "CASE WHEN regexp_matches(lower(coalesce(command_line, '')), "
    "'base64|encodedcommand|-enc |iex |invoke-expression|wget|curl|downloadstring|bitstransfer|-w hidden|"
    "-windowstyle hidden|bypass') THEN 'Critical' "
    "WHEN user_name IN ('SYSTEM', 'Administrator', 'root') AND is_anomaly THEN 'Critical' "
    "WHEN lower(process_name) IN ('powershell.exe', 'cmd.exe', 'wscript.exe', 'cscript.exe', 'mshta.exe', "
    "'rundll32.exe', 'regsvr32.exe', 'certutil.exe', 'bitsadmin.exe', 'psexec.exe', 'wmic.exe', 'schtasks.exe', "
    "'net.exe', 'net1.exe', 'whoami.exe', 'ipconfig.exe') "
    "THEN CASE WHEN is_anomaly THEN 'High Threat' ELSE 'Suspicious' END ELSE 'Normal' END"
)


def on_levels(body: str, **ctes: str) -> str:
    return on_scored(body, levels=f"SELECT *, {LEVEL_SQL} AS threat_level FROM scored", **ctes)


def levels(spark, sf):
    return with_threat_level(scored(logs(spark, sf)))


@query("top1_offset_page", on_logs(
    "SELECT doc_id, ts, host_name FROM logs WHERE contains(lower(host_name), 'ws') "
    "ORDER BY ts DESC, doc_id DESC LIMIT 50 OFFSET 100"))
def _(spark, sf):
    q = LogQuery(hostname="ws", page_size=50, columns=["doc_id", "ts", "host_name", "absent"])
    return paging.page_by_offset(logs(spark, sf), q, page=2)


@query("top1_page_info", on_logs(
    "SELECT count(*) AS total, count(*) > 150 AS has_next FROM logs WHERE contains(lower(host_name), 'ws')"))
def _(spark, sf):
    return paging.page_info(logs(spark, sf), LogQuery(hostname="ws", page_size=50), page=2)


@query("top2_cursor_page", (
    "SELECT event_id, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 0) "
    "ORDER BY ts, event_id LIMIT 100"))
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "ts")
    return paging.page_by_cursor(df, ["ts", "event_id"], 100, ["2024-01-10 00:00:00", 0])


def _top(levels_sql: str) -> str:
    return on_levels(
        f"SELECT {', '.join(TOP_COLUMNS)} FROM levels WHERE {levels_sql} ORDER BY anomaly_score DESC, doc_id LIMIT 500")


@query("top4_critical_events", _top("threat_level IN ('Critical', 'High Threat')"))
def _(spark, sf):
    df = levels(spark, sf)
    return paging.top_events(df, F.col("threat_level").isin("Critical", "High Threat")).select(*TOP_COLUMNS)


@query("top5_suspicious_events", _top("threat_level = 'Suspicious'"))
def _(spark, sf):
    return paging.top_events(levels(spark, sf), F.col("threat_level") == "Suspicious").select(*TOP_COLUMNS)


@query("top6_anomaly_events", _top("is_anomaly"))
def _(spark, sf):
    return paging.top_events(levels(spark, sf), F.col("is_anomaly")).select(*TOP_COLUMNS)


@query("top7_top_by_score", on_scored(
    "SELECT doc_id, anomaly_score FROM scored ORDER BY anomaly_score DESC, doc_id LIMIT 500"))
def _(spark, sf):
    df = scored(logs(spark, sf))
    return paging.top_k(df, [F.col("anomaly_score").desc(), F.col("doc_id")], 500).select("doc_id", "anomaly_score")


@query("top9_rows_per_day", on_logs(
    "SELECT date_trunc('day', ts) AS day, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, day"))
def _(spark, sf):
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day")
    return logs(spark, sf).groupBy(day).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "day")


@query("thr1_threat_level", on_levels("SELECT doc_id, threat_level FROM levels"))
def _(spark, sf):
    df = scored(logs(spark, sf))
    return df.select("doc_id", threat_level(df).alias("threat_level"))
