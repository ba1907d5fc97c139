"""SRC: scans, exports and state tables."""

from pyspark.sql import functions as F

from ..operators import paging
from ..operators.filters import ntz
from ..session import scratch_path
from ..sources import readers, state
from ..sources.logs import logs, table
from .registry import on_logs, query

CSV_COLUMNS = ["doc_id", "host_name", "command_line", "network_bytes"]


@query("src1_columnar_scan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49")
def _(spark, sf):
    return readers.read_columns(spark, f"{sf}/lineitem.parquet").filter("l_quantity > 49").select(
        "l_orderkey", "l_linenumber")


@query("src2_csv_scan", on_logs(f"SELECT {', '.join(CSV_COLUMNS)} FROM logs"))
def _(spark, sf):
    path = scratch_path(spark, "csv")
    df = logs(spark, sf).select(*CSV_COLUMNS)
    df.write.csv(path, header=True)
    return readers.read_csv(spark, path, df.schema)


@query("src3_raw_csv_scan", on_logs(
    "SELECT doc_id AS agent, host_name AS process, CAST(network_bytes AS VARCHAR) AS \"@timestamp\" FROM logs"))
def _(spark, sf):
    path = scratch_path(spark, "rawcsv")
    logs(spark, sf).select("doc_id", "host_name", F.col("network_bytes").cast("string")).write.csv(path, header=True)
    return readers.read_raw_csv(spark, path).select("agent", "process", "@timestamp")


@query("src5_most_recent", on_logs("SELECT doc_id, ts FROM logs ORDER BY ts DESC, doc_id DESC LIMIT 2500"))
def _(spark, sf):
    return paging.most_recent(logs(spark, sf).select("doc_id", "ts"), "ts", "doc_id", 2500)


@query("src6_repeatable_sample", (
    "SELECT event_id FROM events ORDER BY (event_id % 2147483647 * 1103515245 + 518490) % 2147483647, event_id LIMIT 777"))
def _(spark, sf):
    return paging.repeatable_sample(table(spark, sf, "events").select("event_id"), "event_id", 777)


@query("src8_full_export", on_logs("SELECT doc_id, event_category, ts FROM logs"))
def _(spark, sf):
    path = scratch_path(spark, "export")
    paging.export(logs(spark, sf).select("doc_id", "event_category", "ts"), path, ["event_category"])
    return readers.read_columns(spark, path)


@query("src9_partitioned_read", on_logs(
    "SELECT doc_id, CAST(ts AS DATE) AS day FROM logs WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'"))
def _(spark, sf):
    path = scratch_path(spark, "bydate")
    readers.write_partitioned(logs(spark, sf).select("doc_id", F.to_date("ts").alias("day")), path, ["day"])
    return readers.read_partitions(spark, path, F.col("day").between("2024-01-10", "2024-01-12"))


@query("src9_origin", "SELECT 'lineitem.parquet' AS origin, count(*) AS n FROM lineitem")
def _(spark, sf):
    return readers.with_origin(table(spark, sf, "lineitem")).groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@query("src10_state_round_trip", on_logs(
    "SELECT user_name, count(*) AS n FROM logs WHERE user_name IS NOT NULL AND ts < TIMESTAMP '2024-01-21' GROUP BY 1"))
def _(spark, sf):
    kept = state.StateTable(spark, scratch_path(spark, "state"), "user_name string, n long")
    df = logs(spark, sf).filter("user_name IS NOT NULL")
    days = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-02-01"]
    for batch in range(3):
        part = df.filter((F.col("ts") >= ntz(days[batch])) & (F.col("ts") < ntz(days[batch + 1])))
        counts = part.groupBy("user_name").agg(F.count(F.lit(1)).alias("n"))
        kept.write(counts, batch)
        kept.write(counts, batch)
    return state.merge_counts(kept.before(2), kept.before(0), "user_name")


@query("src10_keyed_state", on_logs("SELECT user_name, count(*) AS n FROM logs WHERE user_name IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    """Counters kept in buckets of keys: the last period is written twice, as after a failure."""
    kept = state.KeyedStateTable(
        spark, scratch_path(spark, "state"), "user_name", "user_name string, n long",
        lambda rows: rows.groupBy("user_name").agg(F.sum("n").alias("n")), buckets=8)
    df = logs(spark, sf).filter("user_name IS NOT NULL")
    day = F.to_date("ts").cast("string")
    for batch, part in enumerate([day < "2024-01-11", (day >= "2024-01-11") & (day < "2024-01-21"), day >= "2024-01-21"]):
        counts = df.filter(part).groupBy("user_name").agg(F.count(F.lit(1)).alias("n"))
        kept.write(counts, batch)
    kept.write(counts, batch)
    return kept.before()
