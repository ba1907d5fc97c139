"""FLT: predicates and the reader's filter."""

from pyspark.sql import functions as F

from ..operators import filters as flt
from ..sources.logs import logs, table
from .registry import on_logs, query

START, END = "2024-01-05 00:00:00", "2024-01-12 12:00:00"
RANGE = f"ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"


@query("flt2_time_range", on_logs(f"SELECT doc_id, ts FROM logs WHERE {RANGE}"))
def _(spark, sf):
    df = logs(spark, sf)
    return df.filter(flt.time_range(F.col("ts"), START, END)).select("doc_id", "ts")


@query("flt3_exact_term", on_logs("SELECT doc_id, host_name FROM logs WHERE host_name = 'DC-1'"))
def _(spark, sf):
    return logs(spark, sf).filter(flt.term(F.col("host_name"), "DC-1")).select("doc_id", "host_name")


@query("flt4_in_list", on_logs(
    "SELECT doc_id, event_category FROM logs WHERE event_category IN ('process', 'network')"))
def _(spark, sf):
    return flt.terms_semi(logs(spark, sf), "event_category", ["process", "network"]).select("doc_id", "event_category")


@query("flt4_in_long_list", "SELECT event_id, user_id FROM events WHERE user_id % 2 = 1 AND user_id < 4001")
def _(spark, sf):
    return flt.terms_semi(table(spark, sf, "events"), "user_id", list(range(1, 4001, 2))).select("event_id", "user_id")


@query("flt5_match_words", (
    "SELECT doc_id FROM documents WHERE list_has_any("
    "string_split_regex(lower(text), '[^a-zA-Z0-9_]+'), ['the', 'license'])"))
def _(spark, sf):
    return table(spark, sf, "documents").filter(flt.match_text(F.col("text"), "The License")).select("doc_id")


@query("flt6_wildcard", "SELECT page_id, url FROM pages WHERE url LIKE 'http%1_.%' ESCAPE '\\' OR url LIKE '%/_'")
def _(spark, sf):
    hit = flt.wildcard(F.col("url"), "http*1?.*") | flt.wildcard(F.col("url"), "*/?")
    return table(spark, sf, "pages").filter(hit).select("page_id", "url")


@query("flt7_exists", on_logs("SELECT doc_id FROM logs WHERE source_ip IS NOT NULL"))
def _(spark, sf):
    return logs(spark, sf).filter(flt.exists(F.col("source_ip"))).select("doc_id")


@query("flt8_boolean_clause", on_logs(
    f"SELECT doc_id FROM logs WHERE {RANGE} AND event_category = 'authentication' "
    "AND (CASE WHEN host_name LIKE 'DC-%' THEN 1 ELSE 0 END + CASE WHEN user_name = 'root' THEN 1 ELSE 0 END "
    "+ CASE WHEN destination_port = 22 THEN 1 ELSE 0 END) >= 2 AND NOT coalesce(event_outcome = 'success', false)"))
def _(spark, sf):
    clause = flt.combine(
        must=[flt.term(F.col("event_category"), "authentication")],
        filter=[flt.time_range(F.col("ts"), START, END)],
        should=[flt.wildcard(F.col("host_name"), "DC-*"), flt.term(F.col("user_name"), "root"),
                flt.term(F.col("destination_port"), 22)],
        must_not=[flt.term(F.col("event_outcome"), "success")],
        minimum=2,
    )
    return logs(spark, sf).filter(clause).select("doc_id")


@query("flt9_contains", on_logs(
    "SELECT doc_id FROM logs WHERE contains(lower(user_name), 'user1') AND contains(lower(source_ip), '0.0.')"))
def _(spark, sf):
    q = flt.LogQuery(username="USER1*", source_ip="0.0.")
    return q.apply(logs(spark, sf)).select("doc_id")


@query("flt9_contains_regex", on_logs(
    "SELECT doc_id FROM logs WHERE regexp_matches(coalesce(source_ip, 'nan'), '(?i)10.0.(1|n)|an$')"))
def _(spark, sf):
    return logs(spark, sf).filter(flt.contains_text(F.col("source_ip"), "10.0.(1|n)|an$", regex=True)).select("doc_id")


@query("flt10_severity_category", on_logs(
    "SELECT doc_id, event_severity FROM logs WHERE lower(event_severity) IN ('critical', 'high') "
    "AND lower(event_category) IN ('file')"))
def _(spark, sf):
    q = flt.LogQuery(severities=["CRITICAL", "High"], categories=["FILE"])
    return q.apply(logs(spark, sf)).select("doc_id", "event_severity")


@query("flt11_any_column", (
    "SELECT event_id FROM events WHERE contains(lower(CAST(event_id AS VARCHAR)), '99') "
    "OR contains(CAST(user_id AS VARCHAR), '99') OR contains(lower(event_type), '99') OR contains(props, '99')"))
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    return df.filter(flt.any_column_contains(df, "99")).select("event_id")


@query("flt14_batch_of_ids", on_logs(
    "SELECT doc_id, user_name FROM logs WHERE doc_id IN (SELECT doc_id FROM logs WHERE event_action = 'sudo')"))
def _(spark, sf):
    from ..operators.lookup import semi_by_ids

    df = logs(spark, sf)
    return semi_by_ids(df, df.filter(F.col("event_action") == "sudo"), "doc_id").select("doc_id", "user_name")


@query("flt15_no_loopback", on_logs("SELECT doc_id, source_ip FROM logs WHERE source_ip NOT IN ('127.0.0.1', '::1')"))
def _(spark, sf):
    return logs(spark, sf).filter(flt.not_loopback(F.col("source_ip"))).select("doc_id", "source_ip")


@query("flt16_sanitize", on_logs(
    "SELECT doc_id, CASE WHEN event_no % 10 IN (0, 1) THEN NULL ELSE CAST(event_no AS DOUBLE) END AS x FROM logs "
    "ORDER BY event_no LIMIT 500"))
def _(spark, sf):
    inf = F.lit(float("inf"))
    n = F.col("event_no") % 10
    df = logs(spark, sf).select("doc_id", "event_no", F.when(n == 0, inf).when(n == 1, F.lit(float("nan"))).otherwise(
        F.col("event_no").cast("double")).alias("x"))
    return flt.sanitize(df, 500, ["event_no"]).select("doc_id", "x")


@query("flt18_count_matching", on_logs(
    f"SELECT count(*) AS n FROM logs WHERE {RANGE} AND contains(lower(host_name), 'dc-')"))
def _(spark, sf):
    q = flt.LogQuery(start=START, end=END, hostname="dc-")
    return q.apply(logs(spark, sf)).agg(F.count(F.lit(1)).alias("n"))
