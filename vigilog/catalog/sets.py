"""SET: entity sets, histories and counters."""

from pyspark.sql import functions as F

from ..sources import state
from ..sources.logs import opening, afterwards, logs
from .features import on_batch
from .registry import query


def both(spark, sf, *columns):
    df = logs(spark, sf).select("ts", *columns)
    return opening(df), afterwards(df)


@query("set1_unseen_entities", on_batch(
    "SELECT source_ip FROM b WHERE source_ip IS NOT NULL EXCEPT SELECT source_ip FROM seen"))
def _(spark, sf):
    old, new = both(spark, sf, "source_ip")
    return state.unseen(new, old.filter("source_ip IS NOT NULL"), "source_ip")


@query("set2_seen_union", on_batch(
    "SELECT source_ip FROM b WHERE source_ip IS NOT NULL UNION SELECT source_ip FROM seen WHERE source_ip IS NOT NULL"))
def _(spark, sf):
    old, new = both(spark, sf, "source_ip")
    return state.seen_after(old.filter("source_ip IS NOT NULL").distinct(), new, "source_ip")


@query("set3_append_history", on_batch("SELECT doc_id, user_name FROM seen UNION ALL SELECT doc_id, user_name FROM b"))
def _(spark, sf):
    old, new = both(spark, sf, "doc_id", "user_name")
    return old.unionByName(new).select("doc_id", "user_name")


@query("set4_merge_counters", on_batch(
    "SELECT user_name, count(*) AS n FROM (SELECT user_name FROM seen UNION ALL SELECT user_name FROM b) WHERE user_name IS NOT NULL "
    "GROUP BY 1"))
def _(spark, sf):
    count = lambda df: df.filter("user_name IS NOT NULL").groupBy("user_name").agg(F.count(F.lit(1)).alias("n"))
    old, new = both(spark, sf, "user_name")
    return state.merge_counts(count(old), count(new), "user_name")
