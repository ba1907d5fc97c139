"""Sorted pages, cursors, top-k lists and full exports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.fields import keep_existing
from .filters import LogQuery


def page_by_offset(df: DataFrame, query: LogQuery, page: int, order: Sequence[str] = ("ts", "doc_id")) -> DataFrame:
    """One page in time order. Meant for the first pages; deep pages go by cursor."""
    size = query.page_size
    keys = [F.col(c).desc() if query.descending else F.col(c).asc() for c in order]
    rows = query.apply(df).orderBy(*keys).offset(page * size).limit(size)
    return keep_existing(rows, query.columns) if query.columns else rows


def page_info(df: DataFrame, query: LogQuery, page: int) -> DataFrame:
    """Total matches and whether a further page exists."""
    size = query.page_size
    total = F.count(F.lit(1))
    return query.apply(df).agg(
        total.alias("total"), (total > F.lit((page + 1) * size)).alias("has_next")
    )


def after_cursor(df: DataFrame, order: Sequence[str], cursor: Sequence[object]) -> DataFrame:
    """Rows strictly behind the cursor in ascending order.

    The leading column is also bounded on its own, which is what the scan can push down.
    """
    values = [F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, cursor)]
    behind = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)]) > F.struct(
        *[v.alias(f"k{i}") for i, v in enumerate(values)]
    )
    return df.filter((F.col(order[0]) >= values[0]) & behind)


def page_by_cursor(df: DataFrame, order: Sequence[str], size: int, cursor: Sequence[object] | None = None) -> DataFrame:
    rows = df if cursor is None else after_cursor(df, order, cursor)
    return rows.orderBy(*order).limit(size)


def all_pages(df: DataFrame, order: Sequence[str], size: int) -> Iterator[list[Row]]:
    """Walk a result page by page; each page is one pushed-down top-k job."""
    cursor = None
    while True:
        rows = page_by_cursor(df, order, size, cursor).collect()
        if not rows:
            return
        yield rows
        cursor = [rows[-1][c] for c in order]


def export(df: DataFrame, path: str, partition_by: Sequence[str] = (), file_format: str = "parquet") -> None:
    """Full export: every executor writes its own part."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(file_format).save(path)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Per-partition top k merged at the end; never a full sort."""
    return df.orderBy(*order).limit(k)


def most_recent(df: DataFrame, ts: str, tie: str, n: int) -> DataFrame:
    return top_k(df, [F.col(ts).desc_nulls_last(), F.col(tie).desc()], n)


def repeatable_sample(df: DataFrame, number: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows chosen by a hash of the row number and a seed; same rows on every run."""
    modulus = F.lit(2147483647)
    mixed = F.pmod(F.pmod(F.col(number), modulus) * F.lit(1103515245) + F.lit(seed * 12345), modulus)
    return top_k(df.withColumn("_mixed", mixed), [F.col("_mixed"), F.col(number)], n).drop("_mixed")


def top_events(df: DataFrame, condition: Column, k: int = 500, score: str = "anomaly_score", tie: str = "doc_id") -> DataFrame:
    """Best scored events fulfilling a condition."""
    return top_k(df.filter(condition), [F.col(score).desc(), F.col(tie)], k)
