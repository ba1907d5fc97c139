"""Streams over log files with state carried from micro-batch to micro-batch.

State lives in tables in the shared folder and is joined per key. That keeps hot keys harmless (a
micro-batch is combined per key before it meets the state) and makes a repeated micro-batch write
the same result again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.detectors.statistical import MOMENTS_SCHEMA, merge_moments, moments
from ..operators.lookup import attach_stats, key_stats, new_key_flag, profile_keys
from ..operators.risk import latest_user_risk, user_risk_fold
from ..sources.state import KeyedStateTable, StateTable, unseen


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files below ``path``, each read once."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything available now, micro-batch by micro-batch, then stop."""

    def guarded(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            step(kept, number)
        finally:
            kept.unpersist()

    query = stream.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    query.awaitTermination()
    return query


def _put(df: DataFrame, folder: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def batch_sizes(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Rows per micro-batch: shows that each new file is read exactly once."""
    return run_batches(stream, lambda b, n: _put(b.agg(F.count(F.lit(1)).alias("n")), out, n), checkpoint)


def new_entities(stream: DataFrame, key: str, state: StateTable, out: str, checkpoint: str) -> StreamingQuery:
    """Flag all rows of entities no earlier micro-batch held."""

    def step(batch: DataFrame, number: int) -> None:
        known = state.before(number)
        _put(new_key_flag(batch, key, known, "is_new"), out, number)
        state.write(unseen(batch, known, key), number)

    return run_batches(stream, step, checkpoint)


def entity_state(spark: SparkSession, path: str, key: str) -> StateTable:
    return StateTable(spark, path, f"{key} string", lambda df: df.distinct())


def burst_scores(stream: DataFrame, key: str, state: StateTable, out: str, checkpoint: str) -> StreamingQuery:
    """Share of a key's events so far that fall into this micro-batch; 1.0 for a null key."""

    def step(batch: DataFrame, number: int) -> None:
        counts = key_stats(batch, key, {"n": F.count(F.lit(1))})
        history = state.before(number).withColumnRenamed("n", "_history")
        stats = counts.join(history, key, "left").select(
            key, "_key_rows", (F.col("n") / (F.col("n") + F.coalesce("_history", F.lit(0)))).alias("burst"))
        scored = attach_stats(batch, key, stats, profile_keys(batch, [key]))
        _put(scored.withColumn("burst", F.coalesce("burst", F.lit(1.0))), out, number)
        state.write(counts.select(key, "n"), number)

    return run_batches(stream, step, checkpoint)


def counter_state(spark: SparkSession, path: str, key: str) -> StateTable:
    return StateTable(spark, path, f"{key} string, n long", lambda df: df.groupBy(key).agg(F.sum("n").alias("n")))


def running_moments(stream: DataFrame, features: list[str], state: StateTable, checkpoint: str) -> StreamingQuery:
    """Merge mean and variance of each micro-batch into the moments table."""
    return run_batches(stream, lambda b, n: state.write(moments(b, features), n), checkpoint)


def moments_state(spark: SparkSession, path: str) -> StateTable:
    return StateTable(spark, path, MOMENTS_SCHEMA, merge_moments)


def user_risk(
    stream: DataFrame, state: KeyedStateTable, out: str, checkpoint: str, order: tuple[str, ...] = ("ts", "doc_id")
) -> StreamingQuery:
    """Continue every user's risk fold from the mean the earlier micro-batches left.

    Rows carry ``_who``, ``_calm`` and ``_tense`` (the risk without and with a bad past). The rows of a user are folded
    by many tasks, so the state is a table of buckets of users and not one of the state store, which would bring all rows
    of a user into one task; a micro-batch reads and rewrites the buckets of its own users.
    """

    def step(batch: DataFrame, number: int) -> None:
        start = state.before(number, batch.select("_who")).select("_who", "initial")
        _put(user_risk_fold(batch, order, start), out, number)
        folded = batch.sparkSession.read.parquet(f"{out}/batch={number}")
        state.write(latest_user_risk(folded, order).withColumn("step", F.lit(number).cast("long")), number)

    return run_batches(stream, step, checkpoint)


def risk_state(spark: SparkSession, path: str) -> KeyedStateTable:
    return KeyedStateTable(
        spark, path, "_who", "_who string, initial double, step long",
        lambda df: df.groupBy("_who").agg(F.max_by("initial", "step").alias("initial"), F.max("step").alias("step")))


def event_time(stream: DataFrame, late: str) -> DataFrame:
    """Zone-free UTC times as instants, which is what watermarks work on."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def failure_windows(stream: DataFrame, failed: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Failures per user and event-time window, late rows accepted for a while.

    Stands in, on a stream, for the count among the last events of everybody, which has no meaning
    once rows arrive out of order.
    """
    return (
        event_time(stream, late).filter(F.col(failed))
        .groupBy(F.window("ts", length).alias("w"), "user_name").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "user_name", "n")
    )


def volume_over_time(stream: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per tumbling event-time window."""
    return (
        event_time(stream, late).groupBy(F.window("ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n")
    )


def keep_latest(aggregated: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Write changed windows of every micro-batch; readers take the newest row per key."""
    query = aggregated.writeStream.outputMode("update").foreachBatch(
        lambda b, n: _put(b.withColumn("step", F.lit(n).cast("long")), out, n)
    ).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest_windows(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(out).groupBy(*keys).agg(F.max_by("n", "step").alias("n"))
