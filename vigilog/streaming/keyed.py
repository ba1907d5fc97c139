"""Streams whose state is kept by key in the engine's state store.

A micro-batch is counted per key where its rows are; only these counts meet the state, so a micro-batch touches the
state of its own keys and a hot key is a few rows. The rows themselves go past the state in the same micro-batch, as a
second branch of the stream, and meet the outcome of their key when the batch is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.lookup import attach_stats, profile_keys
from .streams import _put, run_batches

_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Rows that a task counts at once.
COUNTED_ROWS = 10_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class KeyCounter(StatefulProcessor):
    """How many rows a key had before this micro-batch and how many it has in it.

    With ``forget`` (milliseconds) a timer drops a key that no micro-batch brought for that long.
    """

    def __init__(self, key: str, forget: int | None = None):
        self.key, self.forget = key, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        now = sum(r["n"] for r in rows)
        before = self.count.get()[0] if self.count.exists() else 0
        self.count.update((before + now,))
        if self.forget is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.forget)
        yield Row(**{self.key: key[0], "_now": now, "_before": before})

    def handleExpiredTimer(self, key, timer_values, expired_timer_info) -> Iterator[Row]:
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


def task_counts(stream: DataFrame, key: str) -> DataFrame:
    """(key, n): rows by non-null key, added up in each task before they are shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sums() -> list[pa.RecordBatch]:
            counts = pa.Table.from_batches(held).group_by(key).aggregate([([], "count_all")])
            return counts.select([key, "count_all"]).rename_columns([key, "n"]).to_batches()

        for batch in batches:  # these may be short, by a setting of the session
            held.append(batch)
            if sum(b.num_rows for b in held) >= COUNTED_ROWS:
                yield from sums()
                held = []
        if held:
            yield from sums()

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key).filter(F.col(key).isNotNull()).mapInArrow(counted, f"{key} {kind}, n long")


def with_key_counts(stream: DataFrame, key: str, forget: int | None = None) -> DataFrame:
    """The rows of the stream, and one row a key of the micro-batch with ``_now`` and ``_before`` and all else null."""
    kind = stream.schema[key].dataType.simpleString()
    counts = task_counts(stream, key).groupBy(key).transformWithState(
        statefulProcessor=KeyCounter(key, forget), outputStructType=f"{key} {kind}, _now long, _before long",
        outputMode="Append", timeMode="None" if forget is None else "ProcessingTime")
    return stream.withColumns({"_now": F.lit(None).cast("long"), "_before": F.lit(None).cast("long")}).unionByName(counts, allowMissingColumns=True)


def score_by_key(
    stream: DataFrame, key: str, name: str, score: Column, default: float, out: str, checkpoint: str, forget: int | None = None,
    watch: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Write every row with the score of its key, made of ``_now`` and ``_before``; rows of a null key get the default."""
    stream.sparkSession.conf.set(_STORE, _ROCKS)

    def step(batch: DataFrame, number: int) -> None:
        is_count = F.col("_now").isNotNull()
        rows = batch.filter(~is_count).drop("_now", "_before")
        stats = batch.filter(is_count).select(key, F.col("_now").alias("_key_rows"), score.cast("double").alias(name))
        if watch:
            watch(stats, number)
        scored = attach_stats(rows, key, stats, profile_keys(rows, [key]))
        _put(scored.withColumn(name, F.coalesce(name, F.lit(default))), out, number)

    return run_batches(with_key_counts(stream, key, forget), step, checkpoint)


def new_entities(stream: DataFrame, key: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Flag all rows of keys no earlier micro-batch held; a null key is never new."""
    return score_by_key(stream, key, "is_new", F.col("_before") == 0, 0.0, out, checkpoint, **options)


def burst_scores(stream: DataFrame, key: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Share of a key's events so far that fall into this micro-batch; 1.0 for a null key."""
    return score_by_key(stream, key, "burst", F.col("_now") / (F.col("_now") + F.col("_before")), 1.0, out, checkpoint, **options)


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The counts the store holds after the last micro-batch."""
    return spark.read.format("statestore").option("stateVarName", "count").load(checkpoint).select("key.*", "value.*")
