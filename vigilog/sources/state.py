"""State and model tables kept between batches.

A state table is a folder of parquet parts, one sub-folder per batch number. Writing a batch again
replaces its own folder only, so a repeated batch leaves the same state behind. Every so many
batches the parts are merged into a snapshot, so reading the state stays cheap on a long stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable


class StateTable:
    """Append-by-batch table with idempotent writes and merged snapshots."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str,
        merge: Callable[[DataFrame], DataFrame] | None = None, snapshot_every: int = 50,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.merge, self.snapshot_every = merge or (lambda df: df), snapshot_every

    def _folders(self) -> dict[str, list[int]]:
        """Numbers of complete batch and snapshot folders."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"batch": [], "snapshot": []}
        if fs.exists(folder):
            for status in fs.listStatus(folder):
                kind, _, number = status.getPath().getName().partition("=")
                done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
                if kind in found and fs.exists(done):
                    found[kind].append(int(number))
        return found

    def before(self, batch: int | None = None) -> DataFrame:
        """The state left by all batches before ``batch`` (by all of them when None)."""
        found = self._folders()
        inside = lambda n: batch is None or n < batch
        snapshots = [n for n in found["snapshot"] if batch is None or n <= batch]
        start = max(snapshots, default=None)
        paths = [f"{self.path}/batch={n}" for n in sorted(found["batch"]) if inside(n) and (start is None or n >= start)]
        if start is not None:
            paths.append(f"{self.path}/snapshot={start}")
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(self.spark.read.schema(self.schema).parquet(*paths))

    def write(self, df: DataFrame, batch: int) -> None:
        """Store what ``batch`` adds; from time to time store a snapshot of everything so far."""
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if (batch + 1) % self.snapshot_every == 0:
            self.before(batch + 1).write.mode("overwrite").parquet(f"{self.path}/snapshot={batch + 1}")


class KeyedStateTable:
    """One row per key, in buckets of keys; a batch reads and rewrites only the buckets of its own keys.

    ``data/batch=n/_bucket=b`` holds bucket ``b`` as batch ``n`` left it, ``manifest=n`` tells the newest version of each
    bucket. A batch starts from the manifest before it, so writing it again gives the same state. Versions that neither
    the newest manifest nor the one before it names are removed.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, merge: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema
        self.merge, self.buckets = merge, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _numbers(self, folder: str, kind: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [status.getPath() for status in fs.listStatus(path)] if fs.exists(path) else []
        done = [p.getName().partition("=")[2] for p in names if p.getName().startswith(f"{kind}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(map(int, done))

    def _remove(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def versions(self, batch: int | None = None) -> dict[int, int]:
        """The newest version of each bucket that has rows, as the batches before ``batch`` left it."""
        found = [n for n in self._numbers(self.path, "manifest") if batch is None or n < batch]
        if not found:
            return {}
        return dict(self.spark.read.schema("bucket int, version int").parquet(f"{self.path}/manifest={found[-1]}").collect())

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/batch={version}/_bucket={bucket}" for bucket, version in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def before(self, batch: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The state before ``batch`` (after all batches when None), of the buckets that hold ``keys`` when given."""
        versions = self.versions(batch)
        if keys is not None:  # at most as many rows as buckets
            asked = {r[0] for r in keys.select(self._bucket()).distinct().collect()}
            versions = {b: v for b, v in versions.items() if b in asked}
        return self._read(versions)

    def write(self, changes: DataFrame, batch: int) -> None:
        """Merge the rows of ``batch`` into the state."""
        changes = durable(changes.select(*self.spark.createDataFrame([], self.schema).columns))
        versions = self.versions(batch)
        touched = {r[0] for r in changes.select(self._bucket()).distinct().collect()}
        old = self._read({b: v for b, v in versions.items() if b in touched})
        merged = self.merge(old.unionByName(changes)).withColumn("_bucket", self._bucket())
        merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/batch={batch}")
        now = versions | dict.fromkeys(touched, batch)
        rows = self.spark.createDataFrame(sorted(now.items()), "bucket int, version int")
        rows.write.mode("overwrite").parquet(f"{self.path}/manifest={batch}")
        used = {*now.values(), *versions.values(), batch}
        for number in self._numbers(f"{self.path}/data", "batch"):
            if number < batch and number not in used:
                self._remove(f"{self.path}/data/batch={number}")
        for number in [n for n in self._numbers(self.path, "manifest") if n < batch][:-1]:
            self._remove(f"{self.path}/manifest={number}")


def seen_after(known: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Known entities joined by those of the batch."""
    return known.select(key).unionByName(batch.select(key).filter(F.col(key).isNotNull())).distinct()


def unseen(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Entities of the batch that are not known yet."""
    return batch.select(key).filter(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def merge_counts(known: DataFrame, batch: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Add up two tables of counters."""
    return known.select(key, count).unionByName(batch.select(key, count)).groupBy(key).agg(F.sum(count).alias(count))


def append_history(history: DataFrame, batch: DataFrame, order: str, limit: int) -> DataFrame:
    """History plus batch, the latest ``limit`` rows of it."""
    return history.unionByName(batch).orderBy(F.col(order).desc()).limit(limit)


def save_model(df: DataFrame, path: str, **facts) -> None:
    """A model kept as a small table next to its facts."""
    df.withColumn("_facts", F.lit(json.dumps(facts, sort_keys=True))).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    df = spark.read.parquet(path)
    row = df.select("_facts").first()
    return df.drop("_facts"), json.loads(row["_facts"]) if row else {}
