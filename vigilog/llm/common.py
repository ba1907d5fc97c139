"""Helpers shared by the text operators: session settings, tables, durable tables, column bindings, tokenizers."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, scratch_path

#: Rows in one Arrow batch. Texts may be long, so batches are short.
BATCH_ROWS = 256
#: White space as the word patterns define it: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"


def ready(spark: SparkSession) -> SparkSession:
    """The library's settings, and short Arrow batches so that a batch of very long texts fits a worker."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: computed once, safe against lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once a row however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


@functools.cache
def tokenizer(path: str):
    """The tokenizer of a file, loaded once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine has a public vocabulary file; asked for on each worker, so that no path is shipped."""
    import public_tokenizers

    return public_tokenizers.path(name)
