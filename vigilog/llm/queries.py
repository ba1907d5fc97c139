"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination, divergence, lattice, licences, packing, pages, phrases, pii, quality, simhash, similarity, substrings, token_counts,
)
from .common import table
from .decontamination_sql import LEAKS_SQL
from .divergence_sql import DIVERGENCE_SQL
from .phrases_sql import COLLOCATIONS_SQL
from .quality_sql import QUALITY_SQL
from .similarity_sql import NEAR_DUPLICATES_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op2_packing_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_html_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op4_token_counts_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scores(table(spark, sf_dir, "documents"))


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def op7_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.found_spans(docs, pii.fit(docs))


def op8_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op9_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_simhash_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_fast_similarity_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.near_duplicates(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_divergence, op2_packing_sum_of_squares, op3_html_host_suffixes, op4_token_counts_resync,
        op5_lattice_likelihood, op6_simhash_decontamination,
        op7_pii_boosting, op8_licence_rules, op9_substring_automata,
        op10_simhash_vantage, op11_phrase_collocations, op12_fast_similarity_sketches, op13_source_divergence,
    )
}
#: Queries whose rows SQL can express; the others are tested against brute force.
SQL: dict[str, str] = {
    "op1_quality_divergence": QUALITY_SQL, "op6_simhash_decontamination": LEAKS_SQL, "op11_phrase_collocations": COLLOCATIONS_SQL,
    "op12_fast_similarity_sketches": NEAR_DUPLICATES_SQL, "op13_source_divergence": DIVERGENCE_SQL,
}
