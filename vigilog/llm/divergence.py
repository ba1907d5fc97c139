"""Source divergence audit: which sources of a language use other terms than the language and than each other.

Counts are kept per (lang, source, term): tasks add up their own texts, the shuffle goes by (lang, term), so neither a hot
source nor a hot language meets in one task.

* *Terms.* A term's value f grows with its count in the group and falls with its count in the language. So a term that
  others dominate (no lower group count, no higher lang count, earlier UTF-8) ranks behind them, and only terms with
  fewer than k dominators, the k-skyband, can be among the first k. Each partition keeps the skyband of its own terms,
  the skybands are merged per group, and what is left is ranked exactly. A dominator outside the skyband has k dominators
  of its own inside, so terms need only be held against the skyband so far.
* *Pairs* of sources need the sum over all kept terms. Terms are dealt into blocks of bounded size per language; a block
  adds up the values of all pairs of its sources, and the blocks are summed.

All figures are exact integers: floor(10**9 * c / d) is taken three decimal digits at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, stored

LEAST_DOCUMENTS, TOP = 10, 10
#: Rows (term and source) of a block of terms in which pairs of sources are added up.
BLOCK_ROWS = 100_000
#: Cells of terms by sources that a task holds at once.
_CELLS = 1_000_000
#: Distinct terms that a task adds up before it hands them on, and bytes of a text that are split at once.
_HELD, _PART = 500_000, 4_000_000
#: A-Z in lower case; all other ASCII characters end a term.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    data, at = text.encode().translate(_TABLE), 0
    while at < len(data):
        cut = data.find(b" ", at + _PART)
        cut = len(data) if cut < 0 else cut
        yield data[at:cut].split()
        at = cut


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, partitioned by (lang, term).

    Each group also has a row of the empty term, so groups without terms are known.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def done() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                n[b""] = docs[b""] = 0
                names = pa.array(list(n), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n)), pa.array([source] * len(n)), names, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            groups.clear()

        for batch in batches:
            for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for some in terms(text):
                    n.update(some)
                    seen.update(some)
                docs.update(seen)
            if sum(len(n) for n, _ in groups.values()) >= _HELD:
                yield from done()
        yield from done()

    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    parts = rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / whole), exact for whole up to 9 * 10**15."""
    out, rest = 0, count + 2
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def share(count: Column, whole: Column) -> Column:
    """The same as a column."""
    exact = F.lit(10**9).cast("decimal(10,0)") * (count + 2).cast("decimal(18,0)")
    return F.expr("1") + F.call_function("div", exact, whole.cast("decimal(18,0)"))


def value(p, q):
    """floor((p - q)**2 / (p + q)); below 2**63 since shares are at most 10**9 + 1."""
    return (p - q) * (p - q) // (p + q)


class Skyband:
    """Points (a, b) in order of arrival, without those that ``k`` earlier ones dominate: a no lower, b no higher."""

    def __init__(self, k: int):
        self.k, self.points, self.rows = k, np.zeros((0, 2), np.int64), []

    def add(self, points: np.ndarray, rows: list) -> None:
        left = np.arange(len(points))
        for at in range(0, len(points), 512):
            some = left[at : at + 512]
            mine = points[some]
            by = ((self.points[:, 0] >= mine[:, :1]) & (self.points[:, 1] <= mine[:, 1:])).sum(axis=1)
            near = some[by < self.k]
            if not len(near):
                continue
            # Those of this block that come earlier count too, and only if they stay.
            mine, by, stay = points[near], by[by < self.k], []
            for i in range(len(near)):
                if by[i] + int(((mine[stay, 0] >= mine[i, 0]) & (mine[stay, 1] <= mine[i, 1])).sum()) < self.k:
                    stay.append(i)
            self.points = np.concatenate([self.points, mine[stay]])
            self.rows += [rows[j] for j in near[stay].tolist()]


def _skybands(rows: DataFrame, k: int) -> DataFrame:
    """Of each partition's rows (lang, source, term, n, whole), in order of term within a group: the groups' skybands."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands: dict[tuple[str, str], Skyband] = {}

        def done() -> pa.RecordBatch:
            out = [(*group, row, a, b) for group, band in bands.items() for row, (a, b) in zip(band.rows, band.points.tolist())]
            bands.clear()
            columns = list(zip(*out)) if out else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 3 + (pa.int64(),) * 2)], ["lang", "source", "term", "n", "whole"])

        for batch in batches:
            langs, sources, names = (batch.column(i).to_pylist() for i in range(3))
            points = np.column_stack([batch.column(i).to_numpy() for i in (3, 4)])
            groups: dict[tuple[str, str], list[int]] = {}
            for i, group in enumerate(zip(langs, sources)):
                groups.setdefault(group, []).append(i)
            for group, at in groups.items():
                bands.setdefault(group, Skyband(k)).add(points[at], [names[i] for i in at])
            if sum(len(band.rows) for band in bands.values()) > _HELD:
                yield done()
        yield done()

    return rows.select("lang", "source", "term", "n", "whole").mapInArrow(kept, "lang string, source string, term string, n long, whole long")


def _pair_sums(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each pair of sources of a language the sum of the values over its kept terms."""

    def added(terms: pa.Table, sources: pa.Table) -> pa.Table:
        if not len(terms) or len(sources) < 2:
            return pa.table({"lang": pa.array([], pa.string()), "a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
        sources = sources.sort_by("source")  # the same order in all blocks
        names, whole = sources["source"].to_pylist(), sources["whole"].to_numpy()
        none, place = shares(np.zeros(len(names), np.int64), whole), {s: i for i, s in enumerate(names)}
        codes = terms["term"].combine_chunks().dictionary_encode()
        number, own = codes.indices.to_numpy(), np.array([place[s] for s in terms["source"].to_pylist()])
        p = shares(terms["n"].to_numpy(), whole[own])
        order = np.argsort(number, kind="stable")
        number, own, p = number[order], own[order], p[order]
        out = [np.zeros(len(names) - i - 1, np.int64) for i in range(len(names))]
        step = max(1, _CELLS // len(names))
        for low in range(0, len(codes.dictionary), step):
            first, last = np.searchsorted(number, [low, low + step])
            cells = np.repeat(none[:, None], min(step, len(codes.dictionary) - low), axis=1)
            cells[own[first:last], number[first:last] - low] = p[first:last]
            for i in range(len(names) - 1):
                out[i] += value(cells[i], cells[i + 1 :]).sum(axis=1)
        a = [names[i] for i in range(len(names)) for _ in out[i]]
        b = [s for i in range(len(names)) for s in names[i + 1 :]]
        return pa.table({"lang": pa.array([terms["lang"][0].as_py()] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(np.concatenate(out), pa.int64())})

    blocks = groups.groupBy("lang").agg(F.max("blocks").alias("blocks"))
    dealt = rows.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n")
    sides = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "whole")
    sums = dealt.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInArrow(added, "lang string, a string, b string, value long")
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", both.alias("e"), "value").select("lang", "e.*", "value")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources of a group's language, and its ``top`` terms.

    Null text, lang and source are empty strings. Every row is a document of its own, repeated ones too; texts are read
    whole, however long; ties go by UTF-8. Groups without terms take part in pairs; a language without kept terms has the
    value 0 for all. Other columns are ignored whatever their names; an empty table gives an empty table.
    """
    ready(docs.sparkSession)
    counts = stored(term_counts(docs), "term-counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs"))
    kept = stored(kept.where(F.col("docs") >= least).select("lang", "term", "whole"), "kept-terms")
    rows = stored(counts.where("n > 0").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "whole"), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("lang_n"))
    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "rows", "v", "lang_n"])
    size = F.sum("rows").over(Window.partitionBy("lang"))
    groups = groups.select("lang", "source", (F.col("n") + 2 * F.col("v")).alias("whole"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_whole"), F.greatest(F.lit(1), F.ceil(size / block_rows)).alias("blocks"))
    groups = stored(groups, "groups")

    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where("source <> item").join(_pair_sums(rows, groups), ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    ordered = rows.repartition("lang", "term").sortWithinPartitions("lang", "term")
    bands = _skybands(ordered, top).repartition("lang", "source").sortWithinPartitions("lang", "source", "term")
    last = _skybands(bands, top).withColumnRenamed("whole", "lang_n").join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("whole")), share(F.col("lang_n"), F.col("lang_whole"))
    found = last.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    found = found.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(found).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
