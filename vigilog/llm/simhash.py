"""Near-duplicate groups by 64-bit SimHash: all links of up to three differing bits, found with vantage-point trees.

Fingerprints are first dealt into shards: two that differ in at most three bits agree in at least one of four 16-bit
blocks, so each distinct fingerprint goes into four shards, and every link lies whole inside a shard. Shards of more
than ``SHARD_ROWS`` fingerprints are dealt once more by four 12-bit blocks of their other 48 bits, by the same argument.
Inside a shard a vantage-point tree partitions the fingerprints by Hamming distance, and triangle bounds prune branches.
(Vantage points alone can't deal out the whole set: distances of 64-bit codes lie within 32 +- 4, so at a median split
more than half of the fingerprints are within three bits of the boundary and would have to go to both sides.)

A shard yields links from each fingerprint to the least one of its group in the shard, never all pairs. Groups over
shards are connected components of these links, by alternating star contraction in joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .similarity import Search, groups, mixed

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Fingerprints in a shard beyond which it is dealt once more. Bounds the memory of a task.
SHARD_ROWS = 20_000
_LEAF = 8
#: Differing bits up to which sets may have similarity 0.8, and the leaves of trees that search so far. A bit differs with
#: probability 0.1875 at most (sets of four and five, one inside the other), so more bits differ in one pair of a million.
WIDE, _WIDE_LEAF = 28, 64


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of the word shingles of a whole text, A-Z in lower case; fewer words: of the whole sequence; none: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n, digest = max(1, len(words) - size + 1), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i : i + size]), SEED) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fp) a row of ``docs``; fp is the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(hashed, f"{key} {kind}, fp long")


class VantageTree:
    """Fingerprints partitioned by Hamming distance: each node is a slice whose first row is the vantage point."""

    def __init__(self, codes: np.ndarray, leaf: int = _LEAF):
        self.leaf = leaf
        self.order = np.arange(len(codes))
        self.codes = codes
        self.nodes: list[tuple[int, int, int, int, int]] = []  # low, high, median distance, inner, outer (-1: leaf)
        self.root = self._split(0, len(codes))
        self.codes = codes[self.order]

    def _split(self, low: int, high: int) -> int:
        at = len(self.nodes)
        self.nodes.append((low, high, 0, -1, -1))
        if high - low > self.leaf:
            rest = self.order[low + 1 : high]
            far = np.bitwise_count(self.codes[rest] ^ self.codes[self.order[low]])
            middle = int(np.median(far))
            inside = far <= middle
            if inside.any() and not inside.all():
                cut = low + 1 + int(inside.sum())
                self.order[low + 1 : high] = np.concatenate([rest[inside], rest[~inside]])
                self.nodes[at] = (low, high, middle, self._split(low + 1, cut), self._split(cut, high))
        return at

    def within(self, queries: np.ndarray, alive: np.ndarray, radius: int) -> np.ndarray:
        """Rows (of ``self.codes``) still alive that lie within the radius of any query."""
        hit = np.zeros(len(self.codes), bool)
        stack = [(self.root, queries)]
        while stack:
            node, asked = stack.pop()
            low, high, middle, inner, outer = self.nodes[node]
            if not len(asked) or not alive[low:high].any():
                continue
            if inner < 0:
                rows = low + np.flatnonzero(alive[low:high] & ~hit[low:high])
                for some in range(0, len(asked), 4096):
                    near = np.bitwise_count(self.codes[rows][:, None] ^ asked[some : some + 4096][None, :]) <= radius
                    hit[rows] |= near.any(axis=1)
                continue
            far = np.bitwise_count(asked ^ self.codes[low]).astype(np.int64)
            hit[low] |= bool(alive[low]) and bool((far <= radius).any())
            stack.append((inner, asked[far <= middle + radius]))
            stack.append((outer, asked[far > middle - radius]))
        return np.flatnonzero(hit & alive)


def shard_groups(codes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct codes of a shard: the least code of each one's group; every code asks the tree once."""
    if len(codes) == 2:
        same = np.bitwise_count(codes[0] ^ codes[1]) <= radius
        return np.repeat(codes.min(), 2) if same else codes.copy()
    tree = VantageTree(codes)
    alive, group = np.ones(len(codes), bool), np.empty(len(codes), np.uint64)
    for first in range(len(codes)):
        if not alive[first]:
            continue
        alive[first] = False
        members, front = [np.array([first])], np.array([first])
        while len(front):
            front = tree.within(tree.codes[front], alive, radius)
            alive[front] = False
            members.append(front)
        rows = np.concatenate(members)
        group[rows] = tree.codes[rows].min()
    out = np.empty_like(group)
    out[tree.order] = group
    return out


def _blocks(code, width: int, count: int, start: int = 0):
    """The blocks of a code, each as one long that also holds the block's number."""
    mask = (1 << width) - 1
    return F.array(*(F.shiftrightunsigned(code, start + width * i).bitwiseAND(F.lit(mask)) + F.lit(i << 20) for i in range(count)))


def links(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): from each distinct ``fp`` of ``nodes`` to the least code of its group in a shard, where that is another."""
    fp = F.col("fp")
    dealt = nodes.select("fp", F.explode(_blocks(fp, 16, 4)).alias("shard"))
    large = dealt.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard", F.lit(True).alias("large"))
    # The 48 bits beside block i, brought together: what is above the block moves down over it.
    number = F.shiftright("shard", 20)
    rest = F.expr("shiftleft(shiftrightunsigned(shiftrightunsigned(fp, CAST(16 * number AS INT)), 16), CAST(16 * number AS INT)) | (fp & (shiftleft(1L, CAST(16 * number AS INT)) - 1))")
    placed = (
        dealt.join(large, "shard", "left").withColumn("number", number)
        .select("fp", "shard", F.explode(F.when(F.col("large"), _blocks(rest, 12, 4)).otherwise(F.array(F.lit(-1).cast("long")))).alias("part"))
    )

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None

        def done() -> pa.RecordBatch | None:
            codes = np.concatenate(held).view(np.uint64)
            if len(codes) < 2:
                return None
            least = shard_groups(codes)
            other = least != codes
            return pa.RecordBatch.from_arrays([pa.array(codes[other].view(np.int64)), pa.array(least[other].view(np.int64))], ["a", "b"])

        for batch in batches:
            shard, part, fps = (batch.column(i).to_numpy() for i in (0, 1, 2))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(fps)]):
                if low == high:
                    continue
                if key is not None and key != (shard[low], part[low]):
                    if (found := done()) is not None and found.num_rows:
                        yield found
                    held = []
                key = (shard[low], part[low])
                held.append(fps[low:high])
        if held and (found := done()) is not None and found.num_rows:
            yield found

    ordered = placed.select("shard", "part", "fp").repartition("shard", "part").sortWithinPartitions("shard", "part", "fp")
    return ordered.mapInArrow(grouped, "a long, b long").distinct()


def headed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (each distinct fp once) with ``head``, the least fingerprint of the node's component."""
    linked = components(links(nodes)).select(F.col("a").alias("fp"), F.col("b").alias("head"))
    return nodes.join(linked, "fp", "left").withColumn("head", F.coalesce("head", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row a row of ``docs``.

    component_id is the least doc_id reachable over links of up to three bits, the row's own included. Texts without
    words (null and empty too) have fingerprint zero and are linked like any other. Rows with a null doc_id take part;
    their component_id is the least known doc_id of the component, null if there is none. Repeated rows and doc_ids stay
    rows of their own. Other columns are ignored whatever their names; an empty table gives an empty table.
    """
    rows = stored(fingerprints(docs), "fingerprints")
    nodes = headed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    heads = nodes.groupBy("head").agg(F.min("first").alias("component_id"))
    named = nodes.join(heads, "head").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def set_fingerprint(elements: np.ndarray) -> int:
    """SimHash of a set, given as hashes: a bit is 1 if it is set in over half of them; 0 for the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(elements), 65_536):
        bits = np.unpackbits(mixed(elements[at : at + 65_536]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(elements), bitorder="little").view(np.uint64)[0])


class WideTree:
    """The fingerprints of a block in a vantage-point tree, asked for all within ``WIDE`` bits of one of them."""

    def __init__(self, codes: np.ndarray):
        self.tree = VantageTree(codes, _WIDE_LEAF)
        self.codes = codes

    def near(self, i: int, alive: np.ndarray) -> np.ndarray:
        order = self.tree.order
        return np.sort(order[self.tree.within(self.codes[i : i + 1], alive[order], WIDE)])


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each group of near-duplicates: the one with the least doc_id, null last.

    A group is connected by pairs whose sets of five-word shingles have similarity 0.8 or more. Such pairs differ in some
    ten bits of 64 between their SimHash fingerprints, so that no block of bits is left equal and bits can't deal them out:
    bands of a sketch do, in which a pair at 0.8 meets. Inside each block of a band the fingerprints of the sets stand in a
    vantage-point tree, which finds those within ``WIDE`` bits; each pair it finds is verified on the full sets.
    Texts without words are one group. Rows of one
    doc_id in a group are told apart by an MD5 of doc_id and text, of which the least stays; of repeated rows one stays.
    Texts move once, to meet the keys of the rows that stay, by the same plan at every size.
    """
    key = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("doc_id").isNull().cast("string"), F.col("text").isNull().cast("string"), F.col("text")))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    known = rows.select(F.struct(F.col("row.doc_id").isNull().alias("unknown"), "row.doc_id", "key").alias("who"), "row.text")
    kept = stored(groups(known, "who", size, percent, search=Search(set_fingerprint, WideTree)).groupBy("head").agg(F.min("who").alias("first")).select("first.key"), "representatives")
    return rows.join(kept.hint("merge"), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
