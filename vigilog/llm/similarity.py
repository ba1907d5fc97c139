"""Near-duplicates by fast similarity sketches: groups of documents whose shingle sets have Jaccard similarity 0.8 or more.

*Sketch.* A set's elements are thrown into ``COORDINATES`` bins, round after round, each round with a hash of its own; a
bin keeps the least (round, hash) it gets, and rounds end when all bins are full. In the second half of the rounds each
round has one bin for all elements, so every bin fills whatever the size of the set. Two sets agree in a bin with the
probability of their similarity, concentrated as for independent bins.

*Banding.* Four coordinates make a band, 32 bands a sketch: two sets at 0.8 share no band with probability 5e-8. Equal
sets are one node before all this. Bands are counted first; only nodes in a band that others share go on, and of bands
with the very same nodes one is kept.

*Links.* Nobody lists all pairs of a band.

1. The nodes of a band are dealt into blocks of at most about ``BLOCK`` nodes and ``ELEMENTS`` elements, with their full
   sets. In a block each node meets the later ones, unless they are in its component already; if the sketches agree in
   ``ENOUGH`` coordinates (a pair at 0.8 agrees in fewer with probability 3e-9), the sets are compared. What leaves the
   block is a spanning forest of links, fewer than it has nodes.
2. Where a band has several blocks and still several components, the nodes outside its largest component are held against
   all others, block by block, in the same way.

So no link between different components is lost but by the two probabilities above, and each link is exact. Components
are joined by star contraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stored
from .components import components
from .substrings import run_hashes, word_hashes

SHINGLE, SIMILAR = 4, 80
COORDINATES, BAND = 128, 4
ENOUGH = 76
#: Nodes of a band, and elements of their sets, that a task compares with each other.
BLOCK, ELEMENTS = 1024, 1_000_000
#: Bits of the map of wanted texts (16 MB). A fuller map lets more texts through, never fewer.
MAP_BITS = 27
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 56) - 1)


class Index(Protocol):
    def near(self, i: int, alive: np.ndarray) -> np.ndarray:
        """Places of the codes, among those alive, that may be similar to code i."""


@dataclass(frozen=True)
class Search:
    """Another first look inside blocks: a 64-bit code of each set, and an index over the codes of a block."""

    code: Callable[[np.ndarray], int]
    index: Callable[[np.ndarray], Index]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted hashes: A-Z in lower case; fewer words: the whole sequence; none: empty."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    # Short sequences are kept apart from each other and from shingles by their length.
    hashes = word_hashes(words, 5)
    return np.unique(run_hashes(hashes, size) if len(words) >= size else run_hashes(hashes, len(words)) + np.uint64(len(words)))


def sketch(elements: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The fast similarity sketch of a non-empty set, 16 bits a coordinate."""
    bins = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    shift = np.uint64(64 - coordinates.bit_length() + 1)
    at, step = 0, max(1, 1024 // len(elements))  # rounds beyond the last needed one change nothing
    while at < 2 * coordinates and bins.max() == np.iinfo(np.uint64).max:
        rounds = np.arange(at, min(at + step, 2 * coordinates), dtype=np.uint64)[:, None]
        hashes = mixed(elements[None, :] + (rounds + np.uint64(1)) * _GOLDEN)
        place = np.where(rounds < coordinates, hashes >> shift, rounds % np.uint64(coordinates))
        np.minimum.at(bins, place.ravel().astype(np.int64), ((rounds << np.uint64(56)) | (hashes & _LOW)).ravel())
        at += step
    return (mixed(bins) & np.uint64(0xFFFF)).astype(np.uint16)


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILAR) -> bool:
    """Whether two sets (sorted, distinct, not empty) have at least this similarity."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _rows(docs: DataFrame, key: str, size: int) -> DataFrame:
    """(key, n, node, bands, same): the set's size, a 128-bit name of the set, its bands as longs, a hash of the text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size) for t in batch.column(1).to_pylist()]
            n = pa.array([len(s) for s in sets], pa.int64())
            node = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            bands = pa.array([sketch(s).view(np.int64) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, node, bands, batch.column(2)], [key, "n", "node", "bands", "same"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text", F.xxhash64("text").alias("same")).mapInArrow(read, f"{key} {kind}, n long, node binary, bands array<long>, same long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """The runs of equal values in the first ``keys`` columns of sorted batches, each as slices."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        changes = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            now = tuple(c[low] for c in columns)
            if held and now != last:
                yield held
                held = []
            last = now
            held.append(batch.slice(low, high - low))
    if held:
        yield held


class _Block:
    """Nodes with their sets, and which of them are known to be connected."""

    def __init__(self, run: list[pa.RecordBatch], percent: int, search: Search | None):
        rows = pa.Table.from_batches(run)
        self.names = rows["node"].to_pylist()
        self.sets = [np.frombuffer(x, np.uint64) for x in rows["elements"].to_pylist()]
        self.codes = np.array([np.frombuffer(x, np.uint16) for x in rows["codes"].to_pylist()])
        heads = rows["head"].to_pylist() if "head" in rows.column_names else self.names
        self.head = np.unique(np.array(heads, object), return_inverse=True)[1]
        self.percent = percent
        self.index = search.index(rows["fp"].to_numpy().view(np.uint64)) if search else None

    def near(self, i: int, alive: np.ndarray) -> np.ndarray:
        """Places of nodes alive that may be similar to node i: those the index finds, and of them those whose sketches agree."""
        rows = self.index.near(i, alive) if self.index else np.flatnonzero(alive)
        return rows[(self.codes[rows] == self.codes[i]).sum(axis=1) >= ENOUGH]

    def links(self, asking: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
        """Links that connect what is not connected yet: each asking node against the asked ones."""
        a, b = [], []
        for i in np.flatnonzero(asking).tolist():
            for j in self.near(i, asked & (self.head != self.head[i])).tolist():
                if self.head[i] != self.head[j] and similar(self.sets[i], self.sets[j], self.percent):
                    a.append(self.names[i])
                    b.append(self.names[j])
                    self.head[self.head == self.head[j]] = self.head[i]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _dealt(nodes: DataFrame, block: int) -> DataFrame:
    """(band, code, m, blocks, node): the nodes of each band that at least two share."""
    rows = nodes.select("node", "n", F.posexplode("bands").alias("band", "code"))
    name = F.xxhash64("node")
    shared = (
        rows.groupBy("band", "code")
        .agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.bit_xor(name).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
        .where("m > 1")
    )
    # Bands with the same nodes are told by size and 128 bits; one of them is enough.
    once = shared.groupBy("m", "n", "x", "y").agg(F.min(F.struct("band", "code")).alias("first"))
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("n") / ELEMENTS))
    return rows.drop("n").join(once.select("first.*", "m", blocks.alias("blocks")), ["band", "code"])


def _in_blocks(dealt: DataFrame, sets: DataFrame, percent: int, search: Search | None) -> DataFrame:
    """(a, b): links inside the blocks of all bands."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _groups(batches, 3):
            rows = _Block(run, percent, search)
            every = np.ones(len(rows.names), bool)
            yield rows.links(every, every)

    columns = ["band", "code", "block"]
    placed = dealt.select("band", "code", F.pmod(F.xxhash64("node"), "blocks").alias("block"), "node").join(sets, "node")
    ordered = placed.select(*columns, *sets.columns).repartition(*columns).sortWithinPartitions(*columns)
    return ordered.mapInArrow(linked, "a binary, b binary").distinct()


def _across(dealt: DataFrame, sets: DataFrame, heads: DataFrame, percent: int, search: Search | None) -> DataFrame:
    """(a, b): links between blocks of a band, of nodes whose components differ."""
    headed = stored(dealt.where("blocks > 1").join(heads, "node", "left").withColumn("head", F.coalesce("head", "node")), "bands")
    sizes = headed.groupBy("band", "code", "head").agg(F.count("*").alias("size"), F.first("m").alias("m")).where("size < m")
    largest = sizes.groupBy("band", "code").agg(F.max(F.struct("size", "head")).alias("top")).select("band", "code", F.col("top.head").alias("top"), F.col("top.size").alias("size"))
    rows = headed.join(largest, ["band", "code"])
    # The asking nodes are dealt into i, all nodes into j, by the same number of rows a block.
    asked = F.ceil((F.col("m") - F.col("size")) * F.col("blocks") / F.col("m"))
    hashed, first = F.xxhash64("node", F.lit(2)), F.lit(0).cast("long")
    outside = F.col("head") != F.col("top")
    ask = rows.where(outside).select("band", "code", F.pmod(hashed, asked).alias("i"), F.explode(F.sequence(first, F.col("blocks") - 1)).alias("j"), F.lit(True).alias("asks"), "node", "head")
    answer = rows.select("band", "code", F.explode(F.sequence(first, asked - 1)).alias("i"), F.pmod(hashed, "blocks").alias("j"), F.lit(False).alias("asks"), "node", "head")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _groups(batches, 4):
            rows = _Block(run, percent, search)
            asks = np.concatenate([b.column("asks").to_numpy(zero_copy_only=False) for b in run])
            yield rows.links(asks, ~asks)

    columns = ["band", "code", "i", "j"]
    placed = ask.unionByName(answer).join(sets, "node").select(*columns, "asks", "head", *sets.columns)
    return placed.repartition(*columns).sortWithinPartitions(*columns).mapInArrow(linked, "a binary, b binary").distinct()


def _wanted_map(wanted: DataFrame, bits: int) -> np.ndarray:
    """A map of fixed size in which the bit of each wanted hash (``same``) is set."""
    place = F.col("same").bitwiseAND((1 << bits) - 1)
    rows = wanted.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(same & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int, search: Search | None) -> DataFrame:
    """(node, elements, codes, fp): the whole sets of the wanted texts (``same``), from the texts themselves; fp for a search.

    A map of the wanted hashes, of fixed size, tells each task its texts, so that no text is shuffled; what else the map
    lets through is never asked for.
    """
    names = ["node", "elements", "codes"] + ["fp"] * bool(search)
    read_as = "node binary, elements binary, codes binary" + ", fp long" * bool(search)
    sent = docs.sparkSession.sparkContext.broadcast(_wanted_map(wanted, MAP_BITS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, np.zeros(0, np.uint64)
        for batch in batches:
            hashes = batch.column(1).to_numpy().view(np.uint64)
            at = hashes & np.uint64(64 * len(bits) - 1)
            fine = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
            new, first = np.unique(hashes[fine], return_index=True)
            keep = ~np.isin(new, seen)  # the same text again
            seen = np.concatenate([seen if len(seen) < 1_000_000 else seen[:0], new[keep]])
            texts = batch.column(0).take(pa.array(np.flatnonzero(fine)[first[keep]]))
            sets = [shingles(t, size) for t in texts.to_pylist()]
            columns = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [s.tobytes() for s in sets], [sketch(s).tobytes() if len(s) else b"" for s in sets]
            arrays = [pa.array(c, pa.binary()) for c in columns]
            if search:
                arrays.append(pa.array(np.array([search.code(s) for s in sets], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(arrays, names)

    texts = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("same"))
    return stored(texts.mapInArrow(read, read_as).dropDuplicates(["node"]), "sets")


def groups(docs: DataFrame, key: str = "doc_id", size: int = SHINGLE, percent: int = SIMILAR, block: int = BLOCK, search: Search | None = None) -> DataFrame:
    """(key, n, node, head): of each row of ``docs`` its set's size and name, and the name of its component.

    Rows without words have neither node nor head. The bands and ``ENOUGH`` are made for ``percent`` of 80 or more. With
    a ``search``, candidates inside blocks are found by its index over codes of the full sets.
    """
    ready(docs.sparkSession)
    rows = stored(_rows(docs, key, size), "sketches")
    nodes = stored(rows.where("n > 0").select("node", "n", "bands", "same").dropDuplicates(["node"]), "nodes")
    dealt = stored(_dealt(nodes, block), "bands")
    sets = _full_sets(docs, nodes.join(dealt.select("node").distinct(), "node").select("same"), size, search)
    links = stored(_in_blocks(dealt, sets, percent, search), "links")
    heads = stored(components(links).select(F.col("a").alias("node"), F.col("b").alias("head")), "heads")
    later = stored(_across(dealt, sets, heads, percent, search), "links")
    # A link found later joins two components of the first round.
    short = later.join(heads.withColumnsRenamed({"node": "a", "head": "x"}), "a", "left").join(heads.withColumnsRenamed({"node": "b", "head": "y"}), "b", "left")
    joined = components(short.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))).select(F.col("a").alias("head"), F.col("b").alias("top"))
    named = rows.where("n > 0").select(key, "n", "node").join(heads, "node", "left").withColumn("head", F.coalesce("head", "node"))
    named = named.join(joined, "head", "left").select(key, "n", "node", F.coalesce("top", "head").alias("head"))
    return named.unionByName(rows.where("n = 0").select(key, "n", "node", F.col("node").alias("head")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = SIMILAR, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row a row of ``docs``.

    component_id is the least doc_id reachable over links, the row's own included; rows without words (null and empty
    text) are linked with nothing. Rows with a null doc_id take part: their component_id is the least known doc_id of the
    component, null if there is none, and they are kept only in the latter case. Repeated rows and doc_ids stay rows of
    their own. Texts are read whole, however long. Other columns are ignored whatever their names; an empty table gives an
    empty table.
    """
    found = stored(groups(docs, "doc_id", size, percent, block), "groups")
    rest, found = found.where("head IS NULL"), found.where("head IS NOT NULL")
    named = found.join(found.groupBy("head").agg(F.min("doc_id").alias("component_id")), "head").select("doc_id", "n", "component_id")
    out = named.unionByName(rest.select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
