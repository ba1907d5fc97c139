"""Packing of documents into token windows by the sum-of-squares rule.

Documents longer than a window give full windows and one rest. Each rest is placed into the fill level h for which the
sum of the squared counts of partially filled windows, N(1)^2 + ... + N(size-1)^2, becomes least: a window at level h
moves to level h + length, a new one comes from level 0, a full one leaves the sum. The counts are one level array.

Tokens are counted once and only piece descriptions are shuffled, with the ids only where they are asked for. Each packer task gets pieces of about
``PACKER_TOKENS`` tokens, a number of packers in proportion to the input, so that no task grows with it; a packer holds
its level array and the numbers of its open windows. Longer pieces arrive first, ties by doc_id, start and checksum,
so a task that is run again gives the same windows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .token_counts import encoder

WINDOW = 2048
#: Texts of up to so many characters are encoded at once, longer ones in chunks.
WHOLE = 262_144
#: Tokens for one packer. Only the last open windows of a packer are padded, so larger packers pad less.
PACKER_TOKENS = 8_000_000


class LevelArray:
    """Counts of partially filled windows by fill level, and their numbers."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) for a piece of ``length`` tokens."""
        size, counts = self.size, self.counts
        window, level = -1, 0
        if length < size:
            # Change of the sum of squares: moving a window from h to h + length, h = 1 ... size - length.
            here, there = counts[1 : size - length + 1], counts[length + 1 : size + 1]
            change = 2 * (there - here) + 2
            change[-1] = 1 - 2 * here[-1]
            change[here == 0] = np.iinfo(np.int64).max
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if here[best] and change[best] <= 2 * counts[length] + 1:
                level = best + 1
                window = self.open[level].pop()
                counts[level] -= 1
        if window < 0:
            window, self.made = self.made, self.made + 1
        if (filled := level + length) < size:
            counts[filled] += 1
            self.open[filled].append(window)
        return window, level


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 1, size: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for; each id is in exactly one piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, WHOLE)
        for batch in batches:
            rows, start, length, crc, total, kept = [], array("q"), array("q"), array("q"), array("q"), []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*own.ids(text or ""), end_id], "<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    rows.append(row)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        kept.append(part.astype(np.int32))
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            given = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*kept, np.zeros(0, np.int32)])))] if with_ids else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(np.frombuffer(x, np.int64) if len(x) else [], pa.int64()) for x in (start, length, crc, total)), *given],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def pack(parts: DataFrame, size: int = WINDOW, packer_tokens: int = PACKER_TOKENS) -> DataFrame:
    """Add sequence_id and offset to stored pieces (``doc_id, start, length, ids_crc32, doc_tokens``)."""
    tokens = parts.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    packers = -(-tokens // packer_tokens) or 1
    ordered = parts.repartition(packers).sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32", "doc_tokens")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, first = LevelArray(size), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = np.array([levels.place(n) for n in batch.column(2).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + placed[:, 0]), pa.array(placed[:, 1])], [*batch.schema.names, "sequence_id", "offset"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return ordered.mapInArrow(place, f"{kind}, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 1, size: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pack all documents; one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids if asked for.

    Null text counts as empty and gives one piece with the end id alone. Repeated rows and repeated or null doc_ids
    are packed row by row. Other columns are ignored whatever their names; an empty table gives no pieces. Very long
    texts become windows of their own and one rest.
    """
    return pack(stored(pieces(docs, vocabulary, end_id, size, with_ids), "pieces"), size)
