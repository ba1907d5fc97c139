"""Gradient-boosted regression trees for two classes, on binned features, fitted over all rows of a table.

Rows are examples: a vector of integers, the class and how often it occurs. What a tree needs of them are sums: values by
feature give the bin edges, and each level of a tree asks for gradients and curvatures by node, feature and bin. Tasks add
them up over their rows, the shuffle over the tasks; the driver sees only the sums, whose number does not depend on the
rows. Sums are of whole numbers (``SCALE`` to one), so the trees don't depend on the partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1 << 24

Level = tuple[np.ndarray, np.ndarray]  # by node: the feature asked, and its cut
Sums = Callable[[list[Level]], tuple[np.ndarray, np.ndarray]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def packed(x: np.ndarray) -> pa.Array:
    """Vectors of integers, one a row, as binary."""
    return pa.array([row.tobytes() for row in x.astype("<i4")], pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i4").reshape(len(rows), -1)


def _walk(x: np.ndarray, levels: list[Level]) -> np.ndarray:
    rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for features, cuts in levels:
        node = 2 * node + (x[rows, features[node]] > cuts[node])
    return node


@dataclass
class BoostedTrees:
    """Trees of fixed depth: at level d, node i asks one feature; leaves are numbered by the answers."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    penalty: float = 1.0
    start: float = 0.0
    trees: list[tuple[list[Level], np.ndarray]] = field(default_factory=list)

    def fit(self, examples: DataFrame) -> BoostedTrees:
        """examples: ``x`` (``packed``), ``y`` (0 or 1), ``n`` (how often)."""
        total, true = examples.agg(F.sum("n"), F.sum(F.col("n") * F.col("y"))).first()
        share = min(max(true / total, 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        edges = bin_edges(examples, self.bins)
        for _ in range(self.rounds):
            levels: list[Level] = []
            for _ in range(self.depth):
                level, gradient, curve = self._split(edges, *self._sums(examples, edges, levels))
                levels.append(level)
            self.trees.append((levels, self.rate * gradient / (curve + self.penalty)))
        return self

    def _sums(self, examples: DataFrame, edges: list[np.ndarray], levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and curvatures by feature, node and bin, over all examples."""
        nodes, width = 1 << len(levels), max(map(len, edges)) + 1
        size = len(edges) * nodes * width

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, size), np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, n = unpacked(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                p, node = self.probability(x), _walk(x, levels)
                parts = [n * np.rint(SCALE * v).astype(np.int64) for v in (y - p, p * (1 - p))]
                for f, edge in enumerate(edges):
                    at = (f * nodes + node) * width + np.searchsorted(edge, x[:, f], side="left")
                    for total, part in zip(out, parts):
                        np.add.at(total, at, part)
            slots = np.flatnonzero(out.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(out[0, slots]), pa.array(out[1, slots])], ["slot", "g", "h"])

        sums = examples.select("x", "y", "n").mapInArrow(added, "slot long, g long, h long").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        slot = sums["slot"].to_numpy()
        found = np.zeros((2, size))
        found[0, slot], found[1, slot] = sums["g"].to_numpy() / SCALE, sums["h"].to_numpy() / SCALE
        return found[0].reshape(len(edges), nodes, width), found[1].reshape(len(edges), nodes, width)

    def _split(self, edges: list[np.ndarray], gradient: np.ndarray, curve: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
        """The best feature and cut of each node, and the sums of both sides; a node without gain sends everything left."""
        n_nodes = gradient.shape[1]
        best = np.full(n_nodes, 1e-6)
        features, cuts = np.zeros(n_nodes, np.int64), np.full(n_nodes, np.inf)
        sides = [np.stack([v[0].sum(1), np.zeros(n_nodes)], 1) for v in (gradient, curve)]
        for f, edge in enumerate(edges):
            if not len(edge):
                continue
            g, h = gradient[f].cumsum(1), curve[f].cumsum(1)
            gain = g**2 / (h + self.penalty) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.penalty) - g[:, -1:] ** 2 / (h[:, -1:] + self.penalty)
            cut = gain[:, : len(edge)].argmax(1)
            won = gain[np.arange(n_nodes), cut]
            better = won > best
            best[better], features[better], cuts[better] = won[better], f, edge[cut[better]]
            for side, v in zip(sides, (g, h)):
                left = v[np.arange(n_nodes), cut]
                side[better] = np.stack([left, v[:, -1] - left], 1)[better]
        return (features, cuts), sides[0].ravel(), sides[1].ravel()

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for levels, value in self.trees:
            score += value[_walk(x, levels)]
        return _sigmoid(score)


def bin_edges(examples: DataFrame, bins: int) -> list[np.ndarray]:
    """By feature, the distinct quantiles of all examples that part them into at most ``bins`` bins."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = unpacked(batch.column(0)), batch.column(1).to_numpy()
            if len(x):
                feature = np.tile(np.arange(x.shape[1]), len(x))
                yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(x.ravel().astype(np.int64)), pa.array(np.repeat(n, x.shape[1]))], ["f", "v", "n"])

    values = examples.select("x", "n").mapInArrow(counted, "f long, v long, n long").groupBy("f", "v").agg(F.sum("n").alias("n"))
    each = Window.partitionBy("f")
    sums = values.withColumns({"upto": F.sum("n").over(each.orderBy("v")), "total": F.sum("n").over(each)})
    place = lambda k: F.floor(k * (F.col("total") - 1) / bins)
    holds = F.exists(F.sequence(F.lit(1), F.lit(bins - 1)), lambda k: (place(k) >= F.col("upto") - F.col("n")) & (place(k) < F.col("upto")))
    rows = sums.select("f", "v", holds.alias("holds")).groupBy("f").agg(F.sort_array(F.collect_list(F.when(F.col("holds"), F.col("v")))).alias("edges")).sort("f").collect()
    return [np.array(r.edges, np.int64) for r in rows]
