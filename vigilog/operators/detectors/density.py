"""Detectors by density: local outlier factors, one-class boundary; reconstruction error of linear components."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.scalar import clip
from ...session import durable
from .common import as_matrix, collect_matrix, detection

_ROWS_AT_ONCE = 512
#: Leaves of the neighbour search's upper level at most, and rows of the samples for each leaf or cell.
MAX_CELLS, _SAMPLE_ROWS = 16_384, 32
#: Rows beyond which a cell, and asking rows beyond which the asking of a leaf, are cut into parts.
_CELL_ROWS, _ASKED_ROWS = 10_000, 200_000
#: Rows of a leaf that a task searches at once, about; a leaf of more than twice as many is cut into shares.
_LEAF_ROWS = 100_000
#: Rows of the boxes that a search goes through, asking rows that go through them together, and boxes that they ask at once.
_BOX_ROWS, _BLOCK_ROWS, _BOXES_AT_ONCE = 64, 128, 32
#: More than the relative error of squared distances in single precision.
_SINGLE = 1e-5
#: Rows that are mapped to cosine features at once, and about so many that the offset is guessed from.
_MAPPED_AT_ONCE, _GUESS_ROWS = 1_024, 8_192


def nearest(x: np.ndarray, history: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of the k nearest history rows of each row, nearest first.

    ``skip`` gives the place in the history that is the row itself.
    """
    places, distances = [], []
    norms = (history**2).sum(axis=1)
    for start in range(0, len(x), _ROWS_AT_ONCE):
        part = x[start:start + _ROWS_AT_ONCE]
        square = np.maximum((part**2).sum(axis=1)[:, None] + norms[None, :] - 2.0 * part @ history.T, 0.0)
        if skip is not None:
            square[np.arange(len(part)), skip[start:start + _ROWS_AT_ONCE]] = np.inf
        best = np.argpartition(square, k - 1, axis=1)[:, :k] if k < square.shape[1] else np.argsort(square, axis=1)[:, :k]
        # Exact distances for the few chosen, free of the cancellation in the expanded square.
        exact = np.sqrt(((part[:, None, :] - history[best]) ** 2).sum(axis=2))
        order = np.lexsort((best, exact), axis=1)
        places.append(np.take_along_axis(best, order, axis=1))
        distances.append(np.take_along_axis(exact, order, axis=1))
    return np.vstack(distances), np.vstack(places)


def nearest_distance(df: DataFrame, features: Sequence[str], history: np.ndarray, k: int, name: str) -> DataFrame:
    """Distance of every row to its k-th nearest row of a bounded history (broadcast, no join)."""
    shared = df.sparkSession.sparkContext.broadcast(history)

    @F.pandas_udf("double")
    def kth(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            distances, _ = nearest(as_matrix(columns), shared.value, k)
            yield pd.Series(distances[:, -1])

    return df.withColumn(name, kth(*[F.col(f).cast("double") for f in features]))


def nearest_of_all(
    asked: DataFrame, df: DataFrame, features: Sequence[str], number: str, k: int, name: str, block: int = 2_000
) -> DataFrame:
    """(number, name): the distance of each asked row to its k-th nearest of all rows of ``df``, exactly.

    The asked rows are a stated set. They go to the rows in blocks of ``block``, one pass a block; a task keeps the k
    nearest of its own rows for each asked one, so k values a task and asked row are shuffled.
    """
    columns = [number, *features]
    kind = df.schema[number].dataType.simpleString()
    numbered = asked.select(*columns).orderBy(number)
    total, found = asked.count(), None
    for start in range(0, max(total, 1), block):
        part = numbered.offset(start).limit(block)
        keys = [r[0] for r in part.select(number).collect()]
        shared = df.sparkSession.sparkContext.broadcast((keys, collect_matrix(part, features)))

        def closest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, x = shared.value
            best = np.full((len(own), k), np.inf)
            for batch in batches:
                rows = np.nan_to_num(np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns]), nan=0.0)
                for at in range(0, len(rows), _ROWS_AT_ONCE):
                    some = rows[at:at + _ROWS_AT_ONCE]
                    d = np.stack([((some - q) ** 2).sum(axis=1) for q in x]) if len(x) else np.zeros((0, len(some)))
                    best = np.partition(np.hstack([best, d]), k - 1, axis=1)[:, :k]
            near = np.isfinite(best)
            yield pa.RecordBatch.from_arrays(
                [pa.array([own[i] for i in np.nonzero(near)[0]]), pa.array(np.sqrt(best[near]))], [number, "d"])

        near = df.select(*features).mapInArrow(closest, f"{number} {kind}, d double")
        found = near if found is None else found.unionByName(near)
    return found.groupBy(number).agg(F.get(F.sort_array(F.collect_list("d")), F.lit(k - 1)).alias(name))


class Boxes:
    """Rows in small boxes by median splits, asked for the nearest rows by blocks of rows that lie near each other.

    A block goes through the boxes from the nearest on and leaves off where no box is nearer than what its rows have found.
    Single precision, with its error allowed for, only tells which distances are worked out in full.
    """

    def __init__(self, x: np.ndarray, size: int = _BOX_ROWS):
        parts = _split_rows(x, size)
        self.order, self.sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        self.x, self.starts = x[self.order], np.cumsum(self.sizes) - self.sizes
        self.low, self.high = np.minimum.reduceat(self.x, self.starts), np.maximum.reduceat(self.x, self.starts)

    def nearest(self, q: np.ndarray, k: int, bound: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and places of the up to k nearest rows nearer than the bound, nearest first; without more: infinite, -1.

        ``skip`` gives for each asking row the place that is the row itself.
        """
        found = [self._block(q[at:at + _BLOCK_ROWS], k, bound[at:at + _BLOCK_ROWS], None if skip is None else skip[at:at + _BLOCK_ROWS])
                 for at in range(0, len(q), _BLOCK_ROWS)]
        return np.vstack([d for d, _ in found]), np.vstack([p for _, p in found])

    def _block(self, q: np.ndarray, k: int, bound: np.ndarray, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        best, place = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        limit = bound**2 * (1 + 1e-9)
        gap = _gaps(q.min(axis=0), q.max(axis=0), self.low, self.high)
        boxes = np.argsort(gap, kind="stable")
        middle = q.mean(axis=0)
        centred = (q - middle).astype(np.float32)
        norms = (1 - _SINGLE) * (centred**2).sum(axis=1)
        asking = np.column_stack([-2 * centred, np.ones(len(q), np.float32)])
        for at in range(0, len(boxes), _BOXES_AT_ONCE):
            active = np.flatnonzero(limit > gap[boxes[at]])
            if not len(active):
                break
            some = boxes[at:at + _BOXES_AT_ONCE]
            rows = np.repeat(self.starts[some] - np.cumsum(self.sizes[some]) + self.sizes[some], self.sizes[some]) + np.arange(self.sizes[some].sum())
            x = self.x[rows]
            own = (x - middle).astype(np.float32)
            square = asking[active] @ np.column_stack([own, (1 - _SINGLE) * (own**2).sum(axis=1)]).T
            free = np.flatnonzero(np.isinf(limit[active]))
            if len(free) and len(rows) > k:  # the first boxes: k of their rows give a bound
                few = np.argpartition(square[free], k, axis=1)[:, :k + 1]
                exact = ((q[active[free]][:, None, :] - x[few]) ** 2).sum(axis=2)
                if skip is not None:
                    exact[rows[few] == skip[active[free]][:, None]] = np.inf
                limit[active[free]] = np.partition(exact, k - 1, axis=1)[:, k - 1] * (1 + 1e-9)
            r, c = np.nonzero(square <= (limit[active] - norms[active]).astype(np.float32)[:, None] + np.float32(1e-30))
            if skip is not None:
                other = rows[c] != skip[active[r]]
                r, c = r[other], c[other]
            if not len(r):
                continue
            exact = ((q[active[r]] - x[c]) ** 2).sum(axis=1)
            touched, first, count = np.unique(r, return_index=True, return_counts=True)
            column = k + np.arange(len(r)) - np.repeat(first, count)
            which = np.repeat(np.arange(len(touched)), count)
            both, places = np.full((len(touched), k + count.max()), np.inf), np.full((len(touched), k + count.max()), -1)
            both[:, :k], places[:, :k] = best[active[touched]], place[active[touched]]
            both[which, column], places[which, column] = exact, rows[c]
            keep = np.argpartition(both, k - 1, axis=1)[:, :k]
            best[active[touched]] = now = np.take_along_axis(both, keep, axis=1)
            place[active[touched]] = np.take_along_axis(places, keep, axis=1)
            limit[active[touched]] = np.minimum(limit[active[touched]], now.max(axis=1) * (1 + 1e-9))
        order = np.lexsort((place, best), axis=1)
        best, place = np.sqrt(np.take_along_axis(best, order, axis=1)), np.take_along_axis(place, order, axis=1)
        far = best >= bound[:, None]
        best[far], place[far] = np.inf, -1
        return best, np.where(place < 0, -1, self.order[place])


def _split_rows(x: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of rows by median splits along the widest feature, down to ``size`` rows or equal ones, near ones next to each other."""
    out, waiting = [], [np.arange(len(x))]
    while waiting:
        rows = waiting.pop()
        part = x[rows]
        spread = part.max(axis=0) - part.min(axis=0) if len(rows) > size else np.zeros(1)
        if not spread.any():
            out.append(rows)
            continue
        f = int(np.argmax(np.where(spread > 0, part.var(axis=0), -1.0)))
        cut = float(np.median(part[:, f]))
        low = part[:, f] <= cut
        if low.all():
            low = part[:, f] < cut
        waiting += [rows[~low], rows[low]]
    return out


def _gaps(q_low: np.ndarray, q_high: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of one box to many."""
    return (np.maximum(0.0, np.maximum(low - q_high, q_low - high)) ** 2).sum(axis=1)


class CellTree:
    """Median splits along the widest feature, learned from a sample: deals rows into cells of near rows."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.feature, self.threshold, self.child, self.leaves = [], [], [], 0
        self._split(x, leaf)

    def _split(self, x: np.ndarray, leaf: int) -> int:
        at = len(self.feature)
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.child.append((-1, -1))
        if len(x) > leaf:
            for f in np.argsort(-x.var(axis=0)):
                cut = float(np.median(x[:, f]))
                if not (x[:, f] > cut).any():
                    lower = x[x[:, f] < cut, f]
                    if not len(lower):
                        continue
                    cut = float(lower.max())
                inner = x[:, f] <= cut
                self.feature[at], self.threshold[at] = int(f), cut
                self.child[at] = (self._split(x[inner], leaf), self._split(x[~inner], leaf))
                return at
        self.child[at] = (self.leaves, -1)
        self.leaves += 1
        return at

    def cells(self, x: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            inner, outer = self.child[node]
            if self.feature[node] < 0:
                out[rows] = inner
                continue
            low = x[rows, self.feature[node]] <= self.threshold[node]
            stack += [(inner, rows[low]), (outer, rows[~low])]
        return out


class Cells:
    """Rows in cells of near rows, in two levels of median splits, and the boxes of both levels.

    The upper tree has about as many leaves as each of its leaves has cells. It is learned from a sample of all rows and
    broadcast with the boxes of its leaves, some thousands even for very many rows. A lower tree is learned from a sample
    of its leaf's rows, where they are; it and the boxes of its cells stay with the leaf. The samples decide only who is
    dealt where. A cell that stays large, since its rows are equal, is cut by a row hash.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], number: str, cell: int):
        self.names, self.number, self.cell = list(features), number, cell
        self.kind = df.schema[number].dataType.simpleString()
        self.columns = ", ".join(f"{f} double" for f in self.names)
        fixed = durable(df.select(number, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in self.names]))
        self.leaves = durable(self._upper(fixed))
        self.placed = durable(self._shared(self._lower(self.leaves)))
        self.shards = durable(self.placed.select("_leaf", "_shard").distinct())
        low, high = ([f(n).alias(f"{k}{i}") for i, n in enumerate(self.names)] for k, f in (("l", F.min), ("h", F.max)))
        self.boxes = durable(self.placed.groupBy("_leaf", "_cell").agg(*low, *high))

    def _hash(self, label: str) -> Column:
        return F.xxhash64(F.lit(label), self.number)

    def _upper(self, fixed: DataFrame) -> DataFrame:
        total = fixed.count()
        wanted = max(1, min(max(int(np.ceil(np.sqrt(total / self.cell))), -(-total // _LEAF_ROWS)), MAX_CELLS))
        each = max(1, total // (wanted * _SAMPLE_ROWS))
        sample = collect_matrix(fixed.where(F.pmod(self._hash("upper"), F.lit(each)) == 0), self.names)
        shared = fixed.sparkSession.sparkContext.broadcast(CellTree(sample, max(1, -(-len(sample) // wanted))))

        @F.pandas_udf("long")
        def leaf(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                yield pd.Series(shared.value.cells(as_matrix(columns)))

        return fixed.withColumn("_leaf", leaf(*self.names))

    def _lower(self, leaves: DataFrame) -> DataFrame:
        sizes = leaves.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_cells", F.ceil(F.col("_rows") / self.cell))
        names, columns = self.names, f"{self.number} {self.kind}, {self.columns}, _leaf long, _cell long"
        share = F.greatest(F.lit(1), F.floor(F.col("_rows") / (F.col("_cells") * _SAMPLE_ROWS)))
        sample = leaves.join(F.broadcast(sizes), "_leaf").where(F.pmod(self._hash("lower"), share) == 0)

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            cells = int(pdf["_cells"].iloc[0])
            tree = CellTree(pdf.sort_values(names)[names].to_numpy(dtype=float), max(1, -(-len(pdf) // cells)))
            return pd.DataFrame({"_leaf": [pdf["_leaf"].iloc[0]], "tree": [pickle.dumps(tree, 5)]})

        trees = durable(sample.groupBy("_leaf").applyInPandas(grow, "_leaf long, tree binary"))

        def deal(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({c: [] for c in (self_number, *names, "_leaf", "_cell")})
            cells = pickle.loads(tree["tree"].iloc[0]).cells(rows[names].to_numpy(dtype=float)) if len(tree) else np.zeros(len(rows), np.int64)
            return rows[[self_number, *names, "_leaf"]].assign(_cell=rows["_leaf"] * (1 << 36) + cells * (1 << 16))

        self_number = self.number
        left, right = self._salted(leaves, trees, "_leaf", "deal")
        dealt = durable(left.cogroup(right).applyInPandas(deal, columns))
        # Equal rows that no split parts.
        parts = dealt.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / _CELL_ROWS).alias("_parts")).where("_parts > 1")
        part = F.when(F.col("_parts").isNotNull(), F.pmod(self._hash("parts"), F.least(F.col("_parts"), F.lit((1 << 16) - 1)))).otherwise(F.lit(0))
        return dealt.join(parts, "_cell", "left").withColumn("_cell", F.col("_cell") + part).drop("_parts")

    def _shared(self, placed: DataFrame) -> DataFrame:
        """Add ``_shard``, a leaf or the share of a very large one."""
        large = self.leaves.groupBy("_leaf").agg(F.floor(F.count(F.lit(1)) / _LEAF_ROWS).alias("_shares")).where("_shares > 1")
        share = F.when(F.col("_shares").isNotNull(), F.pmod(self._hash("share"), F.least(F.col("_shares"), F.lit(1 << 16)))).otherwise(F.lit(0))
        return placed.join(F.broadcast(large), "_leaf", "left").withColumn("_shard", F.shiftleft("_leaf", 16) + share).drop("_shares")

    def _salted(self, rows: DataFrame, side: DataFrame, by: str, label: str):
        """Both frames grouped by the column and a part, so that at most some ``_ASKED_ROWS`` rows meet the side's."""
        # One row a leaf or shard.
        sizes = [tuple(r) for r in rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / _ASKED_ROWS)).collect()]
        parts = rows.sparkSession.createDataFrame(sizes, f"{by} long, _parts long")
        left = rows.join(F.broadcast(parts), by).withColumn("_part", F.pmod(self._hash(label), F.col("_parts"))).drop("_parts")
        again = parts.select(F.col(by).alias("_by"), F.col("_parts").alias("_times"))
        right = side.join(F.broadcast(again), F.col(by) == F.col("_by")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
        return left.groupBy(by, "_part"), right.drop("_by", "_times").groupBy(by, "_part")

    def asked(self, bounded: DataFrame) -> DataFrame:
        """(number, features, _bound, _shard): each row with every other shard that has a box nearer than the row's bound.

        The boxes are those of the cells, neighbouring ones of a leaf together where there are more than ``MAX_CELLS``.
        """
        n, names, number = len(self.names), self.names, self.number
        together = -(-self.boxes.count() // MAX_CELLS)
        group = F.floor(F.shiftright(F.col("_cell").bitwiseAND((1 << 36) - 1), 16) / together)
        ends = [f(f"{k}{i}").alias(f"{k}{i}") for k, f in (("l", F.min), ("h", F.max)) for i in range(n)]
        boxes = self.boxes.groupBy("_leaf", group.alias("_group")).agg(*ends).toPandas()
        shared = bounded.sparkSession.sparkContext.broadcast((boxes["_leaf"].to_numpy(), *_corners(boxes, n)))
        rows = bounded.select(number, *names, "_bound", F.shiftright("_shard", 16).alias("_from"), "_shard")

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaf, low, high = shared.value
            for batch in batches:
                x, bound, home = _matrix(batch, names), batch["_bound"].to_numpy(), batch["_from"].to_numpy()
                for at, hit in _near(x, bound, low, high):
                    pairs = np.unique(np.column_stack([at, leaf[hit]])[(leaf[hit] != home[at]) | (batch["_shard"].to_numpy()[at] & 0xFFFF > 0)], axis=0)
                    out = batch.take(pa.array(pairs[:, 0]))
                    yield pa.RecordBatch.from_arrays([*out.columns[:n + 2], out["_shard"], pa.array(pairs[:, 1])], [number, *names, "_bound", "_own", "_leaf"])

        found = rows.mapInArrow(leaves, f"{number} {self.kind}, {self.columns}, _bound double, _own long, _leaf long")
        shares = self.shards.groupBy("_leaf").agg(F.collect_list("_shard").alias("_shards"))
        each = found.join(F.broadcast(shares), "_leaf").select(number, *names, "_bound", "_own", F.explode("_shards").alias("_shard"))
        return each.where("_shard <> _own").drop("_own")


def _corners(boxes: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(boxes[[f"{k}{i}" for i in range(n)]].to_numpy(dtype=float) for k in "lh")


def _matrix(rows: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([rows[c].to_numpy() if isinstance(rows, pa.Table) else rows[c].to_numpy(zero_copy_only=False) for c in names])


def _near(x: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row and a box that is nearer than the row's bound, block by block; quick for rows next to near ones."""
    for start in range(0, len(x), _BLOCK_ROWS):
        rows = x[start:start + _BLOCK_ROWS]
        # A little wider than the bound, against rounding.
        limit = (bound[start:start + _BLOCK_ROWS] * (1 + 1e-9)) ** 2
        gap = _gaps(rows.min(axis=0), rows.max(axis=0), low, high)
        boxes = np.flatnonzero(gap < limit.max())
        boxes = boxes[np.argsort(gap[boxes], kind="stable")]
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(boxes), _BLOCK_ROWS):
            some, active = boxes[at:at + _BLOCK_ROWS], np.flatnonzero(limit > gap[boxes[at]])
            square = np.zeros((len(active), len(some)))
            for f in range(x.shape[1]):
                own = rows[active, f][:, None]
                square += np.maximum(0.0, np.maximum(low[some, f] - own, own - high[some, f])) ** 2
            r, c = np.nonzero(square < limit[active][:, None])
            pairs.append((start + active[r], some[c]))
        yield tuple(np.concatenate(p) for p in zip(*pairs))


def _listed(number: pa.Array, ids: pa.Array, d: np.ndarray, places: np.ndarray) -> list[pa.Array]:
    """The asking rows' numbers and, as lists of (_d, _id), what they found."""
    found = places >= 0
    ends = np.concatenate([[0], found.sum(axis=1).cumsum()])
    near = pa.StructArray.from_arrays([pa.array(d[found]), ids.take(pa.array(places[found]))], ["_d", "_id"])
    return [number, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)]


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def inside_cells(cells: Cells, k: int) -> DataFrame:
    """Each row with its k nearest inside its own shard (``near``) and the k-th distance, infinite if there is none."""
    names, number, few = cells.names, cells.number, cells.cell

    def inside(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(number)
        x = _matrix(rows, names)
        if len(x) <= few:
            order, d, p = np.arange(len(x)), np.zeros((len(x), 0)), np.zeros((len(x), 0), np.int64)
            if len(x) > 1:
                d, p = nearest(x, x, min(k, len(x) - 1), skip=order)
        else:
            boxes = Boxes(x)
            order = boxes.order
            d, p = boxes.nearest(boxes.x, k, np.full(len(x), np.inf), skip=np.arange(len(x)))
        bound = d[:, -1] if d.shape[1] == k else np.full(len(x), np.inf)
        out = rows.take(pa.array(order))
        _, near = _listed(None, _one(rows[number]), d, p)
        return pa.table([*(out[c] for c in (number, "_shard", *names)), pa.array(bound), near], [number, "_shard", *names, "_bound", "near"])

    near = f"array<struct<_d:double,_id:{cells.kind}>>"
    rows = cells.placed.select(number, "_shard", *names)
    return durable(rows.groupBy("_shard").applyInArrow(inside, f"{number} {cells.kind}, _shard long, {cells.columns}, _bound double, near {near}"))


def neighbours_by_cells(df: DataFrame, features: Sequence[str], number: str, k: int, cell: int = 2_000) -> DataFrame:
    """(number, near): the k nearest of all rows for every row, as (_d, _id), nearest first. Exact.

    Rows are dealt into leaves and, in them, cells of about ``cell`` rows. A leaf is searched whole, through small boxes.
    The k-th distance inside its own leaf bounds a row's further search: the row also asks each other leaf with a cell whose
    bounding box is nearer than that, so no neighbour is lost. Leaves of very many equal rows are shards, asked one by one.
    """
    cells = Cells(df, features, number, cell)
    names, near_type = cells.names, f"array<struct<_d:double,_id:{cells.kind}>>"
    own = inside_cells(cells, k)
    asked = durable(cells.asked(own.drop("near")))

    def others(one: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(one) or not len(rows):
            return pa.table({number: one[number].slice(0, 0), "near": pa.array([], pa.list_(pa.struct([("_d", pa.float64()), ("_id", one.schema.field(number).type)])))})
        rows = rows.sort_by(number)
        x, q, bound = _matrix(rows, names), _matrix(one, names), one["_bound"].to_numpy()
        # Near ones next to each other.
        order = np.concatenate(_split_rows(q, _BLOCK_ROWS))
        d, p = Boxes(x).nearest(q[order], k, bound[order])
        some = p[:, 0] >= 0
        columns = _listed(_one(one[number]).take(pa.array(order[some])), _one(rows[number]), d[some], p[some])
        return pa.table(columns, [number, "near"])

    left, right = cells._salted(asked, cells.placed.select(number, "_shard", *names), "_shard", "others")
    more = left.cogroup(right).applyInArrow(others, f"{number} {cells.kind}, near {near_type}")
    found = own.select(number, "near").unionByName(more)
    return found.groupBy(number).agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def outlier_factors(df: DataFrame, features: Sequence[str], number: str, k: int = 20, contamination: float = 0.05, name: str = "lof") -> DataFrame:
    """Local outlier factor of every row against all rows, with the exact neighbours; no history is cut.

    Where rows have fewer than ``k`` others, there is no density yet: every row gets 0 and no flag.
    """
    if df.limit(k + 1).count() <= k:
        return detection(df, name, F.lit(0.0), F.lit(0.0), F.lit(False))
    near = durable(neighbours_by_cells(df, features, number, k))
    reach = near.select(F.col(number).alias("_id"), F.element_at("near", -1)["_d"].alias("_reach"))
    pairs = near.select(number, F.explode("near").alias("_n")).select(number, "_n._d", "_n._id")
    density = 1.0 / (F.avg(F.greatest("_d", "_reach")) + 1e-10)
    dense = durable(pairs.join(reach, "_id").groupBy(number).agg(density.alias("_density")))
    around = pairs.join(dense.withColumnRenamed(number, "_id"), "_id").groupBy(number).agg(F.avg("_density").alias("_around"))
    factors = durable(around.join(dense, number).select(number, (F.col("_around") / F.col("_density")).alias("_factor")))
    offset = factors.agg(F.percentile_approx(-F.col("_factor"), contamination, 100_000)).first()[0]
    value = F.col("_factor")
    scored = df.join(factors, number, "left").withColumn("_factor", F.coalesce("_factor", F.lit(1.0)))
    return detection(scored, name, -value, clip((value - 1.0) / 2.0, 0, 1), F.coalesce(-value < F.lit(offset), F.lit(False))).drop("_factor")


class OneClassBoundary:
    """One-class support vector machine with a Gaussian kernel, approximated by random cosine features.

    Rahimi and Recht (2007). The linear problem over the features is solved by subgradient steps over all rows of the
    history. The best offset for a direction is the nu-quantile of the projections, found on a histogram; a step is one
    pass, one small row a task. Some rows tell beforehand about where the offset lies, so that the pass can keep the sums of
    the bins there apart; the counts of all rows decide, and where that guess fails the step takes a second pass.
    """

    def __init__(self, features: Sequence[str], nu: float = 0.05, width: int = 128, steps: int = 40, seed: int = 42):
        self.features, self.nu, self.width, self.steps, self.seed = list(features), nu, width, steps, seed

    def _map(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / self.width) * np.cos(x @ self.directions + self.phases)

    def fit(self, history: DataFrame) -> "OneClassBoundary":
        names = self.features
        cells = history.select(F.explode(F.array(*[
            F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in names])).alias("x"))
        variance = cells.agg(F.var_pop("x")).first()[0]
        gamma = 1.0 / (len(names) * variance) if variance else 1.0
        rng = np.random.default_rng(self.seed)
        self.directions = rng.normal(0.0, np.sqrt(2.0 * gamma), (len(names), self.width))
        self.phases = rng.uniform(0.0, 2.0 * np.pi, self.width)
        mapped = self._map
        rows = history.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in names])
        # One bin first: the sum of all mapped rows.
        counts, total, _ = self._by_bin(rows, np.zeros(self.width), np.array([-1.0, 1.0]), 1, 1)
        n, nu = int(counts.sum()), self.nu
        w = total / n
        some = mapped(collect_matrix(rows.sample(min(1.0, _GUESS_ROWS / n), self.seed), names))
        best, best_loss = (w, 0.0), np.inf
        for step in range(self.steps):
            edges = _edges(w)
            low, high = _guess(some @ w, edges, nu)
            counts, head, near = self._by_bin(rows, w, edges, low, high)
            place = min(int(np.searchsorted(np.cumsum(counts), nu * n)) + 1, len(edges) - 1)
            if not low <= place <= high:  # the guess was wrong
                low = place
                _, head, near = self._by_bin(rows, w, edges, place, place)
            # The offset is an edge, so the rows outside are those of the bins before it.
            rho, total = float(edges[place]), head + near[:place - low].sum(axis=0)
            short = rho * counts[:place].sum() - w @ total
            loss = 0.5 * w @ w - rho + short / (nu * n)
            if loss < best_loss:
                best, best_loss = (w, rho), loss
            rate = 1.0 / (step + 2.0)
            w = (1.0 - rate) * w + rate * total / max(nu * n, 1.0)
        self.w, self.rho = best
        self.scale = nu * n
        return self

    def _by_bin(self, rows: DataFrame, w: np.ndarray, edges: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the projections of all rows on ``w``: the rows in each histogram bin, the sum of the mapped rows in the bins
        before ``low``, and that of each bin from ``low`` to ``high``."""
        mapped, bins, width = self._map, len(edges) - 1, self.width

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, head, near = np.zeros(bins), np.zeros(width), np.zeros((high - low, width))
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                for start in range(0, len(x), _MAPPED_AT_ONCE):
                    z = mapped(x[start:start + _MAPPED_AT_ONCE])
                    place = np.clip(np.searchsorted(edges, z @ w, side="right") - 1, 0, bins - 1)
                    counts += np.bincount(place, minlength=bins)
                    head += (place < low) @ z
                    found = np.flatnonzero((place >= low) & (place < high))
                    np.add.at(near, place[found] - low, z[found])
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([counts, head, near.ravel()])])], ["sums"])

        total = np.sum([r[0] for r in rows.mapInArrow(partial, "sums array<double>").collect()], axis=0)
        return total[:bins], total[bins:bins + width], total[bins + width:].reshape(-1, width)

    def transform(self, df: DataFrame, name: str = "ocsvm") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.w, self.rho, self.scale))
        mapped = self._map

        @F.pandas_udf("double")
        def decision(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            w, rho, scale = shared.value
            for columns in parts:
                yield pd.Series(scale * (mapped(as_matrix(columns)) @ w - rho))

        scored = df.withColumn("_decision", decision(*[F.col(f).cast("double") for f in self.features]))
        value = F.col("_decision")
        return detection(scored, name, value, clip(0.5 - value / 10.0, 0, 1), value < 0).drop("_decision")


def _edges(w: np.ndarray, cells: int = 2_000) -> np.ndarray:
    """Histogram edges over the possible range of the projections."""
    reach = float(np.abs(w).sum()) * np.sqrt(2.0 / len(w)) + 1e-12
    return np.linspace(-reach, reach, cells + 1)


def _guess(projected: np.ndarray, edges: np.ndarray, nu: float) -> tuple[int, int]:
    """Edges between which the nu-quantile of all rows probably lies, by some of them."""
    if not len(projected):
        return 1, 1
    ends = np.searchsorted(edges, np.quantile(projected, [0.7 * nu, min(1.0, 1.3 * nu)]))
    return max(1, int(ends[0]) - 2), min(len(edges) - 1, int(ends[1]) + 2)


class ReconstructionError:
    """Error of rebuilding a row from its leading components: the best linear autoencoder.

    Baldi and Hornik (1989). A bottleneck of eight values, learned from one covariance aggregation.
    """

    def __init__(self, features: Sequence[str], bottleneck: int = 8):
        self.features, self.bottleneck = list(features), bottleneck

    def fit(self, df: DataFrame) -> "ReconstructionError":
        names = self.features
        value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        row = df.agg(
            *[F.avg(value(f)).alias(f"m{i}") for i, f in enumerate(names)],
            *[F.covar_pop(value(names[i]), value(names[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
        covariance = np.zeros((len(names), len(names)))
        for i, j in pairs:
            covariance[i, j] = covariance[j, i] = row[f"c{i}_{j}"] or 0.0
        self.mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(names))])
        _, vectors = np.linalg.eigh(covariance)
        self.components = vectors[:, ::-1][:, :min(self.bottleneck, len(names))]
        return self

    def transform(self, df: DataFrame, name: str = "autoencoder") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.mean, self.components))

        @F.pandas_udf("double")
        def error(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            mean, components = shared.value
            for columns in parts:
                centred = as_matrix(columns) - mean
                yield pd.Series(((centred - centred @ components @ components.T) ** 2).mean(axis=1))

        scored = df.withColumn("_error", error(*[F.col(f).cast("double") for f in self.features]))
        confidence = 1.0 - F.exp(-0.5 * F.col("_error"))
        return detection(scored, name, F.col("_error"), confidence, confidence > 0.8).drop("_error")
