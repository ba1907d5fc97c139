"""Isolation forest: trees grown in parallel from small repeatable samples, rows scored in place.

Liu, Ting and Zhou (2008). The forest is at most trees x 511 nodes and is broadcast as arrays; a
batch of rows walks all nodes of one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...constants import EPSILON
from ...functions.scalar import clip
from ...session import durable
from .common import as_matrix, detection, row_hash
from .scaling import StandardScaler

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, size int, depth int")
_EULER = 0.5772156649015329
#: Rows that are explained at once.
_EXPLAINED = 4_096


def mean_path(n) -> np.ndarray:
    """Average path length of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2.0 * (np.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Random splits until one row, equal rows or the depth limit: (node, feature, threshold, left, right, size, depth)."""
    nodes: list[tuple] = []
    waiting = [(0, np.arange(len(x)), 0)]
    count = 1
    while waiting:
        node, rows, depth = waiting.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        choices = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(choices) == 0:
            nodes.append((node, -1, 0.0, -1, -1, len(rows), depth))
            continue
        feature = int(rng.choice(choices))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= threshold
        nodes.append((node, feature, threshold, count, count + 1, len(rows), depth))
        waiting += [(count, rows[goes_left], depth + 1), (count + 1, rows[~goes_left], depth + 1)]
        count += 2
    return sorted(nodes)


class IsolationForest:
    """Each tree takes its sample from all rows; any number of rows is scored."""

    def __init__(
        self, features: Sequence[str], trees: int = 100, sample: int = 256, contamination: float = 0.05,
        seed: int = 42,
    ):
        self.features, self.trees, self.sample = list(features), trees, sample
        self.contamination, self.seed = contamination, seed
        self.nodes: pd.DataFrame | None = None
        self.per_tree = 0
        self.offset = 0.0

    def fit(self, df: DataFrame, number: str) -> "IsolationForest":
        """``number`` names a unique row number; the same rows give the same forest, however partitioned."""
        spark = df.sparkSession
        values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in self.features]
        train = df.select(number, *values)
        rows = train.count()
        if rows == 0:
            raise ValueError("no rows to fit on")
        self.per_tree = min(self.sample, rows)
        # Each tree takes its rows by hash: about twice as many as needed, cut to size inside the group.
        share = 1.0 if rows <= self.sample else min(1.0, 2.0 * self.sample / rows)
        bound = int(share * (1 << 40))
        member = F.filter(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: row_hash(
            F.col(number), t, F.lit(self.seed)) < bound)
        chosen = train.withColumn("_tree", F.explode(member)).withColumn(
            "_mark", row_hash(F.col(number), F.col("_tree"), F.lit(self.seed)))
        names, per_tree, seed = self.features, self.per_tree, self.seed

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["_tree"].iloc[0])
            pdf = pdf.sort_values(["_mark", number]).head(per_tree)
            limit = int(np.ceil(np.log2(max(per_tree, 2))))
            nodes = grow_tree(pdf[names].to_numpy(dtype=float), limit, np.random.default_rng([seed, tree]))
            return pd.DataFrame([(tree, *n) for n in nodes], columns=[
                "tree", "node", "feature", "threshold", "left", "right", "size", "depth"])

        grown = chosen.groupBy("_tree").applyInPandas(grow, NODE_SCHEMA)
        self.nodes = grown.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        scores = self._raw(train)
        # A mergeable summary of all scores; the rank is off by at most one in 100,000.
        self.offset = scores.agg(F.percentile_approx("_raw", self.contamination, 100_000)).first()[0]
        return self

    def _arrays(self) -> dict[str, np.ndarray]:
        """Nodes of all trees in one set of arrays, child numbers shifted to be global."""
        nodes = self.nodes
        starts = nodes.groupby("tree").size().cumsum().shift(fill_value=0)
        shift = nodes["tree"].map(starts).to_numpy()
        here = np.arange(len(nodes))
        leaf = nodes["feature"].to_numpy() < 0
        return {
            "roots": starts.to_numpy(), "feature": np.where(leaf, 0, nodes["feature"]),
            "threshold": np.where(leaf, np.inf, nodes["threshold"]),
            "left": np.where(leaf, here, nodes["left"].to_numpy() + shift),
            "right": np.where(leaf, here, nodes["right"].to_numpy() + shift),
            "length": nodes["depth"].to_numpy() + mean_path(nodes["size"].to_numpy()),
            "levels": int(nodes["depth"].max()),
        }

    def _raw(self, df: DataFrame) -> DataFrame:
        """Add ``_raw``: minus the anomaly score, lower is more anomalous."""
        shared = df.sparkSession.sparkContext.broadcast(self._arrays())
        scale = float(mean_path(self.per_tree)) or 1.0

        @F.pandas_udf("double")
        def path_score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            forest = shared.value
            for columns in parts:
                x = as_matrix(columns)
                rows = np.arange(len(x))
                total = np.zeros(len(x))
                for root in forest["roots"]:
                    at = np.full(len(x), root)
                    for _ in range(forest["levels"]):
                        goes_left = x[rows, forest["feature"][at]] <= forest["threshold"][at]
                        at = np.where(goes_left, forest["left"][at], forest["right"][at])
                    total += forest["length"][at]
                yield pd.Series(-np.power(2.0, -total / len(forest["roots"]) / scale))

        return df.withColumn("_raw", path_score(*[F.col(f).cast("double") for f in self.features]))

    def transform(self, df: DataFrame, name: str = "iforest") -> DataFrame:
        """Add the detector result; the confidence is the anomaly score itself."""
        raw = F.col("_raw")
        return detection(self._raw(df), name, raw, clip(-raw, 0, 1), raw < self.offset).drop("_raw")

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE_SCHEMA)

    # --- attribution ---------------------------------------------------------
    def base_value(self) -> float:
        """Mean path length over the forest when nothing is known about a row."""
        nodes = self.nodes
        leaves = nodes[nodes["feature"] < 0]
        roots = nodes[nodes["node"] == 0].set_index("tree")["size"]
        weight = leaves["size"] / leaves["tree"].map(roots)
        return float((weight * (leaves["depth"] + mean_path(leaves["size"]))).sum() / len(roots))

    def attribute(self, df: DataFrame, id_column: str) -> DataFrame:
        """(id, feature, contribution): Shapley values of the mean path length, for all rows, where the rows are.

        What the leaves' paths ask of a row is worked out once and broadcast; its size is that of the forest.
        """
        trees = [leaf_paths(nodes.sort_values("node")) for _, nodes in self.nodes.groupby("tree")]
        shared = df.sparkSession.sparkContext.broadcast(trees)
        names, kind = self.features, df.schema[id_column].dataType.simpleString()

        def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
                for start in range(0, len(x), _EXPLAINED):
                    rows = x[start:start + _EXPLAINED]
                    phi = sum(path_shapley(paths, rows) for paths in shared.value) / len(shared.value)
                    ids = batch.column(0).slice(start, len(rows)).take(pa.array(np.repeat(np.arange(len(rows)), len(names))))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(names * len(rows), pa.string()), pa.array(phi.ravel())], [id_column, "feature", "contribution"])

        values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, f in enumerate(names)]
        return df.select(id_column, *values).mapInArrow(explained, f"{id_column} {kind}, feature string, contribution double")


Path = tuple[float, dict[int, tuple[float, float, float]]]


def leaf_paths(nodes: pd.DataFrame) -> list[Path]:
    """Of each leaf of a tree its path length, and by feature the range a row must lie in and the share of training rows
    that does."""
    table = {int(n.node): n for n in nodes.itertuples()}
    out, waiting = [], [(0, {})]
    while waiting:
        node, path = waiting.pop()
        n = table[node]
        if n.feature < 0:
            out.append((n.depth + float(mean_path(n.size)), path))
            continue
        for child, side in ((n.left, 0), (n.right, 1)):
            low, high, share = path.get(n.feature, (-np.inf, np.inf, 1.0))
            low, high = (low, min(high, n.threshold)) if side == 0 else (max(low, n.threshold), high)
            waiting.append((int(child), {**path, n.feature: (low, high, share * table[int(child)].size / n.size)}))
    return out


def path_shapley(paths: list[Path], x: np.ndarray) -> np.ndarray:
    """Shapley values of one tree's leaf values for all rows, leaf by leaf (Lundberg et al. 2018).

    A leaf counts fully for a known feature whose splits the row passes, and by the share of training
    rows for an unknown one. Sums over feature subsets come from the coefficients of a product.
    """
    phi = np.zeros(x.shape)
    for value, path in paths:
        m = len(path)
        passes = {f: ((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, (low, high, _) in path.items()}
        weights = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
        for f, (_, _, share) in path.items():
            coefficients = np.zeros((m, len(x)))
            coefficients[0] = 1.0
            for other, (_, _, other_share) in path.items():
                if other != f:
                    shifted = np.zeros_like(coefficients)
                    shifted[1:] = coefficients[:-1] * passes[other]
                    coefficients = coefficients * other_share + shifted
            phi[:, f] += value * (passes[f] - share) * (weights @ coefficients)
    return phi


class ScaledForest:
    """Standardised features, isolation forest, and a score scaled to 0..1 over the scored rows."""

    def __init__(self, features: Sequence[str], min_rows: int = 10, **forest):
        self.features, self.min_rows = list(features), min_rows
        self.scaler = StandardScaler(features)
        self.forest = IsolationForest(features, **forest)
        self.seen, self.log = 0, []

    def fit(self, df: DataFrame, number: str) -> "ScaledForest":
        rows = df.count()
        if rows < self.min_rows:
            raise ValueError(f"{rows} rows are too few to fit; {self.min_rows} are needed")
        self.forest.fit(self.scaler.fit(df).transform(df.select(number, *self.features)), number)
        self._note(rows, "fit")
        return self

    def refit(self, df: DataFrame, number: str) -> "ScaledForest":
        """Learn again from new rows with the scaler of the first batch."""
        if not self.log:
            return self.fit(df, number)
        rows = df.count()
        if rows:
            self.forest.fit(self.scaler.transform(df.select(number, *self.features)), number)
            self._note(rows, "partial_fit")
        return self

    def _note(self, rows: int, mode: str) -> None:
        self.seen += rows
        self.log.append({"batch": len(self.log) + 1, "samples": rows, "mode": mode, "total_seen": self.seen})

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``anomaly_score_raw``, ``anomaly_score`` (1 is the most anomalous row) and ``is_anomaly``."""
        hidden = {f: f"_kept_{f}" for f in self.features}
        kept = df.withColumns({hidden[f]: F.col(f) for f in self.features})
        raw = self.forest._raw(self.scaler.transform(kept)).drop(*self.features).withColumnsRenamed(
            {v: k for k, v in hidden.items()})
        # The bounds need all scores; keep them instead of walking the forest twice.
        raw = durable(raw)
        low, high = raw.agg(F.min("_raw"), F.max("_raw")).first()
        scaled = 1.0 - (F.col("_raw") - F.lit(low)) / F.lit((high or 0.0) - (low or 0.0) + EPSILON)
        return raw.withColumns({
            "anomaly_score_raw": F.col("_raw"), "anomaly_score": scaled, "is_anomaly": F.col("_raw") < self.forest.offset,
        }).drop("_raw")
