"""Reconstruction error of a non-linear autoencoder, learned by passes of partial sums over all rows.

The network's weights are a small vector, so it lives on the driver and goes to the tasks; a task runs its Arrow batches
forward and backward and returns one row, the sum of its losses and gradients. The sums are averaged once a pass, whatever
the partitions, and the next weights come from them by the limited-memory BFGS method. A pass asks for several step
lengths at once, so that the line search costs no passes of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_matrix, detection

#: Rows that go through the network at once.
_ROWS_AT_ONCE = 4_096
#: Step lengths that a pass tries; the first is the full step.
_STEPS = (1.0, 0.3, 0.05)
_ARMIJO = 1e-4
#: Pairs of steps and gradient changes that the method remembers.
_MEMORY = 10

Layers = list[tuple[np.ndarray, np.ndarray]]


class Network:
    """Dense layers with rectified units between them and plain outputs; all weights in one vector."""

    def __init__(self, sizes: Sequence[int]):
        self.sizes = list(sizes)
        self.shapes = list(zip(self.sizes, self.sizes[1:]))

    def start(self, seed: int) -> np.ndarray:
        """Uniform weights scaled to the layers (Glorot, Bengio 2010), and zero biases."""
        rng = np.random.default_rng(seed)
        return np.concatenate([np.append(rng.uniform(-1, 1, a * b) * np.sqrt(6.0 / (a + b)), np.zeros(b)) for a, b in self.shapes])

    def layers(self, weights: np.ndarray) -> Layers:
        out, at = [], 0
        for a, b in self.shapes:
            out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def values(self, weights: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """The rows as each layer gives them, the input first."""
        out = [x]
        for i, (w, bias) in enumerate(self.layers(weights)):
            x = x @ w + bias
            x = np.maximum(x, 0.0) if i < len(self.shapes) - 1 else x
            out.append(x)
        return out

    def loss(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The sum over rows of half the squared error of the reconstruction, followed by its gradient."""
        values, layers, parts = self.values(weights, x), self.layers(weights), []
        back = values[-1] - x
        total = 0.5 * float((back**2).sum())
        for i in reversed(range(len(layers))):
            parts.append(np.append(values[i].T @ back, back.sum(axis=0)))
            if i:
                back = (back @ layers[i][0].T) * (values[i] > 0)
        return np.concatenate([[total], *reversed(parts)])


class Autoencoder:
    """A bottleneck of rectified layers that learns to give rows back; what it can't give back is unusual.

    Nulls count as 0. Columns should be scaled. ``passes`` bounds the reading of the table; fewer are made when the
    gradient vanishes.
    """

    def __init__(self, features: Sequence[str], hidden: Sequence[int] = (16, 8, 16), passes: int = 30, penalty: float = 1e-4, seed: int = 42):
        self.features, self.passes, self.penalty, self.seed = list(features), passes, penalty, seed
        self.network = Network([len(self.features), *hidden, len(self.features)])
        self.weights = self.network.start(seed)
        self.losses: list[float] = []

    def _sums(self, rows: DataFrame, asked: list[np.ndarray]) -> tuple[np.ndarray, int]:
        """Loss and gradient at each of the asked weights, summed over all rows; and the number of rows."""
        network = self.network

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((len(asked), 1 + len(asked[0]))), 0
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                n += len(x)
                for start in range(0, len(x), _ROWS_AT_ONCE):
                    total += [network.loss(w, x[start:start + _ROWS_AT_ONCE]) for w in asked]
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([n])], ["sums", "n"])

        got = rows.mapInArrow(partial, "sums array<double>, n long").collect()
        total = np.sum([r.sums for r in got], axis=0) if got else np.zeros(len(asked) * (1 + len(asked[0])))
        return np.reshape(total, (len(asked), -1)), sum(r.n for r in got)

    def fit(self, df: DataFrame) -> "Autoencoder":
        """Learn from all rows; goes on from the present weights, so it can be called batch after batch."""
        rows = df.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in self.features])
        steps: list[np.ndarray] = []
        changes: list[np.ndarray] = []
        at, loss, gradient = self.weights, np.inf, None
        direction, reach = np.zeros_like(at), 1.0
        for _ in range(self.passes):
            tried = [at + reach * s * direction for s in (_STEPS if gradient is not None else (0.0,))]
            sums, n = self._sums(rows, tried)
            if not n:
                return self
            losses = sums[:, 0] / n + 0.5 * self.penalty * np.array([w @ w for w in tried])
            gradients = sums[:, 1:] / n + self.penalty * np.array(tried)
            if gradient is not None:
                slope = float(gradient @ direction)
                good = [i for i, s in enumerate(_STEPS) if losses[i] <= loss + _ARMIJO * s * reach * slope]
                if not good:  # shorter steps, along the steepest descent if even that fails
                    reach *= _STEPS[-1] * 0.3
                    if reach < 1e-6:
                        if not steps:
                            break
                        steps, changes = [], []
                        direction, reach = -gradient, 1.0 / max(1.0, float(np.linalg.norm(gradient)))
                    continue
                best = min(good, key=lambda i: losses[i])
                step, change = tried[best] - at, gradients[best] - gradient
                if step @ change > 1e-12:
                    steps, changes = (steps + [step])[-_MEMORY:], (changes + [change])[-_MEMORY:]
                at, loss, gradient = tried[best], float(losses[best]), gradients[best]
            else:
                loss, gradient = float(losses[0]), gradients[0]
            self.losses.append(loss)
            if np.linalg.norm(gradient) < 1e-7:
                break
            direction = -_scaled(gradient, steps, changes)
            reach = 1.0 if steps else 1.0 / max(1.0, float(np.linalg.norm(gradient)))
        self.weights = at
        return self

    def transform(self, df: DataFrame, name: str = "autoencoder") -> DataFrame:
        shared, network = df.sparkSession.sparkContext.broadcast(self.weights), self.network

        @F.pandas_udf("double")
        def error(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                x = as_matrix(columns)
                yield pd.Series(((network.values(shared.value, x)[-1] - x) ** 2).mean(axis=1))

        scored = df.withColumn("_error", error(*[F.col(f).cast("double") for f in self.features]))
        confidence = 1.0 - F.exp(-0.5 * F.col("_error"))
        return detection(scored, name, F.col("_error"), confidence, confidence > 0.8).drop("_error")


def _scaled(gradient: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """The gradient times the inverse curvature that the remembered steps tell (two-loop recursion)."""
    q, factors = gradient.copy(), []
    for s, y in zip(reversed(steps), reversed(changes)):
        a = (s @ q) / (s @ y)
        factors.append(a)
        q -= a * y
    if steps:
        q *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for s, y, a in zip(steps, changes, reversed(factors)):
        q += s * (a - (y @ q) / (s @ y))
    return q
