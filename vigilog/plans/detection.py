"""Detection plans: all detectors over one feature table, and the single-table analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ENSEMBLE_WEIGHTS
from ..operators.detectors import autoencoder, density, forest, statistical
from ..operators.features_local import FEATURES as LOCAL_FEATURES
from ..operators.features_local import local_features
from ..operators.threat import with_threat_level


def ensemble_detection(
    df: DataFrame, features: Sequence[str], order: Sequence[str], number: str, weights: dict[str, float] | None = None
) -> DataFrame:
    """Every detector with a weight, each as a struct column, and the weighted verdict.

    ``df`` holds scaled features and should be a stored table, since each detector reads it.
    """
    weights = ENSEMBLE_WEIGHTS if weights is None else weights
    wanted = [name for name, weight in weights.items() if weight]
    out = df
    # First, over the stored rows: neighbours read them several times, and what is added later would be worked out again.
    if "lof" in wanted:
        out = density.outlier_factors(out, features, number)
    if "rolling" in wanted:
        out = statistical.rolling(out, order, features)
    if "iforest" in wanted:
        out = forest.IsolationForest(features).fit(df, number).transform(out)
    if "autoencoder" in wanted:
        out = autoencoder.Autoencoder(features).fit(df).transform(out)
    if "ocsvm" in wanted:
        out = density.OneClassBoundary(features).fit(df).transform(out)
    if "statistical" in wanted:
        out = statistical.z_score(out, statistical.moments(df, features))
    if "frequency" in wanted:
        out = statistical.FrequencyRarity(features).fit(df).transform(out)
    return statistical.ensemble(out, {name: F.col(f"{name}.confidence") for name in wanted}, weights)


def analyse(df: DataFrame, number: str = "event_no", trees: int = 200) -> DataFrame:
    """Single-table analysis: features, forest score scaled to 0..1, flag and threat level."""
    from ..session import durable

    features = local_features(df)
    model = forest.IsolationForest(LOCAL_FEATURES, trees=trees).fit(features, number)
    scored = durable(model.transform(features).select(
        *df.columns, F.col("iforest.raw").alias("_raw"), F.col("iforest.anomaly").alias("is_anomaly")))
    low, high = scored.agg(F.min("_raw"), F.max("_raw")).first()
    score = 1.0 - (F.col("_raw") - F.lit(low)) / F.lit(high - low + 1e-9)
    return with_threat_level(scored.withColumn("anomaly_score", score).drop("_raw"))
