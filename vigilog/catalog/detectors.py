"""DET and JON8: anomaly detectors over the batch features."""

from pyspark.sql import functions as F

from ..constants import ENSEMBLE_WEIGHTS
from ..operators.detectors import autoencoder, density, forest, scaling, statistical
from ..operators.features_batch import FEATURES
from ..session import durable
from ..sources.logs import logs, table
from .features import BATCH_CTES, BATCH_SQL, feature_matrix
from .registry import on_logs, query
from .windows import deviation_sql

ORDER = ["ts", "event_no"]
NAMES = list(BATCH_SQL)
_MATRIX = "SELECT doc_id, event_no, ts, row_number() OVER (ORDER BY ts, event_no) AS rn, " + ", ".join(
    f"CAST({sql} AS DOUBLE) AS _ml_{n}" for n, sql in BATCH_SQL.items()) + " FROM raw"


def on_matrix(body: str, **more: str) -> str:
    return on_logs(body, **BATCH_CTES, fm=_MATRIX, **more)


def matrix(spark, sf):
    """The batch features, written once: detectors pass over them several times.

    Scoring is costly per row, so a scan of few splits is written in one part per core.
    """
    df = feature_matrix(spark, sf)
    cores = spark.sparkContext.defaultParallelism
    few = table(spark, sf, "events").rdd.getNumPartitions() < cores
    return durable(df.repartition(cores) if few else df)


def scaled(spark, sf):
    df = matrix(spark, sf)
    return scaling.StandardScaler(FEATURES).fit(df).transform(df)


def unpack(df, name, *columns, digits=6):
    return df.select(*columns, F.round(f"{name}.raw", digits).alias("raw"),
                     F.round(f"{name}.confidence", digits).alias("confidence"), F.col(f"{name}.anomaly").alias("anomaly"))


@query("det1_isolation_forest")
def _(spark, sf):
    df = matrix(spark, sf)
    return unpack(forest.IsolationForest(FEATURES).fit(df, "event_no").transform(df), "iforest", "doc_id")


@query("det2_local_outlier_factor")
def _(spark, sf):
    return unpack(density.outlier_factors(scaled(spark, sf), FEATURES, "event_no"), "lof", "doc_id")


@query("det3_one_class_boundary")
def _(spark, sf):
    df = scaled(spark, sf)
    model = density.OneClassBoundary(FEATURES).fit(df)
    return unpack(model.transform(df), "ocsvm", "doc_id")


@query("det4_reconstruction_error")
def _(spark, sf):
    df = scaled(spark, sf)
    return unpack(autoencoder.Autoencoder(FEATURES).fit(df).transform(df), "autoencoder", "doc_id")


@query("det4_components")
def _(spark, sf):
    df = scaled(spark, sf)
    return unpack(density.ReconstructionError(FEATURES).fit(df).transform(df), "autoencoder", "doc_id")


_Z = ", ".join(
    f"abs((_ml_{n} - (SELECT avg(_ml_{n}) FROM fm)) / ((SELECT stddev_pop(_ml_{n}) FROM fm) + 1e-9))" for n in NAMES)


@query("det5_z_score", on_matrix(
    "SELECT doc_id, round(z, 6) AS raw, round(least(greatest(z / 6, 0e0), 1e0), 6) AS confidence, z > 3 AS anomaly FROM "
    f"(SELECT doc_id, greatest({_Z}) AS z FROM fm)"))
def _(spark, sf):
    df = matrix(spark, sf)
    return unpack(statistical.z_score(df, statistical.moments(df, FEATURES)), "statistical", "doc_id")


@query("det5_merged_moments", (
    "SELECT f AS feature, n, round(m, 6) AS mean, round(v, 5) AS variance FROM (SELECT 'value' AS f, count(*) AS n, avg(value) AS m, "
    "var_pop(value) AS v FROM events UNION ALL SELECT 'user_id', count(*), avg(user_id), var_pop(user_id) FROM events)"))
def _(spark, sf):
    df = table(spark, sf, "events")
    parts = [statistical.moments(df.filter(F.col("event_id") % 3 == i), ["value", "user_id"]) for i in range(3)]
    merged = statistical.merge_moments(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return merged.withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 5)})


def _rarity(n: str) -> str:
    c = f"_ml_{n}"
    return (f"-ln(count(*) OVER (PARTITION BY least(greatest(floor(({c} - lo_{n}) / w_{n}), 0), 49)) / "
            f"(cnt * w_{n}) + 1e-9)")


_BOUNDS = "SELECT CAST(count(*) AS DOUBLE) AS cnt, " + ", ".join(
    f"CASE WHEN min(_ml_{n}) = max(_ml_{n}) THEN min(_ml_{n}) - 0.5e0 ELSE min(_ml_{n}) END AS lo_{n}, "
    f"CASE WHEN min(_ml_{n}) = max(_ml_{n}) THEN 1e0 / 50 ELSE (max(_ml_{n}) - min(_ml_{n})) / 50 END AS w_{n}" for n in NAMES
) + " FROM fm"


@query("det6_frequency_rarity", on_matrix(
    "SELECT doc_id, round(r, 6) AS raw, round(least(greatest(r / 10, 0e0), 1e0), 6) AS confidence, "
    "least(greatest(r / 10, 0e0), 1e0) > 0.8e0 AS anomaly FROM (SELECT doc_id, (" + " + ".join(map(_rarity, NAMES))
    + f") / {float(len(NAMES))}e0 AS r FROM fm, bounds)", bounds=_BOUNDS))
def _(spark, sf):
    df = matrix(spark, sf)
    return unpack(statistical.FrequencyRarity(FEATURES).fit(df).transform(df), "frequency", "doc_id")


@query("det7_rolling", on_matrix(
    "SELECT event_no, round(deviation, 6) AS raw, round(least(greatest(deviation / 5, 0e0), 1e0), 6) AS confidence, "
    "least(greatest(deviation / 5, 0e0), 1e0) > 0.8e0 AS anomaly FROM d", d=deviation_sql([f"_ml_{n}" for n in NAMES], "fm")))
def _(spark, sf):
    return unpack(statistical.rolling(matrix(spark, sf), ORDER, FEATURES), "rolling", "event_no")


_CONFIDENCE = {name: f"CAST(event_no * {p} % 1000 AS DOUBLE) / 999e0" for name, p in zip(
    ENSEMBLE_WEIGHTS, (7919, 6007, 5003, 4001, 3001, 2003, 1009))}
_WEIGHTED = "(" + " + ".join(f"({sql}) * {ENSEMBLE_WEIGHTS[n]}e0" for n, sql in _CONFIDENCE.items()) + ")"


@query("det8_ensemble", on_logs(
    f"SELECT doc_id, round({_WEIGHTED}, 6) AS confidence, {_WEIGHTED} > 0.6e0 AS anomaly, 7 AS explanations FROM logs"))
def _(spark, sf):
    df = statistical.ensemble(logs(spark, sf), {n: F.expr(sql) for n, sql in _CONFIDENCE.items()})
    return df.select("doc_id", F.round("confidence", 6).alias("confidence"), "anomaly",
                     F.size("model_explanations").alias("explanations"))


@query("det8_full_ensemble")
def _(spark, sf):
    from ..plans.detection import ensemble_detection

    out = ensemble_detection(scaled(spark, sf), FEATURES, ORDER, "event_no")
    return out.select("doc_id", F.round("confidence", 6).alias("confidence"), "anomaly")


@query("det9_scaling", on_matrix("SELECT doc_id, " + ", ".join(
    f"round((_ml_{n} - (SELECT avg(_ml_{n}) FROM fm)) / (SELECT stddev_pop(_ml_{n}) FROM fm), 6) AS _ml_{n}" for n in NAMES) + " FROM fm"))
def _(spark, sf):
    return scaled(spark, sf).select("doc_id", *[F.round(f, 6).alias(f) for f in FEATURES])


@query("det9_scaled_forest")
def _(spark, sf):
    df = matrix(spark, sf)
    out = forest.ScaledForest(FEATURES).fit(df, "event_no").transform(df)
    return out.select("doc_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@query("det10_incremental_refit", (
    "SELECT CAST(b AS INTEGER) AS batch, n AS samples, CASE b WHEN 1 THEN 'fit' ELSE 'partial_fit' END AS mode, "
    "CAST(sum(n) OVER (ORDER BY b) AS BIGINT) AS total_seen FROM (SELECT 1 + (ts >= TIMESTAMP '2024-01-11')::INT + "
    "(ts >= TIMESTAMP '2024-01-21')::INT AS b, count(*) AS n FROM events GROUP BY 1)"))
def _(spark, sf):
    df = matrix(spark, sf)
    model = forest.ScaledForest(FEATURES, trees=50)
    # The first and the last batch are open, so that every row is in one.
    cuts = [F.lit(c).cast("timestamp_ntz") for c in ("2024-01-11", "2024-01-21")]
    for batch in (F.col("ts") < cuts[0], (F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1]), F.col("ts") >= cuts[1]):
        model.refit(df.filter(batch), "event_no")
    return spark.createDataFrame([tuple(r.values()) for r in model.log], "batch int, samples long, mode string, total_seen long")


@query("det11_attribution")
def _(spark, sf):
    df = matrix(spark, sf)
    model = forest.IsolationForest(FEATURES, trees=100).fit(df, "event_no")
    top = model.transform(df).orderBy(F.col("iforest.raw"), "event_no").limit(500)
    out = model.attribute(durable(top.select("event_no", *FEATURES)), "event_no")
    return out.withColumn("contribution", F.round("contribution", 6))


@query("jon8_nearest_in_history", (
    "SELECT vec_id, round(d, 4) AS distance FROM (SELECT a.vec_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d, "
    "row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS r FROM embeddings a CROSS JOIN "
    "embeddings b WHERE a.vec_id % 100 = 0) WHERE r = 5"))
def _(spark, sf):
    df = table(spark, sf, "embeddings")
    width = df.agg(F.max(F.size("embedding"))).first()[0]
    features = [f"e{i}" for i in range(width)]
    wide = df.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f) for i, f in enumerate(features)])
    out = density.nearest_of_all(wide.filter("vec_id % 100 = 0"), wide, features, "vec_id", 5, "distance")
    return out.select("vec_id", F.round("distance", 4).alias("distance"))


@query("det1_single_table_analysis")
def _(spark, sf):
    from ..plans.detection import analyse

    out = analyse(logs(spark, sf))
    return out.select("doc_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly", "threat_level")


# --- given models: the same detectors with stated parameters, so that SQL can follow them -------------------
_PAIR = ["value", "user_id"]
# tree, node, feature, threshold, left, right, size, depth
_GIVEN = [
    (0, 0, 0, 20.0, 1, 2, 100, 0), (0, 1, -1, 0.0, -1, -1, 60, 1), (0, 2, 1, 50.0, 3, 4, 40, 1), (0, 3, -1, 0.0, -1, -1, 30, 2),
    (0, 4, -1, 0.0, -1, -1, 10, 2), (1, 0, 1, 30.0, 1, 2, 100, 0), (1, 1, -1, 0.0, -1, -1, 25, 1), (1, 2, -1, 0.0, -1, -1, 75, 1),
]


def given_forest():
    import pandas as pd

    model = forest.IsolationForest(_PAIR, trees=2)
    model.nodes = pd.DataFrame(_GIVEN, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])
    model.per_tree, model.offset = 100, -0.5
    return model


def _mean_path(n: int) -> str:
    return f"(2 * (ln({n - 1}e0) + 0.5772156649015329e0) - 2 * {n - 1}e0 / {n}e0)"


def _leaf(size: int, depth: int) -> str:
    return f"{depth} + {_mean_path(size)}"


_LENGTH = (
    f"((CASE WHEN value <= 20 THEN {_leaf(60, 1)} WHEN user_id <= 50 THEN {_leaf(30, 2)} ELSE {_leaf(10, 2)} END) + "
    f"(CASE WHEN user_id <= 30 THEN {_leaf(25, 1)} ELSE {_leaf(75, 1)} END)) / 2")
_SCORE = f"(-pow(2e0, -({_LENGTH}) / {_mean_path(100)}))"


@query("det1_given_forest", (
    f"SELECT event_id, round({_SCORE}, 6) AS raw, round(-{_SCORE}, 6) AS confidence, {_SCORE} < -0.5e0 AS anomaly FROM events"))
def _(spark, sf):
    return unpack(given_forest().transform(table(spark, sf, "events")), "iforest", "event_id")


@query("det11_given_forest_sums", f"SELECT event_id, round({_LENGTH}, 6) AS path_length FROM events")
def _(spark, sf):
    """Contributions and the base value add up to a row's mean path length."""
    model = given_forest()
    parts = model.attribute(table(spark, sf, "events").select("event_id", *_PAIR), "event_id").groupBy("event_id").agg(F.sum("contribution").alias("total"))
    return parts.select("event_id", F.round(F.col("total") + model.base_value(), 6).alias("path_length"))


@query("det4_given_basis", (
    "SELECT event_id, round(e, 6) AS raw, round(1 - exp(-0.5e0 * e), 6) AS confidence, 1 - exp(-0.5e0 * e) > 0.8e0 AS anomaly FROM ("
    "SELECT event_id, (pow(a - 0.6e0 * p, 2) + pow(b - 0.8e0 * p, 2)) / 2 AS e FROM (SELECT event_id, a, b, 0.6e0 * a + 0.8e0 * b AS p FROM "
    "(SELECT event_id, value / 100 - 0.25e0 AS a, user_id / 100e0 - 0.5e0 AS b FROM events)))"))
def _(spark, sf):
    import numpy as np

    model = density.ReconstructionError(["a", "b"], bottleneck=1)
    model.mean, model.components = np.array([0.25, 0.5]), np.array([[0.6], [0.8]])
    df = table(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("a"), (F.col("user_id") / 100).alias("b"))
    return unpack(model.transform(df), "autoencoder", "event_id")


# A network 2-3-2-2 by layers: for each unit its weights and its bias.
_NET = [
    [((0.8, -0.5), 0.1), ((-0.4, 0.9), 0.2), ((0.3, 0.6), -0.1)], [((0.7, -0.2, 0.5), 0.05), ((-0.3, 0.8, 0.4), -0.2)],
    [((1.1, -0.6), 0.02), ((-0.2, 0.9), 0.3)],
]


def _net_sql() -> str:
    """One sub-select a layer over the features a and b."""
    sql, before = "SELECT event_id, value / 100 AS x0, user_id / 100e0 AS x1 FROM events", ["x0", "x1"]
    for i, layer in enumerate(_NET):
        sums = [" + ".join(f"{w}e0 * {x}" for w, x in zip(ws, before)) + f" + {bias}e0" for ws, bias in layer]
        after = [f"y{i}_{j}" for j in range(len(layer))]
        values = ", ".join(f"{s} AS {n}" if i == len(_NET) - 1 else f"greatest({s}, 0e0) AS {n}" for s, n in zip(sums, after))
        sql, before = f"SELECT event_id, x0, x1, {values} FROM ({sql})", after
    return f"SELECT event_id, (pow({before[0]} - x0, 2) + pow({before[1]} - x1, 2)) / 2 AS e FROM ({sql})"


def given_network():
    import numpy as np

    model = autoencoder.Autoencoder(["a", "b"], hidden=(3, 2))
    model.weights = np.concatenate([np.append(np.array([ws for ws, _ in layer]).T.ravel(), [bias for _, bias in layer]) for layer in _NET])
    return model


@query("det4_given_network", (
    "SELECT event_id, round(e, 6) AS raw, round(1 - exp(-0.5e0 * e), 6) AS confidence, 1 - exp(-0.5e0 * e) > 0.8e0 AS anomaly FROM ("
    + _net_sql() + ")"))
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("a"), (F.col("user_id") / 100).alias("b"))
    return unpack(given_network().transform(df), "autoencoder", "event_id")


@query("det2_given_history", (
    "WITH e AS (SELECT event_id AS i, value, user_id + event_id / 10000e0 AS place FROM events), "
    "n AS (SELECT i, unnest(near) AS p FROM (SELECT a.i, min_by({'j': b.i, 'd': sqrt(pow(a.value - b.value, 2) + pow(a.place - b.place, 2))}, "
    "sqrt(pow(a.value - b.value, 2) + pow(a.place - b.place, 2)), 5) AS near FROM e a JOIN e b ON a.i <> b.i GROUP BY a.i)), "
    "k AS (SELECT i, p.j AS j, p.d AS d FROM n), reach AS (SELECT i, max(d) AS kd FROM k GROUP BY i), "
    "dens AS (SELECT k.i, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM k JOIN reach ON reach.i = k.j GROUP BY k.i) "
    "SELECT k.i AS event_id, round(-avg(o.lrd) / any_value(s.lrd), 4) AS raw FROM k JOIN dens o ON o.i = k.j JOIN dens s ON s.i = k.i GROUP BY k.i"))
def _(spark, sf):
    """Factors of all events against all events."""
    # The second feature has a part of the number, so that no two distances are equal.
    df = table(spark, sf, "events").select("event_id", "value", (F.col("user_id") + F.col("event_id") / 10000).alias("place"))
    out = density.outlier_factors(df, ["value", "place"], "event_id", 5)
    return unpack(out, "lof", "event_id", digits=4).select("event_id", "raw")


_DECISION = "(5 * (0.6e0 * cos(0.01e0 * value + 0.02e0 * user_id + 0.5e0) + 0.4e0 * cos(0.03e0 * value - 0.01e0 * user_id + 1) - 0.1e0))"


def given_boundary():
    import numpy as np

    model = density.OneClassBoundary(_PAIR, width=2)
    model.directions, model.phases = np.array([[0.01, 0.03], [0.02, -0.01]]), np.array([0.5, 1.0])
    model.w, model.rho, model.scale = np.array([0.6, 0.4]), 0.1, 5.0
    return model


@query("det3_given_boundary", (
    f"SELECT event_id, round({_DECISION}, 6) AS raw, round(least(greatest(0.5e0 - {_DECISION} / 10, 0e0), 1e0), 6) AS confidence, "
    f"{_DECISION} < 0 AS anomaly FROM events"))
def _(spark, sf):
    return unpack(given_boundary().transform(table(spark, sf, "events")), "ocsvm", "event_id")


_SCALED_SCORE = _SCORE.replace("value <=", "v <=").replace("user_id <=", "u <=").replace("20 THEN", "0.25e0 THEN").replace("u <= 50", "u <= 0.5e0").replace("u <= 30", "u <= -0.25e0")


@query("det9_given_scaled_forest", (
    "WITH m AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(user_id) AS mu, stddev_pop(user_id) AS su FROM events), "
    f"r AS (SELECT event_id, {_SCALED_SCORE} AS raw FROM (SELECT event_id, (value - mv) / sv AS v, (user_id - mu) / su AS u FROM events, m)) "
    "SELECT event_id, round(raw, 6) AS anomaly_score_raw, round(1 - (raw - (SELECT min(raw) FROM r)) / ((SELECT max(raw) FROM r) - (SELECT min(raw) FROM r) + 1e-9), 6) "
    "AS anomaly_score, raw < -0.5e0 AS is_anomaly FROM r"))
def _(spark, sf):
    """The scaler learned from the events, a stated forest over the scaled values, scores from 0 to 1."""
    df = table(spark, sf, "events")
    model = forest.ScaledForest(_PAIR)
    model.scaler.fit(df)
    model.forest = given_forest()
    cuts = {20.0: 0.25, 50.0: 0.5, 30.0: -0.25}
    model.forest.nodes = model.forest.nodes.assign(threshold=[cuts.get(t, t) for t in model.forest.nodes["threshold"]])
    return model.transform(df).select("event_id", *[F.round(c, 6).alias(c) for c in ("anomaly_score_raw", "anomaly_score")], "is_anomaly")


_MODELS = {
    "iforest": f"least(greatest(-{_SCORE}, 0e0), 1e0)", "ocsvm": f"least(greatest(0.5e0 - {_DECISION} / 10, 0e0), 1e0)",
    "autoencoder": "1 - exp(-0.5e0 * e)", "statistical": "least(greatest(z / 6, 0e0), 1e0)",
}
_ALL = "(" + " + ".join(f"({sql}) * {ENSEMBLE_WEIGHTS[n]}e0" for n, sql in _MODELS.items()) + f") / {sum(ENSEMBLE_WEIGHTS[n] for n in _MODELS)}e0"


@query("det8_given_ensemble", (
    "WITH m AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(user_id) AS mu, stddev_pop(user_id) AS su FROM events), "
    f"n AS ({_net_sql()}) SELECT event_id, round({_ALL}, 6) AS confidence, {_ALL} > 0.6e0 AS anomaly, 4 AS explanations FROM (SELECT events.*, e, "
    "greatest(abs((value - mv) / (sv + 1e-9)), abs((user_id - mu) / (su + 1e-9))) AS z FROM events JOIN n USING (event_id), m)"))
def _(spark, sf):
    """Four stated models run over the events, and their weighted verdict."""
    df = table(spark, sf, "events").select("event_id", *_PAIR, (F.col("value") / 100).alias("a"), (F.col("user_id") / 100).alias("b"))
    out = given_network().transform(given_boundary().transform(given_forest().transform(df)))
    out = statistical.z_score(out, statistical.moments(df, _PAIR))
    out = statistical.ensemble(out, {n: F.col(f"{n}.confidence") for n in _MODELS})
    return out.select("event_id", F.round("confidence", 6).alias("confidence"), "anomaly", F.size("model_explanations").alias("explanations"))
