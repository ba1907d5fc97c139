import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilog.operators.detectors import common, density, forest, statistical

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 3))
    x[:12] += 15.0 * rng.choice([-1, 1], size=(12, 3))
    return x


@pytest.fixture(scope="module")
def frame(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, a double, b double, c double").persist()


def by_id(df, name, part="raw"):
    return np.array([r[0] for r in df.orderBy("id").select(f"{name}.{part}").collect()])


def test_forest_finds_outliers_whatever_the_partitions(frame):
    one = forest.IsolationForest(NAMES).fit(frame.coalesce(1), "id").transform(frame)
    many = forest.IsolationForest(NAMES).fit(frame.repartition(7), "id").transform(frame.repartition(5))
    first, second = by_id(one, "iforest"), by_id(many, "iforest")
    assert np.array_equal(first, second)
    assert set(np.argsort(first)[:12]) == set(range(12))
    assert ((-first > 0) & (-first <= 1)).all()
    assert abs(by_id(one, "iforest", "anomaly").mean() - 0.05) < 0.01


def test_forest_sample_stays_bounded(frame):
    assert common.bounded_sample(frame, "id", 100).count() == 100
    a = {r.id for r in common.bounded_sample(frame, "id", 100).collect()}
    assert a == {r.id for r in common.bounded_sample(frame.repartition(9), "id", 100).collect()}


def test_attribution_adds_up(spark, frame):
    model = forest.IsolationForest(NAMES, trees=20).fit(frame, "id")
    top = model.transform(frame).orderBy("iforest.raw").limit(30)
    parts = model.attribute(top.select("id", *NAMES), "id")
    total = {r.id: r.s for r in parts.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    scale = float(forest.mean_path(model.per_tree))
    for r in top.collect():
        length = -np.log2(-r.iforest.raw) * scale
        assert abs(model.base_value() + total[r.id] - length) < 1e-8


def slow_factors(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    far = np.take_along_axis(d, near, 1)
    density_ = 1 / (np.maximum(far, far[:, -1][near]).mean(1) + 1e-10)
    return density_[near].mean(1) / density_


def test_outlier_factors_equal_brute_force(frame, points):
    got = -by_id(density.outlier_factors(frame, NAMES, "id", 20), "lof")
    assert np.allclose(got, slow_factors(points, 20), rtol=1e-6)


def test_outlier_factors_of_few_rows(frame):
    for rows in (0, 1, 20):
        out = density.outlier_factors(frame.where(F.col("id") < rows), NAMES, "id", 20)
        assert by_id(out, "lof").tolist() == [0.0] * rows and not by_id(out, "lof", "anomaly").any()


def test_attribution_of_a_whole_table_stays_with_the_rows(spark, frame):
    model = forest.IsolationForest(NAMES, trees=5).fit(frame, "id")
    parts = model.attribute(frame.repartition(6), "id")
    assert parts.count() == frame.count() * len(NAMES)
    total = {r.id: r.s for r in parts.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    scale = float(forest.mean_path(model.per_tree))
    for r in model.transform(frame).collect():
        assert abs(model.base_value() + total[r.id] + np.log2(-r.iforest.raw) * scale) < 1e-8


def test_boundary_leaves_about_nu_outside(frame):
    out = density.OneClassBoundary(NAMES, nu=0.05).fit(frame).transform(frame)
    flags = by_id(out, "ocsvm", "anomaly")
    assert 0.02 < flags.mean() < 0.09 and flags[:12].mean() > 0.9


def slow_boundary(model, x, nu=0.05):
    """The same steps over all rows at once, with a second look for the rows outside."""
    z = model._map(x)
    w = z.mean(axis=0)
    best, best_loss = None, np.inf
    for step in range(model.steps):
        edges = density._edges(w)
        below = np.cumsum(np.histogram(z @ w, bins=edges)[0])
        rho = edges[min(int(np.searchsorted(below, nu * len(z))) + 1, len(edges) - 1)]
        outside = z @ w < rho
        loss = 0.5 * w @ w - rho + (rho - z[outside] @ w).sum() / (nu * len(z))
        if loss < best_loss:
            best, best_loss = (w, rho), loss
        w = w + (z[outside].sum(axis=0) / (nu * len(z)) - w) / (step + 2.0)
    return best


def test_boundary_takes_one_pass_a_step_whatever_the_guess(frame, points, monkeypatch):
    passes, whole, guess = [], density.OneClassBoundary._by_bin, density._guess
    monkeypatch.setattr(density.OneClassBoundary, "_by_bin", lambda self, *a: passes.append(a) or whole(self, *a))
    for wrong, most in ((False, 41), (True, 81)):
        monkeypatch.setattr(density, "_guess", (lambda *a: (1, 1)) if wrong else guess)
        model = density.OneClassBoundary(NAMES).fit(frame.repartition(5))
        assert 41 <= len(passes) <= most
        w, rho = slow_boundary(model, points)
        assert np.allclose(model.w, w, atol=1e-12) and model.rho == pytest.approx(rho, abs=1e-12)
        passes.clear()


def test_reconstruction_error(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 2))
    x = np.column_stack([base, base.sum(1), base[:, 0] - base[:, 1]])
    x[0] += [0, 0, 8, 0]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, a double, b double, c double, d double")
    raw = by_id(density.ReconstructionError(["a", "b", "c", "d"], 2).fit(df).transform(df), "autoencoder")
    assert raw.argmax() == 0 and np.median(raw) < 0.01


def test_moments_merge(spark, frame, points):
    parts = [statistical.moments(frame.filter(F.col("id") % 3 == i), NAMES) for i in range(3)]
    merged = statistical.merge_moments(parts[0].unionByName(parts[1]).unionByName(parts[2])).orderBy("feature").collect()
    assert np.allclose([r["mean"] for r in merged], points.mean(0)) and np.allclose([r["variance"] for r in merged], points.var(0))


def test_frequency_rarity_against_numpy(spark, frame, points):
    got = by_id(statistical.FrequencyRarity(NAMES).fit(frame).transform(frame), "frequency")
    parts = []
    for column in points.T:
        counts, edges = np.histogram(column, bins=50, density=True)
        parts.append(-np.log(counts[np.clip(np.digitize(column, edges) - 1, 0, 49)] + 1e-9))
    assert np.mean(np.abs(got - np.mean(parts, axis=0)) < 1e-6) > 0.99


def test_ensemble_renormalises(spark):
    df = spark.createDataFrame([(0.9, 0.5)], "p double, q double")
    row = statistical.ensemble(df, {"iforest": F.col("p"), "lof": F.col("q")}, {"iforest": 0.5, "lof": 0.0}).first()
    assert abs(row.confidence - 0.9) < 1e-12 and row.anomaly and len(row.model_explanations) == 1


def test_scaled_forest_keeps_columns_and_range(frame):
    model = forest.ScaledForest(NAMES).fit(frame, "id")
    out = model.transform(frame)
    scores = np.array([r.anomaly_score for r in out.collect()])
    assert abs(scores.max() - 1.0) < 1e-6 and abs(scores.min()) < 1e-6
    assert set(frame.columns) <= set(out.columns)
    with pytest.raises(ValueError):
        forest.ScaledForest(NAMES).fit(frame.limit(5), "id")


def test_outlier_factors_see_the_oldest_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3_000, 3))
    x[0] = [9.0, -9.0, 9.0]
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    near = {r.id: [n["_id"] for n in r.near] for r in density.neighbours_by_cells(frame, ["a", "b", "c"], "id", 10).collect()}
    some = range(0, 3_000, 100)
    _, exact = density.nearest(x[list(some)], x, 10, skip=np.array(list(some)))
    assert [near[i] for i in some] == exact.tolist()
    out = {r.id: r.lof.raw for r in density.outlier_factors(frame, ["a", "b", "c"], "id", 10).collect()}
    assert len(out) == 3_000 and min(out, key=out.get) == 0


def test_neighbours_of_many_features_are_exact_beyond_a_cell(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(6_000, 19)) * rng.uniform(0.1, 2.0, 19), 1)
    x[:60] = x[0]  # more equal rows than neighbours
    names = [f"f{i}" for i in range(19)]
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{f} double" for f in names))
    near = {r.id: r.near for r in density.neighbours_by_cells(frame, names, "id", 20, cell=300).collect()}
    some = np.arange(0, 6_000, 50)
    exact, _ = density.nearest(x[some], x, 20, skip=some)
    assert len(near) == 6_000
    for i, d in zip(some, exact):
        assert np.allclose([n["_d"] for n in near[i]], d) and i not in {n["_id"] for n in near[i]}
        assert len({n["_id"] for n in near[i]}) == 20


def test_boxes_find_the_nearest_of_all_rows():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(5_000, 6)) * [1, 1, 3, 0.2, 1, 0], 1)
    x[:300] = x[0]
    x[-1] = 1e4
    boxes = density.Boxes(x)
    assert sorted(boxes.order.tolist()) == list(range(len(x))) and boxes.sizes.max() == 300
    own, _ = density.nearest(x, x, 20, skip=np.arange(len(x)))
    d, p = boxes.nearest(boxes.x, 20, np.full(len(x), np.inf), skip=np.arange(len(x)))
    assert np.allclose(d, own[boxes.order], atol=1e-9) and not (p == boxes.order[:, None]).any()
    assert np.allclose(np.sqrt(((x[p] - boxes.x[:, None]) ** 2).sum(axis=2)), d) and all(len(set(r)) == 20 for r in p.tolist())
    # Under a bound only what is nearer comes back.
    q, bound = rng.normal(size=(70, 6)), rng.uniform(0.5, 2.0, 70)
    d, p = boxes.nearest(q, 20, bound)
    for i, b in enumerate(bound):
        want = np.sort(np.sqrt(((x - q[i]) ** 2).sum(axis=1)))
        assert np.allclose(d[i][p[i] >= 0], want[want < b][:20], atol=1e-9) and (p[i] >= 0).sum() == min(20, (want < b).sum())


def test_large_leaves_are_searched_in_shares(spark, monkeypatch):
    monkeypatch.setattr(density, "_LEAF_ROWS", 300)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_000, 3))
    x[:1_200] = x[0]
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    cells = density.Cells(frame, NAMES, "id", 100)
    assert cells.shards.count() > cells.shards.select("_leaf").distinct().count() >= 10
    near = {r.id: r.near for r in density.neighbours_by_cells(frame, NAMES, "id", 10, cell=100).collect()}
    exact, _ = density.nearest(x, x, 10, skip=np.arange(len(x)))
    assert len(near) == len(x)
    for i, d in enumerate(exact):
        assert np.allclose([n["_d"] for n in near[i]], d, atol=1e-9) and len({n["_id"] for n in near[i]} - {i}) == 10


def test_asked_cells_do_not_grow_with_the_table(spark):
    """Two levels of cells; each row asks about as many other cells in a table ten times as large."""
    shares = []
    for rows in (4_000, 40_000):
        x = F.struct(*[F.randn(seed=i).alias(n) for i, n in enumerate(NAMES)])
        frame = spark.range(rows).select("id", x.alias("x")).select("id", "x.*")
        cells = density.Cells(frame, NAMES, "id", 200)
        assert cells.boxes.select("_leaf").distinct().count() <= 16 and cells.boxes.count() >= rows // 400
        assert cells.placed.groupBy("_cell").count().agg(F.max("count")).first()[0] < 600
        shares.append(cells.asked(density.inside_cells(cells, 5).drop("near")).count() / rows)
    assert 0 < shares[1] < 1.3 * shares[0]


def test_nearest_of_all_is_exact_in_blocks(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 4))
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double").repartition(5)
    got = {r.id: r.far for r in density.nearest_of_all(frame.filter("id % 10 = 0"), frame, ["a", "b", "c", "d"], "id", 5, "far", block=30).collect()}
    for i in range(0, 700, 10):
        assert abs(np.sort(np.linalg.norm(x - x[i], axis=1))[4] - got[i]) < 1e-9
    assert len(got) == 70


def test_ensemble_takes_neighbours_from_the_stored_rows(spark, frame, monkeypatch):
    """Not from rows to which other detectors' results are added, which each reading would work out again."""
    from vigilog.plans import detection

    given, whole = [], density.outlier_factors
    monkeypatch.setattr(density, "outlier_factors", lambda df, *a: given.append(df.columns) or whole(df, *a))
    weights = {"rolling": 0.2, "statistical": 0.3, "lof": 0.5}
    out = detection.ensemble_detection(frame, NAMES, ["id"], "id", weights)
    assert given == [frame.columns]
    for r in out.select("confidence", "rolling", "statistical", "lof").collect():
        assert r.confidence == pytest.approx(sum(w * r[n].confidence for n, w in weights.items()))
