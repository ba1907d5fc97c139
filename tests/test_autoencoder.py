import numpy as np
import pytest

from vigilog.operators.detectors import density
from vigilog.operators.detectors.autoencoder import Autoencoder, Network


def frame_of(spark, x, parts=4):
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)).repartition(parts), names


def errors(df):
    return np.array([r.autoencoder.raw for r in df.orderBy("id").collect()])


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(3)
    network = Network([5, 4, 2, 4, 5])
    x, w = rng.normal(size=(30, 5)), network.start(1)
    w = w + rng.normal(0, 0.05, len(w))  # no unit lies on its bend
    got = network.loss(w, x)
    for i in range(len(w)):
        step = np.zeros_like(w)
        step[i] = 1e-6
        want = (network.loss(w + step, x)[0] - network.loss(w - step, x)[0]) / 2e-6
        assert abs(want - got[1 + i]) < 1e-4 * max(1.0, abs(want))


@pytest.fixture(scope="module")
def curve():
    """Points on a bent line, and some that lie off it but inside the plane of its components."""
    rng = np.random.default_rng(11)
    t = rng.uniform(-1.5, 1.5, 1500)
    x = np.column_stack([t, t**2 - 0.75, np.sin(2 * t), t**3 / 2]) + rng.normal(0, 0.02, (1500, 4))
    x[:15] = np.column_stack([np.zeros(15), np.full(15, 1.4), np.linspace(-0.6, 0.6, 15), np.zeros(15)])
    return x


def test_separates_what_components_cannot(spark, curve):
    df, names = frame_of(spark, curve)
    net = Autoencoder(names, hidden=(16, 1, 16), passes=120).fit(df)
    bent, flat = errors(net.transform(df)), errors(density.ReconstructionError(names, 1).fit(df).transform(df))

    def rank(e):
        """Share of pairs of an outlier and a point of the line in the right order."""
        return np.mean(e[:15, None] > e[None, 15:])

    assert net.losses == sorted(net.losses, reverse=True)
    assert np.median(bent[15:]) < 0.3 * np.median(flat[15:])
    assert rank(bent) > 0.97 > rank(flat)


def test_learning_does_not_depend_on_the_partitions(spark, curve):
    nets = [Autoencoder([f"f{i}" for i in range(4)], (6, 2, 6), passes=8).fit(frame_of(spark, curve[:300], p)[0]) for p in (1, 7)]
    assert np.allclose(nets[0].weights, nets[1].weights, atol=1e-8)


def test_goes_on_from_its_weights_and_stands_empty_tables(spark, curve):
    df, names = frame_of(spark, curve[:300])
    net = Autoencoder(names, (6, 2, 6), passes=6).fit(df)
    first = net.losses[-1]
    net.fit(df)
    assert net.losses[-1] < first
    before = net.weights
    assert np.array_equal(net.fit(df.limit(0)).weights, before) and net.transform(df.limit(0)).count() == 0


def test_nulls_count_as_zero(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 0.0, 2.0), (3, float("nan"), 2.0)], "id long, f0 double, f1 double")
    e = errors(Autoencoder(["f0", "f1"], (3, 1, 3), passes=2).fit(df.where("id < 3")).transform(df))
    assert e[0] == e[1] == e[2]
