"""Training by summed gradients: finite differences, resumed runs, aligned samples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import training
from tessella.operators.trees import Store

FEATURES = ("x", "y")
POINTS, TERMS = ((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 2.0, 0.0)), (("nu_tes",), ("nu_jes",))


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), float(w), int(i % 4) if i % 13 else -1) for i, (a, b, w) in enumerate(zip(rng.normal(2, 1, 200), rng.normal(-1, 2, 200), rng.uniform(0.5, 2, 200), strict=True))]
    return rows, spark.createDataFrame(rows, "id int, x double, y double, weight double, label int").repartition(3)


def differences(value, vector, step=1e-6):
    out = np.zeros_like(vector)
    for i in range(len(vector)):
        up, down = vector.copy(), vector.copy()
        up[i] += step
        down[i] -= step
        out[i] = (value(up) - value(down)) / (2 * step)
    return out


def test_class_gradient(spark, events):
    rows, df = events
    net = training.random_network(FEATURES, (5, 3), 4, mean=(2.0, 0.0), variance=(1.5, 0.0), seed=4)
    weights = (1.0, 2.0, 0.5, 3.0)
    kept = [r for r in rows if r[4] >= 0]

    def value(vector):
        p = training.with_parameters(net, vector).run(np.array([r[1:3] for r in kept]))
        return float(np.mean([-r[3] * weights[r[4]] * math.log(q[r[4]]) for r, q in zip(kept, p, strict=True)]))

    loss, gradient = training.gradient_of(df, net, training.ClassLoss(4, weights))
    assert loss == pytest.approx(value(training.flat(net)))
    assert gradient == pytest.approx(differences(value, training.flat(net)), abs=1e-7)


def test_ratio_gradient_over_aligned_samples(spark, events):
    """Samples of 90, 70 and 75 rows: 70 of each count, in batches of 32, whatever the partitioning."""
    rows, df = events
    sizes = (90, 70, 75)
    samples = [df.where((F.col("id") >= 30 * k) & (F.col("id") < 30 * k + n)).repartition(k + 1) for k, n in enumerate(sizes)]
    table = training.aligned(samples, FEATURES, ("id",), 32)
    packed = {r.batch: list(r.sizes) for r in table.collect()}
    assert packed == {0: [32] * 3, 1: [32] * 3, 2: [6] * 3}
    net = training.random_network(FEATURES, (4,), 2, "linear", seed=2)
    bias, v = (1.0, 1.3, 0.8), np.array([[0, 0], [1, 0], [0, 2]])
    parts = [[r for r in rows if 30 * k <= r[0] < 30 * k + 70] for k in range(3)]

    def value(vector):
        run, out = training.with_parameters(net, vector), 0.0
        deltas = [run.run(np.array([r[1:3] for r in p])) for p in parts]
        for k in (1, 2):
            out += sum(r[3] * (math.log1p(math.exp(d @ v[k])) - math.log(2)) for r, d in zip(parts[0], deltas[0], strict=True))
            out += sum(r[3] * (math.log1p(math.exp(-d @ v[k])) / bias[k] - math.log(2)) for r, d in zip(parts[k], deltas[k], strict=True))
        return out

    loss, gradient = training.gradient_of(table, net, training.RatioLoss(POINTS, TERMS, bias), mean=False)
    assert loss == pytest.approx(value(training.flat(net)))
    assert gradient == pytest.approx(differences(value, training.flat(net)), abs=1e-5)


def test_loss_falls_and_runs_go_on(spark, events, tmp_path):
    _, df = events
    net = training.random_network(FEATURES, (6,), 4, mean=(2.0, -1.0), variance=(1.0, 4.0))
    loss = training.ClassLoss(4)
    whole, losses = training.train(df, net, loss, 6, training.Adam(0.05), phase_out=2)
    assert losses == sorted(losses, reverse=True)
    store = Store(spark, str(tmp_path))
    training.train(df, net, loss, 6, training.Adam(0.05), store, 2)
    files, seen = store._at("epoch-4")[1], []
    for k in (4, 5):
        files.delete(store._at(f"epoch-{k}")[0], True)
    again, more = training.train(df, net, loss, 6, training.Adam(0.05), store, 2, watch=lambda e, _: seen.append(e))
    assert seen == [4, 5] and more == pytest.approx(losses) and training.flat(again) == pytest.approx(training.flat(whole))


def test_rates_and_adam():
    assert [training.rate_at(e, 1.0, 10, 4) for e in (0, 6, 8, 9)] == [1.0, 1.0, 0.5, 0.25] and training.rate_at(9, 0.5, 10, 0) == 0.5
    adam = training.Adam(0.1)
    assert adam.move(np.array([1.0, 2.0]), np.array([3.0, 0.0])) == pytest.approx([0.9, 2.0], abs=1e-6)


def test_empty_samples(spark, events):
    _, df = events
    table = training.aligned([df, df.where("false")], FEATURES, ("id",))
    assert table.count() == 0
    net = training.random_network(FEATURES, (2,), 1, "linear")
    assert training.gradient_of(table, net, training.RatioLoss(POINTS[:2], TERMS[:1]))[0] == 0.0
