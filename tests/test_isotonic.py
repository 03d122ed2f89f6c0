"""Isotonic regression by ranges against its minimax definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import isotonic


def minimax(x, y, w):
    """The value at each distinct score: the largest over starts of the smallest mean to an end."""
    xs = sorted(set(x))
    sums = np.array([[sum(b for a, b in zip(x, w, strict=True) if a == v), sum(b * c for a, b, c in zip(x, w, y, strict=True) if a == v)] for v in xs])
    total = np.vstack([[0, 0], np.cumsum(sums, axis=0)])
    mean = lambda i, j: (total[j + 1, 1] - total[i, 1]) / (total[j + 1, 0] - total[i, 0])
    n = len(xs)
    return xs, [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, 260)
    y = (rng.uniform(0, 1, 260) < x**2).astype(float)
    w = rng.uniform(0.2, 2, 260)
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w, strict=True))]
    return rows, spark.createDataFrame([*rows, (900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0), (902, 0.5, 1.0, 0.0)], "id int, x double, y double, weight double").repartition(6)


@pytest.mark.parametrize("few", [True, False])
def test_curve_is_the_regression(spark, data, few, monkeypatch):
    rows, df = data
    if not few:
        monkeypatch.setattr(isotonic, "BROADCAST_BLOCKS", 0)
    curve = isotonic.fit(df, "x", F.col("y"))
    got = {r.id: r.calibrated for r in isotonic.calibrate(df, curve, "x").collect()}
    xs, ys = minimax(*zip(*((r[1], r[2], r[3]) for r in rows), strict=True))
    at = dict(zip(xs, ys, strict=True))
    for i, x, _, _ in rows:
        assert got[i] == pytest.approx(min(max(at[x], 1e-6), 1 - 1e-6), abs=1e-9)
    assert got[900] is None and got[901] is None and 0 < got[902] < 1
    beyond = spark.createDataFrame([(1, -5.0), (2, 5.0)], "id int, x double")
    assert [r.calibrated for r in isotonic.calibrate(beyond, curve, "x").orderBy("id").collect()] == pytest.approx([min(max(v, 1e-6), 1 - 1e-6) for v in (ys[0], ys[-1])])


def test_falling_targets_are_one_block(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("x"), (1 - F.col("id") / 200).alias("y"), F.lit(1.0).alias("weight")).repartition(5)
    assert isotonic.fit(df, "x", F.col("y")).count() == 1
    assert isotonic.fit(df, "x", 1 - F.col("y")).count() == 200  # rising ones stay apart, in one round
    with pytest.raises(ValueError):
        isotonic.calibrate(df, isotonic.fit(df.where("false"), "x", F.col("y")), "x")
