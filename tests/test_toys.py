"""Fits in step, and toys fitted together, against each alone."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import alike, cubes, likelihood, toys
from tessella.plans import fit
from tessella.plans import queries_likelihood as Q

SF = "/root/testdata/sf0.001"
NAMES = ("mu", "nu_bkg", "nu_tt")
CURVES = np.array([[30.0, 4.0, 1.0], [4.0, 3.0, 0.5], [1.0, 0.5, 2.0]])


class Counted:
    """A known function with one bowl a toy, which counts its calls."""

    def __init__(self, centres):
        self.centres, self.calls = centres, 0

    def __call__(self, points):
        self.calls += 1
        out = []
        for p in points:
            d = np.array([p[n] for n in NAMES]) - self.centres[int(p.get("toy", 0))]
            out.append(float(d @ CURVES @ d + 0.1 * d[1] ** 4))
        return np.array(out)


START = {"mu": 1.0, "nu_bkg": 0.0, "nu_tt": 0.0}


def test_problems_in_step_are_those_alone():
    centres = [np.array([0.5 + 0.3 * k, 0.2 * k, -0.3]) for k in range(6)]
    f = Counted(centres)
    found, calls = fit.in_step(f, [fit.toy_steps(START, {"toy": t}) for t in range(6)])
    assert f.calls == calls
    alone = []
    for t in range(6):
        g = Counted(centres)
        (best, interval), n = (lambda r: (r[0][0], r[1]))(fit.in_step(g, [fit.toy_steps(START, {"toy": t})]))
        assert found[t][0].values == best.values and found[t][1] == interval
        assert [best.values[n] for n in NAMES] == pytest.approx(list(centres[t]), abs=1e-3)
        alone.append(n)
    assert calls == max(alone) < sum(alone)


def test_profile_and_impacts_take_few_calls():
    f = Counted([np.array([1.2, 0.3, -0.2])])
    best = fit.global_fit(f, START)
    f.calls = 0
    scan = fit.profile_scan(f, best, fit.scan_points(0.9, 1.5, 21))
    assert f.calls <= 15
    for m, q in scan:  # minimised over the others by brute force
        rest = min(Counted(f.centres)([{"mu": m, "nu_bkg": b, "nu_tt": t}])[0] for b in np.linspace(-1, 1.5, 101) for t in np.linspace(-1, 1, 41))
        assert best.q + q <= rest + 1e-6 and best.q + q == pytest.approx(rest, abs=5e-3)
    one, n = fit.impacts_of(f, best, ["nu_bkg"])
    both, m = fit.impacts_of(f, best, ["nu_bkg", "nu_tt"])
    assert one["nu_bkg"] == pytest.approx(both["nu_bkg"]) and m < 2 * n
    low, high = fit.minos(f, best)
    assert low < best.values["mu"] < high
    for at in (low, high):
        assert fit.profile_scan(f, best, [at])[0][1] == pytest.approx(1.0, abs=2e-3)


@pytest.fixture(scope="module")
def parts(spark):
    rows = Q.in_regions(spark, SF).cache()
    small = tuple(np.linspace(-10.0, 10.0, 7).tolist())
    table = cubes.cube_table(rows, Q.LOG_YIELDS, (small, small, tuple(np.linspace(0.0, 5.0, 7).tolist())))
    found = cubes.Cubes.of(table, (small, small, tuple(np.linspace(0.0, 5.0, 7).tolist())))
    return rows, found


def test_a_toy_is_a_weighted_table(spark, parts):
    """What ToyLikelihood gives for a toy is what Likelihood gives for the table of that toy's events."""
    rows, found = parts
    truths = [toys.Truth(0.5), toys.Truth(2.0, nu_diboson=1.0), toys.Truth(1.0, nu_tt=-1.0)]
    scored = Q.scored(spark, SF)
    objective = toys.ToyLikelihood(rows, truths, ["event_id"], Q.LOG_YIELDS, found, scored)
    points = [{**Q.POINT, "mu": m, "toy": t} for t in (2, 0) for m in (0.7, 1.4)]
    drawn = toys.draw_toys(rows, truths, ["event_id"]).cache()
    counted = toys.draw_toys(likelihood.poisson_rows(scored), truths, ["event_id"])
    got = objective(points)
    for p, value in zip(points, got, strict=True):
        k = int(p["toy"])
        sums = [F.sum(F.when(F.col("label") == i, F.col("weight")).otherwise(0.0)).alias(f"s_{c}") for i, c in enumerate(Q.PROCESSES)]
        poisson = counted.groupBy("region").agg(*sums, F.sum(F.col("toys")[k]).cast("double").alias("observed"))
        one = likelihood.Likelihood(drawn.withColumn("weight", F.col("toys")[k].cast("double")), None, Q.LOG_YIELDS, poisson, cubes=found)
        assert value == pytest.approx(one([p])[0], rel=1e-9)
    n = {k: drawn.agg(F.sum(F.when(F.col("label") == 0, F.col("toys")[k]))).first()[0] for k in range(2)}
    expected = rows.where("label = 0").agg(F.sum("weight")).first()[0]
    assert n[0] == pytest.approx(0.5 * expected, rel=0.25) and n[1] == pytest.approx(2 * expected, rel=0.15)


def test_ratios_that_are_not_positive_show(spark, parts):
    rows, found = parts
    objective = toys.ToyLikelihood(rows, [toys.Truth()], ["event_id"], Q.LOG_YIELDS, found)
    assert np.isnan(objective.log_terms([{"mu": -50.0, "toy": 0}])[0]) and np.isfinite(objective.log_terms([{"mu": 1.0, "toy": 0}])[0])


def test_total_of_cubes_is_the_sum_of_regions(parts):
    _, found = parts
    points = [{**Q.POINT, "nu_tes": t} for t in (-2.0, 0.3, 4.0)]
    assert found.totals(points) == pytest.approx([sum(found.shift(r, p) for r in found.regions) for p in points])
    with pytest.raises(ValueError):
        found.totals([{"nu_tes": 11.0}])


def test_calibration_takes_residuals_away():
    fits = [{"mu_true": m, "mu": 0.9 * m + 0.05, "nu_jes": 0.1 * m, "nu_tes": 0.0, "nu_met": 0.2} for m in (0.1, 0.5, 1.0, 2.0, 3.0)]
    correction = toys.calibration(fits)
    from tessella.operators.spline import calibrated_mu

    assert calibrated_mu(correction, 0.9 * 1.5 + 0.05, 0.15, 0.0, 0.2) == pytest.approx(1.5, abs=0.02)


def test_a_fit_goes_on_however_large_the_sample():
    """A bowl as steep as that of very many events: the first steps must not all go too far."""
    centre = np.array([1.2, 0.3, -0.2])
    for size in (1.0, 1e4, 1e7):

        def bowl(points, size=size):
            d = np.array([[p[n] for n in NAMES] for p in points]) - centre
            return size * np.einsum("ij,jk,ik->i", d, CURVES, d)

        found, calls = fit.in_step(bowl, [fit.minimise_steps(START, {}, tolerance=1e-3)])
        assert [found[0].values[n] for n in NAMES] == pytest.approx(centre.tolist(), abs=2e-2 / size**0.5 + 1e-6) and calls < 40


def test_events_alike_are_added_up(spark, parts):
    """What a call goes over has each distinct set of scores once a task, and the sums of all events."""
    rows, found = parts
    weights = rows.agg(F.sum("weight"), F.count("*")).first()
    table = likelihood.Likelihood(rows, None, Q.LOG_YIELDS, cubes=found).events
    n, total = table.count(), table.agg(F.sum("weight")).first()[0]
    assert n <= 3 * 55 * rows.rdd.getNumPartitions() < weights[1] and total == pytest.approx(weights[0])
    drawn = toys.ToyLikelihood(rows, [toys.Truth(), toys.Truth(2.0)], ["event_id"], Q.LOG_YIELDS, found)
    toy = toys.draw_toys(rows, drawn.truths, ["event_id"])
    of = lambda t: tuple(t.agg(*(F.sum(F.col("toys")[k]) for k in (0, 1))).first())
    assert of(drawn.table) == of(toy) and drawn.table.count() <= 55 * rows.rdd.getNumPartitions()


def test_added_up_loses_nothing():
    rng = np.random.default_rng(1)
    d = rng.choice([0.0, -0.0, 0.5, 1.0], (5_000, 2))
    names, weight = rng.choice(["a", "b"], 5_000), rng.random(5_000)
    for kind in ("repeated", "distinct"):
        at = d if kind == "repeated" else rng.random((5_000, 2))
        batch = pa.RecordBatch.from_arrays([pa.array(names), pa.FixedSizeListArray.from_arrays(pa.array(at.ravel()), 2).cast(pa.list_(pa.float64())), pa.array(weight)], ["region", "d", "weight"])
        out = list(alike.added((batch.slice(k, 700) for k in range(0, 5_000, 700)), "weight", limit=900))
        assert sum(b.num_rows for b in out) == (32 if kind == "repeated" else 5_000)
        for x in "ab":
            here = sum((w for b in out for r, w in zip(b.column("region").to_pylist(), b.column("weight").to_pylist(), strict=True) if r == x), 0.0)
            assert here == pytest.approx(weight[names == x].sum())
