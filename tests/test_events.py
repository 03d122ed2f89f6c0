"""Edge rows of the event operators, with values worked out by hand."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import kinematics as K
from tessella.functions import numeric as N
from tessella.operators import histograms as H
from tessella.operators import likelihood as L
from tessella.operators import cubes, quality, resampling, scoring, selections, spline, systematics, yields
from tessella.plans import fit
from tessella.schema import BASE_POINTS, FEATURES, MONOMIALS, PRIMARY
from tessella.sources import events as S

BASE = dict(
    PRI_lep_pt=30.0, PRI_lep_eta=0.5, PRI_lep_phi=1.0, PRI_had_pt=40.0, PRI_had_eta=-0.5, PRI_had_phi=2.0, PRI_jet_leading_pt=60.0, PRI_jet_leading_eta=1.0, PRI_jet_leading_phi=0.3,
    PRI_jet_subleading_pt=40.0, PRI_jet_subleading_eta=-1.0, PRI_jet_subleading_phi=-0.4, PRI_n_jets=2, PRI_jet_all_pt=100.0, PRI_met=50.0, PRI_met_phi=0.1,
)
SCHEMA = "event_id long, " + ", ".join(f"{f} {'int' if f == 'PRI_n_jets' else 'double'}" for f in PRIMARY) + ", weight double, label int"


def frame(spark, *rows):
    data = [(i, *(({**BASE, **r})[f] for f in PRIMARY), float(r.get("weight", 1.0)), r.get("label", 0)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def region_rows(spark, rows):
    return spark.createDataFrame(rows, f"id int, {selections.MT} double, {selections.PT_H} double, {selections.JET1} double, {selections.JET2} double")


def ids(df, condition):
    return sorted(r.id for r in df.where(condition).collect())


def test_selection_edges(spark):
    df = region_rows(spark, [(0, 70.0, 100.0, 50.0, 31.0), (1, 69.9, 99.9, 51.0, 30.0), (2, 10.0, 200.0, -25.0, -25.0), (3, 10.0, 50.0, math.nan, 40.0), (4, 80.0, 0.0, 51.0, 31.0), (5, math.nan, None, None, 50.0)])
    assert ids(df, selections.predicate("highMT")) == [0, 4]
    assert ids(df, selections.predicate("VBFJet")) == [4]
    assert ids(df, selections.predicate("noVBFJet")) == [0, 1, 2, 3, 5]
    assert ids(df, selections.predicate("ptH100to200")) == [0]
    assert ids(df, selections.predicate("ptH0to100")) == [1, 3, 4]
    assert ids(df, selections.predicate("inclusive")) == [0, 1, 2, 3, 4, 5]
    with pytest.raises(KeyError):
        selections.predicate("lowMT_other")
    assert len(selections.list_selections()) == len(selections.ATOMS) + len(selections.COMPOSITES)


def test_exclusive_regions_partition(spark):
    rng = np.random.default_rng(1)
    df = region_rows(spark, [(i, *map(float, v)) for i, v in enumerate(rng.uniform(0, 250, (300, 4)))])
    assert selections.explode_regions(df, selections.EXCLUSIVE).groupBy("id").count().where("count != 1").isEmpty()


@pytest.mark.parametrize(("mode", "kept"), [("documented", [2]), ("literal", [0])])
def test_hadron_cut(spark, mode, kept):
    df = frame(spark, *({"PRI_had_pt": x} for x in (25.9, 26.0, 26.1)))
    assert sorted(r.event_id for r in systematics.apply_thresholds(df, mode).collect()) == kept


def test_jet_and_lepton_thresholds(spark):
    rows = systematics.apply_thresholds(
        frame(spark, {"PRI_jet_subleading_pt": 26.0, "PRI_jet_all_pt": 86.0}, {"PRI_jet_leading_pt": 25.0, "PRI_jet_subleading_pt": 20.0, "PRI_jet_all_pt": 45.0}, {"PRI_lep_pt": 19.999}, {"PRI_lep_pt": 20.0})
    ).orderBy("event_id").collect()
    assert [r.event_id for r in rows] == [0, 1, 3]
    assert (rows[0].PRI_n_jets, rows[0].PRI_jet_subleading_pt, rows[0].PRI_jet_subleading_phi, rows[0].PRI_jet_all_pt) == (1, -25.0, -25.0, 60.0)
    assert (rows[1].PRI_n_jets, rows[1].PRI_jet_leading_eta, rows[1].PRI_jet_all_pt) == (0, -25.0, 0.0)


def test_variations(spark):
    df = frame(spark, {"PRI_had_pt": 100.0, "PRI_had_phi": 0.0, "PRI_met": 50.0, "PRI_met_phi": 0.0}, {"PRI_n_jets": 0, "PRI_jet_leading_pt": -25.0, "PRI_jet_subleading_pt": -25.0, "PRI_jet_all_pt": 0.0})
    tes = systematics.vary(df, systematics.Shift(tes=1.02)).orderBy("event_id").first()
    assert (tes.PRI_had_pt, tes.PRI_met) == (102.0, 48.0)
    jes = systematics.vary(df, systematics.Shift(jes=1.02)).orderBy(F.desc("event_id")).first()
    assert (jes.PRI_jet_leading_pt, jes.PRI_jet_all_pt, jes.PRI_met) == (-25.0, 0.0, 50.0)
    soft = systematics.vary(df, systematics.Shift(soft_met=3.0)).orderBy("event_id").first()
    assert soft.PRI_met != 50.0 and soft.PRI_had_pt == 100.0


def test_half_even(spark):
    df = spark.createDataFrame([(2.6745,), (0.0005,), (-1.0005,)], "x double")
    assert [r[0] + 0.0 for r in df.select(N.half_even(F.col("x"))).collect()] == [2.674, 0.0, -1.0]


def test_derived_against_numpy(spark):
    rng = np.random.default_rng(7)
    rows = [{f: float(v) for f, v in zip([x for x in PRIMARY if x != "PRI_n_jets"], rng.uniform(-2, 2, 15), strict=True)} | {"PRI_n_jets": int(i % 4)} for i in range(40)]
    for r in rows:
        for f in ("PRI_lep_pt", "PRI_had_pt", "PRI_jet_leading_pt", "PRI_jet_subleading_pt", "PRI_jet_all_pt", "PRI_met"):
            r[f] = 20 + abs(r[f]) * 40
    got = K.with_derived(frame(spark, *rows)).orderBy("event_id").toPandas()
    a = {f: got[f].to_numpy(float) for f in PRIMARY}
    nj = a["PRI_n_jets"]
    vec = lambda n: (a[f"{n}_pt"] * np.cos(a[f"{n}_phi"]), a[f"{n}_pt"] * np.sin(a[f"{n}_phi"]), a[f"{n}_pt"] * np.sinh(a[f"{n}_eta"]), a[f"{n}_pt"] * np.cosh(a[f"{n}_eta"]))
    lep, had, met = vec("PRI_lep"), vec("PRI_had"), (a["PRI_met"] * np.cos(a["PRI_met_phi"]), a["PRI_met"] * np.sin(a["PRI_met_phi"]))
    j1, j2 = vec("PRI_jet_leading"), vec("PRI_jet_subleading")
    two = nj >= 2
    want = {
        "DER_mass_transverse_met_lep": np.sqrt(np.maximum(0, (a["PRI_met"] + a["PRI_lep_pt"]) ** 2 - (met[0] + lep[0]) ** 2 - (met[1] + lep[1]) ** 2)),
        "DER_mass_vis": np.sqrt((lep[3] + had[3]) ** 2 - sum((lep[k] + had[k]) ** 2 for k in range(3))),
        "DER_pt_h": np.hypot(*(lep[k] + had[k] + met[k] for k in (0, 1))),
        "DER_mass_jet_jet": np.where(two, np.sqrt(np.maximum(0, (j1[3] + j2[3]) ** 2 - sum((j1[k] + j2[k]) ** 2 for k in range(3)))), -25),
        "DER_pt_tot": np.hypot(*(lep[k] + had[k] + met[k] + np.where(nj >= 1, j1[k], 0) + np.where(two, j2[k], 0) for k in (0, 1))),
        "DER_deltar_had_lep": np.hypot(a["PRI_had_eta"] - a["PRI_lep_eta"], np.abs((a["PRI_had_phi"] - a["PRI_lep_phi"] + 3 * np.pi) % (2 * np.pi) - np.pi)),
        "DER_lep_eta_centrality": np.where(two, np.exp(-4 / (a["PRI_jet_leading_eta"] - a["PRI_jet_subleading_eta"]) ** 2 * (a["PRI_lep_eta"] - (a["PRI_jet_leading_eta"] + a["PRI_jet_subleading_eta"]) / 2) ** 2), -25),
    }
    for name, value in want.items():
        np.testing.assert_allclose(got[name], value, rtol=1e-9, err_msg=name)


def test_derived_edges(spark):
    df = frame(spark, {"PRI_lep_phi": 3.1, "PRI_had_phi": -3.1, "PRI_lep_eta": 0.0, "PRI_had_eta": 0.0}, {"PRI_met_phi": 1.0, "PRI_lep_phi": 1.0, "PRI_had_phi": 1.0}, {"PRI_jet_leading_eta": 0.5, "PRI_jet_subleading_eta": 0.5, "PRI_lep_eta": 0.5}, {"PRI_had_pt": 0.0})
    rows = K.with_derived(df).orderBy("event_id").collect()
    assert rows[0].DER_deltar_had_lep == pytest.approx(2 * math.pi - 6.2)
    assert rows[1].DER_met_phi_centrality == pytest.approx(1.0)
    assert rows[2].DER_lep_eta_centrality == pytest.approx(1.0)
    assert rows[3].DER_pt_ratio_lep_tau is None


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 20.0, 400.0, 401.0, math.nan)], "x double")
    assert [r[0] for r in df.select(N.bin_of(F.col("x"), 20, 0.0, 400.0)).collect()] == [None, 0, 1, 19, None, None]
    score = spark.createDataFrame([(1.0,)], "x double").select(N.bin_of(F.col("x"), 30, 0.0, 1.0)).first()[0]
    assert score == 29
    flat = spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double")
    assert [tuple(r) for r in H.histogram_2d(flat, F.col("x"), F.col("y")).collect()] == [(0, 0, 3)]


def test_calibration_edge_counts_twice(spark):
    df = spark.createDataFrame([(0.0, 0, 1.0), (0.5, 1, 2.0), (1.0, 1, 1.0)], "s double, y int, weight double")
    rows = quality.calibration_curve(df, "s", "y", bins=2).orderBy("bin").collect()
    assert [round(r.true, 6) for r in rows] == [round(2 / 3, 6), 1.0]
    assert [r.pred for r in rows] == [0.25, 0.75]


def test_roc_and_auc(spark):
    rng = np.random.default_rng(3)
    data = [(float(round(s, 2)), int(y)) for s, y in zip(rng.uniform(size=400), rng.integers(0, 2, 400), strict=True)]
    df = spark.createDataFrame(data, "s double, y int")
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert quality.auc(df, "s", F.col("y") == 1).first()[0] == pytest.approx(want)
    curve = quality.roc_curve(df, "s", F.col("y") == 1).orderBy("fpr", "tpr").collect()
    assert (curve[0].threshold, curve[0].tpr, curve[-1].tpr, curve[-1].fpr) == (None, 0.0, 1.0, 1.0)


def test_intervals():
    assert fit.crossings([(0, 4), (1, 0), (2, 0), (3, 4)]) == [0.75, 2.25]
    assert fit.crossings([(0, 2), (1, 1), (2, 2)]) == []
    got = fit.finalise(1.0, [0.05, 3.2], 0.1, inflate=1.0)
    assert (got["p16"], got["p84"]) == (0.09, 3.01) and got["delta_mu_hat"] == pytest.approx(1.46)
    points = fit.scan_points(0.0, 1.0, 21)
    assert len(points) == 21 and points[-1] == pytest.approx(20 / 21)


def test_nuisances(spark):
    row = spark.createDataFrame([(1.02, 1.04)], "jes double, tt double").select(systematics.alpha_to_nu(F.col("jes"), "jes"), systematics.alpha_to_nu(F.col("tt"), "ttbar")).first()
    assert row[0] == pytest.approx(2) and row[1] == pytest.approx(2)


def test_asimov_and_normalisations(spark):
    df = frame(spark, {"label": 2}, {"label": 0}, {"label": 3})
    w = [r.weight for r in L.asimov_weights(df, nu_bkg=1.0, nu_tt=1.0).orderBy("event_id").collect()]
    assert w == pytest.approx([1.001 * 1.02, 1.0, 1.001])
    w = [r.weight for r in systematics.scale_weights(df, ttbar=2.0, background=3.0).orderBy("event_id").collect()]
    assert w == pytest.approx([6.0, 1.0, 3.0])


def test_file_names(spark):
    names = ["diboson_tes_0p97_met_1p5.h5", "nominal.h5", "ttbar_nominal.h5", "jes_1p01.h5"]
    rows = spark.createDataFrame([(n,) for n in names], "f string").select(*(c.alias(k) for k, c in S.parse_file_name(F.col("f")).items())).collect()
    assert [tuple(r) for r in rows] == [("diboson", 0.97, 1.0, 1.5), (None, 1.0, 1.0, 0.0), ("ttbar", 1.0, 1.0, 0.0), (None, 1.0, 1.01, 0.0)]
    for r, n in zip(rows, names, strict=True):
        assert S.file_name(r.process, (r.tes, r.jes, r.met)) == n


def test_resampling(spark):
    df = frame(spark, {"weight": 2.9}, {"weight": 0.9}, {"weight": -1.0})
    assert resampling.repeat_by_weight(df).count() == 2
    big = spark.range(4000).select(F.lit(3.0).alias("m"))
    n = resampling.with_poisson(big, "n", F.col("m"), 5).agg(F.avg("n"), F.var_pop("n")).first()
    assert n[0] == pytest.approx(3, abs=0.15) and n[1] == pytest.approx(3, abs=0.3)
    large = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 75.5).otherwise(31.0).alias("m"))
    for r in resampling.with_poisson(large, "n", F.col("m"), 6).groupBy("m").agg(F.avg("n").alias("a"), F.var_pop("n").alias("v"), F.skewness("n").alias("s")).collect():
        assert (r.a, r.v) == (pytest.approx(r.m, rel=0.02), pytest.approx(r.m, rel=0.15)) and r.s == pytest.approx(r.m**-0.5, abs=0.15)
    many = spark.range(500).select("id")
    taken = {r.id for r in resampling.sample_rows(many, 100).collect()}
    assert len(taken) == 100 and taken == {r.id for r in resampling.sample_rows(many.repartition(7), 100).collect()} and taken != {r.id for r in resampling.sample_rows(many, 100, 1).collect()}
    assert resampling.sample_rows(df, 2).count() == 2 and resampling.sample_rows(df, 0.5).count() == 1
    for bad in (1.5, "x", True, -1):
        with pytest.raises(ValueError):
            resampling.sample_rows(df, bad)
    assert resampling.bootstrap(frame(spark, {"label": 1, "weight": 1.2}), background=2.0, draw=False).count() == 2


def test_log_polynomial_fit():
    rng = np.random.default_rng(2)
    truth = rng.normal(0, 0.02, len(MONOMIALS))
    table = {p: 10 * math.exp(float(np.dot(truth, yields.monomials(p)))) for p in BASE_POINTS}
    np.testing.assert_allclose(yields.fit_log_polynomial(table), truth, atol=1e-10)
    with pytest.raises(ValueError):
        yields.fit_log_polynomial({p: 1.0 for p in BASE_POINTS[1:]})
    with pytest.raises(ValueError):
        yields.design([BASE_POINTS[0], (1.0, 0.0, 0.0)])


def scored_rows(spark, n=50, seed=4):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.ones(4), n)
    data = [("r", int(i % 4), float(rng.uniform(0.5, 2)), *map(float, p[i]), *([float(x) for x in rng.normal(0, 0.02, 9)] for _ in range(4))) for i in range(n)]
    names = "htautau ztautau ttbar diboson".split()
    return spark.createDataFrame(data, "region string, label int, weight double, " + ", ".join(f"p_{x} double" for x in names) + ", " + ", ".join(f"d_{x} array<double>" for x in names))


def test_likelihood_is_zero_at_nominal(spark):
    s = scored_rows(spark)
    terms = L.region_terms(s, s, [{"mu": 1.0}], {}).first()
    assert terms.shift == pytest.approx(0, abs=1e-9) and terms.log_term == pytest.approx(0, abs=1e-9)
    assert L.poisson_term({"mu": 1.0}, {"htautau": 1.0, "ztautau": 5.0, "ttbar": 2.0, "diboson": 1.0}, 9.0, {}) == pytest.approx(0)


def test_fit_recovers_pseudodata(spark):
    s = scored_rows(spark, 200).persist()
    toy = s.withColumn("weight", F.col("weight") * L.density_ratio(L.at({"mu": 1.4}), {})).persist()
    found = fit.minimise(L.Likelihood(toy, s, {}), {"mu": 1.0, "nu_bkg": 0.0}, {})
    assert found.values["mu"] == pytest.approx(1.4, abs=0.02)


def test_cube_and_exact_shift_agree(spark, tmp_path):
    """On a grid point, off the grid by interpolation, and through a written cube table."""
    s = scored_rows(spark)
    axes = (tuple(x / 2 for x in range(-4, 5)), tuple(x / 2 for x in range(-4, 5)), tuple(x / 2 for x in range(7)))
    log_yields = {"ttbar": [0.01, -0.02, 0.003, 0.0, 0.0, 0.001, 0.0, 0.0, 0.0]}
    table = cubes.cube_table(s, log_yields, axes)
    assert table.count() == 4 * (9 * 9 * 7 + 1) and tuple(map(len, cubes.AXES)) == (27, 27, 9)
    cubes.write_cubes(table, f"{tmp_path}/cubes")
    found = cubes.Cubes.read(spark, f"{tmp_path}/cubes", ["r"], axes)
    for at in ((0.5, -0.5, 1.0), (0.3, -1.27, 0.71)):
        point = {"mu": 1.3, "nu_tt": 0.5, **dict(zip(("nu_tes", "nu_jes", "nu_met"), at, strict=True))}
        exact = L.region_terms(None, s, [point], log_yields).first().shift
        assert found.shift("r", point) == pytest.approx(exact, rel=1e-4)
    for with_, without in zip(L.Likelihood(s, None, log_yields, cubes=found)([point]), L.Likelihood(s, s, log_yields)([point]), strict=True):
        assert with_ == pytest.approx(without, rel=1e-4)
    with pytest.raises(ValueError):
        L.Likelihood(s, None, log_yields)
    with pytest.raises(ValueError):
        cubes.Cubes.of(table.where("cell != 5"), axes)
    assert cubes.cube_table(s.withColumn("p_ttbar", F.lit(None).cast("double")), {}, axes).isEmpty()


def test_region_terms_are_the_ratio_column(spark):
    """The matrix form gives what the Column form gives, also NaN where a ratio is not positive."""
    s = scored_rows(spark)
    points = [{"mu": 1.3, "nu_tt": 0.5, "nu_tes": 0.4}, {"mu": 0.7, "nu_bkg": -1.0, "nu_met": 2.0}]
    got = {r.point: r for r in L.region_terms(s, s, points, {}).collect()}
    for k, p in enumerate(points):
        r = L.density_ratio(L.at(p), {})
        want = s.agg(F.sum(F.col("weight") * (1 - r)).alias("a"), F.sum(F.col("weight") * F.log(r)).alias("b")).first()
        assert (got[k].shift, got[k].log_term) == (pytest.approx(want.a), pytest.approx(want.b))
    assert math.isnan(L.region_terms(s, None, [{"mu": -1e6}], {}).first().log_term)


def test_hessian_near_and_at_bounds():
    """Mixed terms keep their value where a corner is cut off by a bound, and are 0 at the bound."""
    f = lambda points: np.array([p["mu"] * p["nu_met"] + 2 * p["nu_met"] ** 2 + p["mu"] ** 2 for p in points])
    assert fit.hessian(f, {"mu": 1.0, "nu_met": 0.1}) == pytest.approx(np.array([[2.0, 1.0], [1.0, 4.0]]))
    assert fit.hessian(f, {"mu": 1.0, "nu_met": 0.0}) == pytest.approx(np.array([[2.0, 0.0], [0.0, 4.0]]))
    assert fit.hessian(f, {"mu": 1.0, "nu_met": 5.0})[1, 1] == pytest.approx(4.0)


def test_minos_and_impacts():
    """A parabola with a correlation: the profiled width is the square root of the inverse curvature, on both sides."""
    f = lambda points: np.array([((p["mu"] - 1) ** 2 + 1.2 * (p["mu"] - 1) * p["nu_tt"] + p["nu_tt"] ** 2) / 0.04 for p in points])
    best = fit.minimise(f, {"mu": 0.8, "nu_tt": 0.3})
    best.covariance = fit.covariance(fit.hessian(f, best.values), 1.0)
    sigma = math.sqrt(0.04 / (1 - 0.36))
    low, high = fit.minos(f, best)
    assert (best.values["mu"] - low, high - best.values["mu"]) == (pytest.approx(sigma, rel=0.02), pytest.approx(sigma, rel=0.02))
    impact = fit.impact_of(f, best, "nu_tt")
    assert impact["nu_up"] == pytest.approx(sigma, rel=0.02) and impact["impact_up"] == pytest.approx(-0.6 * sigma, rel=0.05)
    bounded = {**fit.BOUNDS, "mu": (0.95, math.inf)}
    assert fit.minos(f, fit.minimise(f, {"mu": 1.0, "nu_tt": 0.0}, None, bounded), bounds=bounded)[0] == 0.95


def test_soft_term_by_key(spark):
    """Draws that follow a key do not follow the partitions, and are standard normal and independent."""
    base = frame(spark, {}).drop("event_id") if "event_id" in frame(spark, {}).columns else frame(spark, {})
    e = spark.range(4000).withColumnRenamed("id", "event_id").crossJoin(base)
    shift = systematics.Shift(soft_met=3.0, key="event_id")
    take = lambda df: {r.event_id: (r.PRI_met, r.PRI_met_phi) for r in systematics.vary(df, shift).select("event_id", "PRI_met", "PRI_met_phi").collect()}
    a = take(e)
    assert a == take(e.repartition(5)) and len(set(a.values())) > 3000
    x, y = (c for c in systematics.keyed_normals(F.col("event_id"), 7))
    r = e.select(x.alias("x"), y.alias("y")).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.stddev_pop("y").alias("t"), F.corr("x", "y").alias("c")).first()
    assert (r.m, r.s, r.t, r.c) == (pytest.approx(0, abs=0.06), pytest.approx(1, abs=0.05), pytest.approx(1, abs=0.05), pytest.approx(0, abs=0.06))


def test_models_come_back_as_they_were(spark, tmp_path):
    from tessella.sources import models

    network = scoring.Network(("a", "b"), (((((0.5, -1.0), (0.25, 2.0)), (0.0, 0.1))),), "linear", (1.0, 2.0), (3.0, 4.0), (1.0, 2.0))
    tree = scoring.Split("a", 0.5, scoring.Leaf((1.0, 2.0)), scoring.Split("b", -1.0, scoring.Leaf((0.0, 1.0)), scoring.Leaf((3.0, 4.0)), True))
    df = spark.createDataFrame([(float(i % 50) / 50, float(i % 3 == 0), 1.0) for i in range(300)], "s double, y double, weight double")
    isotonic = scoring.fit_isotonic(df, "s", F.col("y"))
    curve = models.Curve.of(isotonic)
    table = models.Table.of(yields.class_yields(spark.createDataFrame([(0, 1.5), (0, 2.0), (1, 3.25)], "label int, weight double")))
    found = fit.Fit({"mu": 1.2}, 3.5, np.array([[0.25]]), 7, ("mu",))
    for i, model in enumerate((network, tree, [tree, tree.right], curve, table)):
        models.save(spark, model, f"{tmp_path}/{i}")
        assert models.load(spark, f"{tmp_path}/{i}") == model
    models.save(spark, found, f"{tmp_path}/fit")
    again = models.load(spark, f"{tmp_path}/fit")
    assert again.row() == found.row() and again.names == ("mu",)
    at = spark.createDataFrame([(-1.0,), (0.111,), (0.5,), (2.0,), (None,)], "s double")
    a = [r.calibrated for r in curve(at, "s").orderBy("s").collect()]
    b = [r.calibrated for r in scoring.calibrate_isotonic(at.dropna(), isotonic, "s").orderBy("s").collect()]
    assert a[0] is None and a[1:] == pytest.approx(b)
    assert str(table).splitlines()[0].split() == ["label", "yield", "n"] and len(str(table).splitlines()) == 3
    with pytest.raises(TypeError):
        models.to_json(object())


def test_saved_ensemble_of_boosted_trees(spark):
    """A small file in the saved format: strict conditions, missing values by default direction, softmax over classes."""
    import json

    from tessella.sources import models

    tree = lambda feature, condition, a, b, default: {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [feature, 0, 0], "split_conditions": [condition, a, b], "default_left": [default, 0, 0]}
    text = json.dumps({"learner": {"feature_names": ["x", "z"], "learner_model_param": {"num_class": "2", "base_score": "5E-1"},
                                   "gradient_booster": {"model": {"trees": [tree(0, 1.0, 0.5, -0.5, 1), tree(1, 2.0, 0.25, 1.0, 0)], "tree_info": [0, 1]}}}})
    ensemble = models.read_ensemble(text)
    rows = spark.createDataFrame([(0.999, 2.0), (1.0, 1.9), (None, None), (float("nan"), 5.0)], "x double, z double")
    got = rows.select(*(m.alias(f"m{i}") for i, m in enumerate(ensemble.margins())), ensemble.scores(("a", "b"))["a"].alias("p")).collect()
    want = [(1.0, 1.5), (0.0, 0.75), (1.0, 1.5), (1.0, 1.5)]
    assert [(r.m0, r.m1) for r in got] == want
    assert [r.p for r in got] == pytest.approx([math.exp(a) / (math.exp(a) + math.exp(b)) for a, b in want])


def test_settings_and_overrides(tmp_path):
    import json

    from tessella import config

    plain = {"Tasks": ["MultiClassifier", "htautau", "ttbar"], "Selections": ["highMT_VBFJet"], "Parameters": {"alpha_tt": 0.02}, "Poisson": {"a": {"preselection": "highMT_noVBFJet", "mva_selection": [["ttbar", 0.4, 100]]}, "b": {"preselection": "x", "ignore": True}}}
    changed = config.overridden(plain, ["Parameters.alpha_tt=0.5", "CSI.use=true", "Save.n_split=100", "Poisson.b.ignore=false", "New.deep.text=a=b", "x=-1e-3", "y=none"])
    assert "CSI" not in plain and changed["New"] == {"deep": {"text": "a=b"}} and changed["x"] == -0.001 and changed["y"] is None
    with open(tmp_path / "c.json", "w") as f:
        json.dump(plain, f)
    s = config.read_settings(str(tmp_path / "c.json"), ["CSI.use=TRUE", "Parameters.alpha_tt=0.5"])
    assert s.processes == ("htautau", "ttbar") and s.use_cubes and dict(s.rates)["nu_tt"] == 0.5 and dict(s.rates)["nu_bkg"] == 0.001
    assert s.poisson_regions == {"a": ("highMT_noVBFJet", (("ttbar", 0.4, 100.0),))}
    assert config.settings({}) == config.Settings()
    for bad in (["novalue"], ["Tasks.x=1"]):
        with pytest.raises(ValueError):
            config.overridden(plain, bad)
    with pytest.raises(ValueError):
        config.settings({"Tasks": ["nothing"]})


def test_train_rows_keep_their_lines(spark, tmp_path):
    """A folder of several Parquet files: every event meets its own label and weight."""
    from tessella.schema import PRIMARY

    (tmp_path / "data" / "data.parquet").mkdir(parents=True)
    n = 90
    import pandas as pd

    for part in range(3):
        pd.DataFrame({c: [float(part * 30 + i) for i in range(30)] for c in PRIMARY}).to_parquet(tmp_path / "data" / "data.parquet" / f"part-{part}.parquet")
    for name, values in (("labels", [i % 2 for i in range(n)]), ("weights", [i / 8 for i in range(n)]), ("detailed_labels", [f" d{i} " for i in range(n)])):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"data.{name}").write_text("\n".join(map(str, values)))
    rows = S.read_train(spark, str(tmp_path)).collect()
    assert len(rows) == n and all((r.row_idx, r.weight, r.is_signal, r.detailed_label) == (r.PRI_met, r.PRI_met / 8, r.PRI_met % 2, f"d{int(r.PRI_met)}") for r in rows)


def test_null_features_stay_in_the_tree(spark):
    rows = [(float(i % 20) if i % 5 else None, 1.0, p) for i in range(400) for p in (0, 1)]
    e = spark.createDataFrame(rows, "x double, weight double, point int").withColumn("weight", F.when((F.col("point") == 1) & (F.col("x") > 10), 2.0).otherwise(F.col("weight")))
    tree = scoring.grow_tree(e, ["x"], [(0.0, 0.0, 0.0), (0.0, 1.0, 0.0)], (("nu_jes",),), 1, 5)
    right = e.where(~tree.goes_left())
    sums = {r.point: r.w for r in right.groupBy("point").agg(F.sum("weight").alias("w")).collect()}
    assert tree.threshold == 9.0 and right.where("x is null").count() == 160
    assert tree.right.value[0] == pytest.approx(math.log(sums[1] / sums[0]))


def known(points):
    return np.array([2.0 + (p["mu"] - 2.5) ** 2 / 0.04 + sum(p.get(k, 0) ** 2 for k in ("nu_bkg", "nu_tt")) + 0.5 * (p["mu"] - 2.5) * p.get("nu_bkg", 0) for p in points])


def test_minimisers_hessian_and_scans():
    start = {"mu": 1.0, "nu_bkg": 0.5, "nu_tt": -0.5}
    for found in (fit.minimise(known, start), fit.simplex(known, start)):
        assert found.values["mu"] == pytest.approx(2.5, abs=0.02) and found.values["nu_tt"] == pytest.approx(0, abs=0.05)
    best = fit.minimise(known, start)
    h = fit.hessian(known, best.values)
    np.testing.assert_allclose(h, [[50, 0.5, 0], [0.5, 2, 0], [0, 0, 2]], atol=1e-6)
    assert quality.impacts(np.linalg.inv(h))[2] == pytest.approx(0, abs=1e-9)
    profile = fit.profile_scan(known, best, [2.3, 2.5, 2.7])
    assert profile[1][1] == pytest.approx(0, abs=1e-4) and profile[0][1] > 0.9
    whole = fit.global_fit(known, start)
    assert "cov__mu__nu_bkg" in whole.row()
    assert fit.impact_of(known, best, "nu_tt")["nu_up"] == pytest.approx(1.0, abs=0.02)


def test_bounded_minimum():
    found = fit.minimise(lambda ps: np.array([(p["nu_met"] + 1) ** 2 for p in ps]), {"nu_met": 2.0})
    assert found.values["nu_met"] == 0.0


def test_quintic_cube_is_exact_on_polynomials():
    axes = [np.linspace(-3, 3, 9), np.linspace(-2, 2, 8), np.linspace(0, 5, 7)]
    f = lambda x, y, z: x**5 - 2 * x**2 * y**3 + z**4 * y + 3
    cube = spline.Cube(axes, f(*np.meshgrid(*axes, indexing="ij")))
    for p in ((0.3, -1.1, 2.2), (-3, 2, 0), (2.9, 0.01, 4.99)):
        assert cube(p) == pytest.approx(f(*p), abs=1e-6)
    with pytest.raises(ValueError):
        cube((4, 0, 0))
    rbf = spline.RadialBasis([[0, 0], [1, 0], [0, 1], [1, 1], [0.5, 0.2]], [1, 2, 3, 4, 2.1])
    assert rbf([[1, 1]])[0] == pytest.approx(4)


def test_trees_and_gradients(spark):
    assert scoring.logistic_gradients(F.lit(0.0), F.lit(0)) is not None
    row = spark.range(1).select(*scoring.logistic_gradients(F.lit(0.0), F.lit(0)), *scoring.logistic_gradients(F.lit(0.0), F.lit(1))).first()
    assert (row[1], row[4], row[2], row[5]) == (0.5, -0.5, 0.25, 0.25)
    e = spark.createDataFrame([(float(x), 1.0 if k == 0 else (2.0 if x > 5 else 0.5), k) for x in range(10) for k in (0, 1)], "x double, weight double, point int")
    tree = scoring.grow_tree(e, ["x"], [(0.0, 0.0, 0.0), (0.0, 1.0, 0.0)], (("nu_jes",),), 1, 2)
    assert tree.threshold == 5.0 and tree.left.value[0] == pytest.approx(math.log(0.5)) and tree.right.value[0] == pytest.approx(math.log(2))


def test_isotonic_takes_many_points(spark):
    n = 4_000
    df = spark.range(n).select((F.col("id") / n).alias("s"), (0.1 + 0.8 * (F.col("id") / n) ** 2).alias("y"), F.lit(1.0).alias("weight"))
    model = scoring.fit_isotonic(df, "s", F.col("y"))
    at = spark.range(-50, 3 * n, 7).select((F.col("id") / (2.5 * n)).alias("s"))
    out = scoring.calibrate_isotonic(at, model, "s")
    got = out.orderBy("s").toPandas()
    xs = np.arange(n) / n
    assert model._java_obj.boundaries().size() == n and np.abs(got["calibrated"] - np.interp(got["s"], xs, 0.1 + 0.8 * xs**2)).max() < 1e-12
    assert len(out._jdf.queryExecution().toString()) < 20_000  # the points are no part of the plan
    few = scoring.fit_isotonic(df.where("s * 8 = floor(s * 8)"), "s", F.col("y"))
    both = scoring.calibrate_isotonic(at, few, "s").withColumn("column", scoring.isotonic_column(few, F.col("s"))).toPandas()
    assert np.abs(both["calibrated"] - both["column"]).max() < 1e-12


def test_isotonic_is_monotone(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(float(s), int(rng.uniform() < s), 1.0) for s in rng.uniform(size=300)], "s double, y int, weight double")
    model = scoring.fit_isotonic(df, "s", F.col("y"))
    got = df.select("s", scoring.isotonic_column(model, F.col("s")).alias("c")).orderBy("s").toPandas()
    assert (np.diff(got.c) >= -1e-12).all() and got.c.between(1e-6, 1 - 1e-6).all()
    np.testing.assert_allclose(got.c, np.clip(model.transform(df.withColumnRenamed("s", "score")).orderBy("score").toPandas().prediction, 1e-6, 1 - 1e-6), atol=1e-9)


def test_sources_round_trip(spark, tmp_path):
    df = frame(spark, {"label": 0}, {"label": 2, "weight": 3.0})
    S.write_events(df.selectExpr("*", "'lowMT' selection", "'ttbar' process", "1.02D tes", "1.0D jes", "0.0D met"), f"{tmp_path}/e")
    assert S.lookup(spark, f"{tmp_path}/e", "lowMT", "ttbar", (1.02, 1.0, 0.0)).count() == 2
    with pytest.raises(KeyError):
        S.lookup(spark, f"{tmp_path}/e", "lowMT", "diboson")
    (tmp_path / "x.weights").write_text("1.5\n2.5\n-3\n")
    assert [r.w for r in S.read_lines(spark, f"{tmp_path}/x.weights", "w").orderBy("row_idx").collect()] == [1.5, 2.5, -3.0]
    numbered = S.index_rows(spark.range(1000).withColumn("k", 999 - F.col("id")), [F.col("k")])
    assert numbered.where("row_idx != k").isEmpty() and numbered.count() == 1000
    S.copy_with_selection(df, F.lit(True), f"{tmp_path}/c", "ttbar")
    S.copy_with_selection(df, F.lit(True), f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 1
    S.write_result({"mu_hat": 1.25}, f"{tmp_path}/r", spark)
    assert S.read_settings(spark, f"{tmp_path}/r").first().mu_hat == 1.25
    ntuple = scored_rows(spark).withColumnRenamed("region", "selection")
    S.write_ntuple(ntuple, f"{tmp_path}/n", {"model": "a"})
    assert S.read_ntuple(spark, f"{tmp_path}/n", {"model": "a"}).count() == 50
    with pytest.raises(ValueError):
        S.read_ntuple(spark, f"{tmp_path}/n", {"model": "b"})
    with pytest.raises(ValueError):
        S.read_events(spark, f"{tmp_path}/n", ["absent"])
    files = spark.createDataFrame([("toy_mu_1p250",), ("nominal_1",)], "file string")
    assert [r.file for r in S.plain_toys(files).collect()] == ["toy_mu_1p250"]
    assert spark.range(1).select(S.mu_name(F.lit(1.25))).first()[0] == "1p250"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(-3, 3), min_size=3, max_size=3))
def test_monomials_match_products(point):
    m = dict(zip(MONOMIALS, yields.monomials(point), strict=True))
    assert m[("nu_tes", "nu_jes")] == pytest.approx(point[0] * point[1]) and m[("nu_met", "nu_met")] == pytest.approx(point[2] ** 2)


def test_feature_registry():
    assert len(FEATURES) == 28 and len(BASE_POINTS) == 35 and BASE_POINTS[0] == (0.0, 0.0, 0.0)
