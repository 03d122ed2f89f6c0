"""Queries of the likelihood: density ratios, region terms, Poisson terms, scans and intervals."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessella.operators import cubes, quality, selections, toys
from tessella.operators import likelihood as L
from tessella.operators.spline import calibrated_mu
from tessella.operators.yields import monomials
from tessella.plans import fit
from tessella.plans.queries_events import sql_region, sql_regions
from tessella.plans.registry import r, rs, scored
from tessella.schema import MONOMIALS, PARAMETERS, POISSON_REGIONS, PROCESSES, RATE, SHAPES, UNBINNED_REGIONS
from tessella.sources.fixture import LOG_YIELD, views
from tessella.sources.scratch import cut

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


LOG_YIELDS = {p: LOG_YIELD for p in PROCESSES}
POINT = {"mu": 1.3, "nu_bkg": 0.5, "nu_tt": -0.4, "nu_diboson": 0.3, "nu_tes": 0.6, "nu_jes": -0.2, "nu_met": 0.5}
ASIMOV = {"mu": 1.2, "nu_bkg": 1.0, "nu_tt": 0.5, "nu_diboson": -0.5}
SCAN = [{**POINT, "mu": m} for m in fit.scan_points(0.7, 1.9, 21)]


def in_regions(spark, sf):
    """Scored simulation in the unbinned regions."""
    rows = selections.explode_regions(scored(spark, sf), UNBINNED_REGIONS)
    return rows.select("event_id", "region", "label", "weight", *(f"p_{p}" for p in PROCESSES), *(f"d_{p}" for p in PROCESSES))


def toy(spark, sf):
    return L.asimov_weights(in_regions(spark, sf), **ASIMOV)


def poisson_input(spark, sf):
    s = L.asimov_weights(scored(spark, sf).withColumn("__w", F.col("weight")), **ASIMOV)
    swapped = s.withColumns({"weight": F.col("__w"), "__observed": F.col("weight")})
    return L.poisson_yields(swapped, F.col("__observed"))


# -- SQL side ------------------------------------------------------------------------------------------------------------
_ASIMOV = (
    f"w*CASE WHEN label=0 THEN {ASIMOV['mu']}::double ELSE 1.0::double END*CASE WHEN label!=0 THEN {(1 + RATE['nu_bkg']) ** ASIMOV['nu_bkg']!r}::double ELSE 1.0::double END"
    f"*CASE WHEN label=2 THEN {(1 + RATE['nu_tt']) ** ASIMOV['nu_tt']!r}::double ELSE 1.0::double END*CASE WHEN label=3 THEN {(1 + RATE['nu_diboson']) ** ASIMOV['nu_diboson']!r}::double ELSE 1.0::double END"
)


def _norm(p: str, point: dict) -> float:
    return sum(point[n] * math.log1p(RATE[n]) for n in L.SCALED_BY[p])


def sql_ratio(point: dict, mu: str | None = None) -> str:
    """The density ratio of a row of sc at a point; mu may be an expression."""
    shapes = monomials([point[s] for s in SHAPES])
    offset = sum(a * b for a, b in zip(LOG_YIELD, shapes, strict=True))
    parts = []
    for i, p in enumerate(PROCESSES):
        exponent = f"({_norm(p, point) + offset!r})::double + " + " + ".join(f"d{i}{k}*({x!r})::double" for k, x in enumerate(shapes))
        scale = (mu or f"{point['mu']}::double") + "*" if p == "htautau" else ""
        parts.append(f"{scale}p{i}*exp({exponent})")
    return "(" + " + ".join(parts) + ")"


_RG = f"rg AS (SELECT *, {_ASIMOV} AS wt FROM ({sql_regions(UNBINNED_REGIONS, 'sc')}))"
_P = {"highMT_noVBFJet_ttbar": "p2 >= 0.4 AND p2 < 100", "highMT_noVBFJet_diboson": "p2 < 0.4 AND p3 >= 0.5 AND p3 < 100", "lowMT_noVBFJet_ptH0to100": "true"}
_PO = (
    "po AS (" + " UNION ALL ".join(f"SELECT '{n}' AS region, label, w, {_ASIMOV} AS wt FROM sc WHERE {sql_region(sel)} AND {_P[n]}" for n, (sel, _) in POISSON_REGIONS.items())
    + "), py AS (SELECT region, " + ", ".join(f"sum(CASE WHEN label={i} THEN w ELSE 0 END) AS s{i}" for i in range(4)) + ", sum(wt) AS observed FROM po GROUP BY region)"
)


def sql_poisson(point: dict, mu: str | None = None) -> str:
    shapes = monomials([point[s] for s in SHAPES])
    offset = sum(a * b for a, b in zip(LOG_YIELD, shapes, strict=True))
    scale = [f"{(mu or repr(point['mu']))}*{math.exp(offset)!r}::double" if p == "htautau" else f"{math.exp(_norm(p, point) + offset)!r}::double" for p in PROCESSES]
    shift = " + ".join(f"s{i}*({scale[i]} - 1)" for i in range(4))
    return f"(2*({shift}) - 2*observed*ln(({' + '.join(f's{i}*{scale[i]}' for i in range(4))})/(s0+s1+s2+s3)))"


# -- queries -------------------------------------------------------------------------------------------------------------
@query("q_asimov", views(_RG) + f"SELECT event_id, region, {rs('wt', 9)} AS weight FROM rg")
def q_asimov(spark, sf):
    return toy(spark, sf).select("event_id", "region", r("weight", 9).alias("weight"))


@query("q_density_ratio", views(_RG) + f"SELECT event_id, region, {rs(sql_ratio(POINT), 8)} AS ratio FROM rg")
def q_density_ratio(spark, sf):
    return in_regions(spark, sf).select("event_id", "region", r(L.density_ratio(L.at(POINT), LOG_YIELDS), 8).alias("ratio"))


_R = sql_ratio(POINT)


def _terms(spark, sf):
    return L.region_terms(toy(spark, sf), in_regions(spark, sf), [POINT], LOG_YIELDS)


@query("q_incs_exact", views(_RG) + f"SELECT region, {rs(f'sum(w*(1-{_R}))')} AS shift FROM rg GROUP BY region")
def q_incs_exact(spark, sf):
    return _terms(spark, sf).select("region", r("shift").alias("shift"))


@query("q_log_term", views(_RG) + f"SELECT region, {rs(f'sum(wt*ln({_R}))')} AS log_term FROM rg GROUP BY region")
def q_log_term(spark, sf):
    return _terms(spark, sf).select("region", r("log_term").alias("log_term"))


@query("q_u_term", views(_RG) + f"SELECT region, {rs(f'-2*(sum(w*(1-{_R})) + sum(wt*ln({_R})))')} AS u FROM rg GROUP BY region")
def q_u_term(spark, sf):
    return _terms(spark, sf).select("region", r("u").alias("u"))


_GRID = "(" + " UNION ALL ".join(f"SELECT {i} AS point, " + ", ".join(f"({p[n]!r})::double AS {n}" for n in PARAMETERS) for i, p in enumerate(SCAN)) + ")"


@query("q_penalty", f"SELECT point, {rs('nu_bkg*nu_bkg + nu_tt*nu_tt + nu_diboson*nu_diboson + nu_tes*nu_tes + nu_met*nu_met')} AS penalty FROM {_GRID}")
def q_penalty(spark, sf):
    return spark.createDataFrame([(i, round(L.penalty(p, floating=("nu_jes",)), 6)) for i, p in enumerate(SCAN)], "point int, penalty double")


@query("q_poisson_obs", views(_PO) + f"SELECT region, {rs('observed')} AS observed, " + ", ".join(f"{rs(f's{i}')} AS s_{p}" for i, p in enumerate(PROCESSES)) + " FROM py")
def q_poisson_obs(spark, sf):
    return poisson_input(spark, sf).select("region", r("observed").alias("observed"), *(r(f"s_{p}").alias(f"s_{p}") for p in PROCESSES))


@query("q_poisson_term", views(_PO) + f"SELECT region, {rs(sql_poisson(POINT))} AS term FROM py")
def q_poisson_term(spark, sf):
    return poisson_input(spark, sf).select("region", r(L.poisson_term_column(L.at(POINT), LOG_YIELDS)).alias("term"))


_SCAN_CTE = (
    f"g AS {_GRID}, u AS (SELECT point, -2*(sum(w*(1-{sql_ratio(POINT, 'mu')})) + sum(wt*ln({sql_ratio(POINT, 'mu')}))) AS unbinned FROM rg, g GROUP BY point), "
    f"pt AS (SELECT point, sum({sql_poisson(POINT, 'mu')}) AS poisson FROM py, g GROUP BY point)"
)


@query(
    "q_nll_scan",
    views(_RG, _PO, _SCAN_CTE)
    + f"SELECT g.point, {rs('mu')} AS mu, {rs('unbinned', 5)} AS unbinned, {rs('poisson', 5)} AS poisson, {rs('nu_bkg*nu_bkg + nu_tt*nu_tt + nu_diboson*nu_diboson + nu_tes*nu_tes + nu_jes*nu_jes + nu_met*nu_met')} AS penalty, "
    f"{rs('unbinned + poisson + nu_bkg*nu_bkg + nu_tt*nu_tt + nu_diboson*nu_diboson + nu_tes*nu_tes + nu_jes*nu_jes + nu_met*nu_met', 5)} AS q FROM g JOIN u USING (point) JOIN pt USING (point)",
)
def q_nll_scan(spark, sf):
    out = L.scan_frame(toy(spark, sf), in_regions(spark, sf), poisson_input(spark, sf), SCAN, LOG_YIELDS)
    return out.select("point", r("mu").alias("mu"), r("unbinned", 5).alias("unbinned"), r("poisson", 5).alias("poisson"), r("penalty").alias("penalty"), r("q", 5).alias("q"))


@query("q_mu_scan", views(_RG, _PO, _SCAN_CTE) + f"SELECT {rs('mu')} AS mu, {rs('unbinned + poisson - min(unbinned + poisson) OVER ()', 5)} AS delta_q FROM g JOIN u USING (point) JOIN pt USING (point)")
def q_mu_scan(spark, sf):
    objective = L.Likelihood(toy(spark, sf), in_regions(spark, sf), LOG_YIELDS, poisson_input(spark, sf))
    q = objective(SCAN)
    return spark.createDataFrame([(round(p["mu"], 6), round(float(v - q.min()), 5)) for p, v in zip(SCAN, q, strict=True)], "mu double, delta_q double")


_SCAN_SQL = "sn AS (SELECT o_custkey % 40 AS k, avg(o_totalprice) AS q0 FROM orders GROUP BY k), sq AS (SELECT k::double/10.0::double AS mu, (k::double/10.0::double-1.9::double)*(k::double/10.0::double-1.9::double)*2.0::double AS q FROM sn)"


def _parabola(spark, sf):
    keys = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 40).alias("k")).distinct()
    mu = F.col("k").cast("double") / F.lit(10.0)
    return keys.select(mu.alias("mu"), ((mu - F.lit(1.9)) * (mu - F.lit(1.9)) * F.lit(2.0)).alias("q"))


@query("q_interval", f"WITH {_SCAN_SQL}, p AS (SELECT *, lead(mu) OVER (ORDER BY mu) AS mu1, lead(q) OVER (ORDER BY mu) AS q1 FROM sq) SELECT {rs('mu + (mu1-mu)*(q-1)/((q-1)-(q1-1))', 9)} AS mu FROM p WHERE (q-1)*(q1-1) < 0")
def q_interval(spark, sf):
    return fit.crossings_frame(_parabola(spark, sf)).select(r("mu", 9).alias("mu"))


_FIN = "f AS (SELECT event_id, w AS mu_hat, w - (event_id%9)/10.0::double AS low, w*3 + (event_id%7)/10.0::double AS high FROM ev), f2 AS (SELECT event_id, mu_hat - 1.045::double*(mu_hat-low) AS p16, mu_hat + 1.045::double*(high-mu_hat) AS p84 FROM f), f3 AS (SELECT event_id, CASE WHEN p16 < 0.1 THEN 0.09::double ELSE p16 END AS p16, CASE WHEN p84 > 3.0 THEN 3.01::double ELSE p84 END AS p84 FROM f2)"


@query("q_finalize_interval", views(_FIN) + f"SELECT event_id, {rs('p16')} AS p16, {rs('p84')} AS p84, {rs('(p84-p16)/2')} AS delta_mu FROM f3")
def q_finalize_interval(spark, sf):
    e, w = F.col("event_id"), F.col("weight")
    cols = fit.finalise_columns(w, w - (e % 9).cast("double") / F.lit(10.0), w * 3.0 + (e % 7).cast("double") / F.lit(10.0))
    return scored(spark, sf).select("event_id", *(r(c).alias(n) for n, c in cols.items()))


# -- cubes ---------------------------------------------------------------------------------------------------------------
_CUBE_REGION = "lowMT_VBFJet"
_PRODUCTS = {f"mono{k}": "*".join(c) for k, c in enumerate(MONOMIALS)}
_OFFSET = " + ".join(f"({x!r})::double*{m}" for x, m in zip(LOG_YIELD, _PRODUCTS, strict=True) if x)
_axis = lambda name, values: f"{name} AS (SELECT unnest([{', '.join(f'{v!r}::double' for v in values)}]) AS nu_{name}, unnest(range({len(values)})) AS {name}_i)"
_CELLS = (
    ", ".join(_axis(n, v) for n, v in zip(("tes", "jes", "met"), cubes.AXES, strict=True))
    + f", cells AS (SELECT CAST((tes_i*{len(cubes.AXES[1])} + jes_i)*{len(cubes.AXES[2])} + met_i AS INTEGER) AS cell, {', '.join(f'{v} AS {m}' for m, v in _PRODUCTS.items())} FROM tes, jes, met)"
)


def _exponent(i: int) -> str:
    """The exponent of process i of a row of sc at a row that has the monomials as columns."""
    return _OFFSET + "".join(f" + d{i}{k}*{m}" for k, m in enumerate(_PRODUCTS))


def _six_digits(value) -> tuple:
    """Exponent and six leading digits of a number, as integers that both sides agree on."""
    power = F.coalesce(F.floor(F.log10(F.abs(value))), F.lit(0)).cast("int")
    return power, F.round(value / F.pow(F.lit(10.0), power - 5)).cast("long")


@query(
    "q_csi_cube",
    views(_RG, _CELLS, "c AS (" + " UNION ALL ".join(f"SELECT '{p}' AS process, cell, sum(w*p{i}*(exp({_exponent(i)})-1)) AS v FROM (SELECT * FROM rg WHERE region = '{_CUBE_REGION}'), cells GROUP BY cell" for i, p in enumerate(PROCESSES)) + ")",
          "e AS (SELECT *, CAST(CASE WHEN v = 0 THEN 0 ELSE floor(log10(abs(v))) END AS INTEGER) AS power FROM c)")
    + "SELECT process, cell, power, CAST(round(v/pow(10.0::double, power - 5)) AS BIGINT) AS digits FROM e",
)
def q_csi_cube(spark, sf):
    """All 6,561 grid points of one region, all processes: six leading digits, as the values span many orders."""
    table = cubes.cube_table(in_regions(spark, sf).where(F.col("region") == _CUBE_REGION), LOG_YIELDS).where("cell >= 0")
    power, digits = _six_digits(F.col("value"))
    return table.select("process", "cell", power.alias("power"), digits.alias("digits"))


def _cubes(spark, sf) -> cubes.Cubes:
    """The interpolated cubes of all regions, by way of a written cube table."""
    return cubes.Cubes.of(cut(cubes.cube_table(in_regions(spark, sf), LOG_YIELDS)))


#: Digits in which interpolated and exact shifts agree: their difference is below 1e-5 of the shift between the grid points used here.
_NEAR = 2


@query("q_incs_param", views(_RG) + f"SELECT region, {rs(f'sum(w*(1-{_R}))', _NEAR)} AS shift FROM rg GROUP BY region")
def q_incs_param(spark, sf):
    """The shift of each region at a point off the grid, interpolated from its cubes; the SQL sums over the events."""
    found = _cubes(spark, sf)
    return spark.createDataFrame([(x, round(found.shift(x, POINT), _NEAR) + 0.0) for x in found.regions], "region string, shift double")


@query("q_ll_scan_compare", views(_RG, f"g AS {_GRID}, x AS (SELECT point, sum(w*(1-{sql_ratio(POINT, 'mu')})) AS v FROM rg, g GROUP BY point)") + f"SELECT point, {rs('v', 4)} AS exact, {rs('v', _NEAR)} AS from_cube FROM x")
def q_ll_scan_compare(spark, sf):
    """The inclusive shift along a scan, from the events and interpolated from cubes."""
    found, s = _cubes(spark, sf), in_regions(spark, sf)
    exact = L.region_terms(None, s, SCAN, LOG_YIELDS).groupBy("point").agg(F.sum("shift").alias("exact"))
    shifts = [(i, round(found.total(p), _NEAR) + 0.0) for i, p in enumerate(SCAN)]
    return spark.createDataFrame(shifts, "point int, from_cube double").join(exact, "point").select("point", r("exact", 4).alias("exact"), "from_cube")


# -- fits ----------------------------------------------------------------------------------------------------------------
def _objective(spark, sf, with_cubes: bool) -> L.Likelihood:
    """With cubes the simulation is read once, for them."""
    return L.Likelihood(toy(spark, sf), None if with_cubes else in_regions(spark, sf), LOG_YIELDS, poisson_input(spark, sf), cubes=_cubes(spark, sf) if with_cubes else None)


_HESSE, _STEP = {**POINT, "nu_met": 1.0}, 0.2


def _sql_hessian() -> str:
    """The stencil in SQL: every point once, with what it counts for in each second derivative."""
    points: dict[tuple, int] = {}
    terms = []

    def at(*moves: tuple[str, float]) -> int:
        p = dict(_HESSE)
        for name, by in moves:
            p[name] = p[name] + by
        return points.setdefault(tuple(p[n] for n in PARAMETERS), len(points))

    for i, a in enumerate(PARAMETERS):
        terms += [(a, a, at(*m), c / _STEP**2) for m, c in ((((a, _STEP),), 1.0), ((), -2.0), (((a, -_STEP),), 1.0))]
        for b in PARAMETERS[:i]:
            for x in (1, -1):
                for y in (1, -1):
                    k = at((a, x * _STEP), (b, y * _STEP))
                    terms += [(a, b, k, x * y / (4 * _STEP**2)), (b, a, k, x * y / (4 * _STEP**2))]
    norm = lambda p: "(" + (" + ".join(f"{n}*{math.log1p(RATE[n])!r}::double" for n in L.SCALED_BY[p]) or "0.0::double") + ")"
    column = lambda k: ", ".join(f"{p[k]!r}::double" for p in points)
    ratio = " + ".join(f"{'mu*' if p == 'htautau' else ''}p{i}*exp({norm(p)} + {_exponent(i)})" for i, p in enumerate(PROCESSES))
    scale = [f"{'mu*' if p == 'htautau' else ''}exp({norm(p)} + {_OFFSET})" for p in PROCESSES]
    flat = lambda k: ", ".join(repr(t[k]) if k < 3 else f"{t[k]!r}::double" for t in terms)
    return views(
        _RG,
        _PO,
        f"g0 AS (SELECT unnest(range({len(points)})) AS point, {', '.join(f'unnest([{column(k)}]) AS {n}' for k, n in enumerate(PARAMETERS))})",
        f"g AS (SELECT *, {', '.join(f'{v} AS {m}' for m, v in _PRODUCTS.items())} FROM g0)",
        f"u AS (SELECT point, -2*(sum(w*(1-rat)) + sum(wt*ln(rat))) AS q FROM (SELECT point, w, wt, {ratio} AS rat FROM rg, g) GROUP BY point)",
        f"v AS (SELECT point, sum(2*({' + '.join(f's{i}*({x} - 1)' for i, x in enumerate(scale))}) - 2*observed*ln(({' + '.join(f's{i}*{x}' for i, x in enumerate(scale))})/(s0+s1+s2+s3))) AS q FROM py, g GROUP BY point)",
        f"y AS (SELECT point, u.q + v.q + {' + '.join(f'{n}*{n}' for n in PARAMETERS if n != 'mu')} AS q FROM g JOIN u USING (point) JOIN v USING (point))",
        f"t AS (SELECT unnest([{flat(0)}]) AS a, unnest([{flat(1)}]) AS b, unnest([{flat(2)}]) AS point, unnest([{flat(3)}]) AS c)",
    ) + f"SELECT a, b, {rs('sum(c*q)', 3)} AS value FROM t JOIN y USING (point) GROUP BY a, b"


@query("q_hessian", _sql_hessian())
def q_hessian(spark, sf):
    h = fit.hessian(_objective(spark, sf, False), _HESSE, step=_STEP)
    return spark.createDataFrame([(a, b, round(float(h[i, j]), 3) + 0.0) for i, a in enumerate(PARAMETERS) for j, b in enumerate(PARAMETERS)], "a string, b string, value double")


#: Nuisances on which the toy has little to say start off their bounds.
START = {n: 1.0 if n == "mu" else 0.1 if n == "nu_met" else 0.0 for n in PARAMETERS}


@query("q_fit_interval")
def q_fit_interval(spark, sf):
    """Fit with cubes, scan and interval of a toy."""
    out = fit.predict_interval(_objective(spark, sf, True), START)
    return spark.createDataFrame([tuple(map(float, out.values()))], ", ".join(f"{k} double" for k in out))


#: Every step is a Spark job: minima to a thousandth of q are near enough here.
_NEAR_MINIMUM = {"tolerance": 1e-3}


@query("q_profile_scan")
def q_profile_scan(spark, sf):
    """q at 21 values of mu, all six nuisances minimised at each."""
    objective = _objective(spark, sf, True)
    best = fit.global_fit(objective, START, **_NEAR_MINIMUM)
    mu = best.values["mu"]
    rows = fit.profile_scan(objective, best, fit.scan_points(max(0.0, mu - 0.2), mu + 0.2, 21), **_NEAR_MINIMUM)
    return spark.createDataFrame([(float(m), float(q)) for m, q in rows], "mu double, delta_q double")


@query("q_impacts")
def q_impacts(spark, sf):
    """Per nuisance: where the profiled q has risen by 1 on both sides, and what mu does there. All twelve sides go in step."""
    names = [n for n in PARAMETERS if n != "mu"]
    objective = _objective(spark, sf, True)
    best = fit.global_fit(objective, START, **_NEAR_MINIMUM)
    found, _ = fit.impacts_of(objective, best, names, reach=0.02, **_NEAR_MINIMUM)
    keys = sorted(found[names[0]])
    return spark.createDataFrame([(n, *(float(found[n][k]) for k in keys)) for n in names], "nuisance string, " + ", ".join(f"{k} double" for k in keys))


@query("q_minos")
def q_minos(spark, sf):
    """The profiled interval of mu, both sides in step."""
    objective = _objective(spark, sf, True)
    best = fit.global_fit(objective, START, **_NEAR_MINIMUM)
    low, high = fit.minos(objective, best, reach=0.02, **_NEAR_MINIMUM)
    return spark.createDataFrame([(float(low), float(best.values["mu"]), float(high))], "low double, mu double, high double")


# Signal strengths of the closure test.
CLOSURE_MU = (0.1, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 3.0)
TOYS_EACH = 2


def closure_likelihood(spark, sf) -> toys.ToyLikelihood:
    truths = [toys.Truth(mu) for mu in CLOSURE_MU for _ in range(TOYS_EACH)]
    return toys.ToyLikelihood(in_regions(spark, sf), truths, ["event_id"], LOG_YIELDS, _cubes(spark, sf), scored(spark, sf))


@query("q_closure_fits")
def q_closure_fits(spark, sf):
    """Toys of twelve signal strengths fitted together: residual, interval and whether it covers; mu as a calibration trained on each other
    toy corrects it; score, width and coverage of all intervals."""
    objective = closure_likelihood(spark, sf)
    found, _ = fit.in_step(objective, [fit.toy_steps(START, {"toy": t}, **_NEAR_MINIMUM) for t in range(len(objective.truths))])
    fits = [{**f.values, "mu_true": t.mu, **interval} for t, (f, interval) in zip(objective.truths, found, strict=True)]
    correction = toys.calibration(fits[::TOYS_EACH])
    rows = [(i, f["mu_true"], f["mu"], calibrated_mu(correction, f["mu"], f["nu_jes"], f["nu_tes"], f["nu_met"]), f["p16"], f["p84"]) for i, f in enumerate(fits)]
    fitted = quality.closure(spark.createDataFrame([(i, *map(float, r)) for i, *r in rows], "toy int, mu_true double, mu_measured double, mu_calibrated double, mu_down double, mu_up double"))
    return fitted.join(F.broadcast(quality.coverage_score(fitted)))  # one row
