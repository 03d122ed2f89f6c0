"""The unbinned extended likelihood over a grid of parameter points, in one job for all points.

A scored event row has region, weight, label, class shares p_<process> and, per process, an array d_<process> of coefficients of the
shape monomials. density_ratio is a Column for one point. For a list of points events with the same shares and coefficients are added up
first, a batch of what is left is one matrix product for each process, and a task gives one vector of partial sums for each region: what moves is points x regions rows a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.numeric import dot, log1p_or_nan, total
from tessella.operators.alike import added, added_up
from tessella.operators.cubes import SCALED_BY, Cubes, Point, events_for, rate_factors, regions_of
from tessella.operators.selections import predicate, score_window
from tessella.operators.yields import monomial_columns, monomials
from tessella.schema import CODE, MONOMIALS, NORMS, PARAMETERS, POISSON_REGIONS, PROCESSES, RATE, SHAPES
from tessella.sources.scratch import cut


def at(point: Point) -> dict[str, Column]:
    return {name: F.lit(float(point.get(name, 1.0 if name == "mu" else 0.0))) for name in PARAMETERS}


def from_columns() -> dict[str, Column]:
    return {name: F.col(name) for name in PARAMETERS}


def with_points(rows: DataFrame, points: Iterable[Point]) -> DataFrame:
    """Each row once for each parameter point, with its number and parameters. A narrow step."""
    made = [F.struct(F.lit(i).alias("point"), *(v.alias(n) for n, v in at(p).items())) for i, p in enumerate(points)]
    return rows.select("*", F.inline(F.array(*made)))


def log_norm(process: str, parameters: dict[str, Column]) -> Column:
    return total([parameters[n] * math.log1p(RATE[n]) for n in SCALED_BY[process]]) if SCALED_BY[process] else F.lit(0.0)


def density_ratio(parameters: dict[str, Column], log_yields: dict[str, list[float]]) -> Column:
    """Density at the parameters over the nominal one. log_yields: per process the log-polynomial coefficients (missing: all 0)."""
    shapes = monomial_columns(columns=parameters)
    parts = []
    for p in PROCESSES:
        exponent = log_norm(p, parameters) + dot(log_yields.get(p, [0.0] * len(MONOMIALS)), shapes)
        exponent = exponent + total([F.col(f"d_{p}")[k] * m for k, m in enumerate(shapes)])
        part = F.col(f"p_{p}") * F.exp(exponent)
        parts.append(parameters["mu"] * part if p == "htautau" else part)
    return total(parts)


def asimov_weights(events: DataFrame, mu: float | None = None, nu_bkg: float | None = None, nu_tt: float | None = None, nu_diboson: float | None = None) -> DataFrame:
    """Weights of pseudodata: signal times mu, all other classes times (1 + a) ** nu, ttbar and diboson by their own on top."""
    label, factor = F.col("label"), F.lit(1.0)
    for rows, scale in (
        (label == CODE["htautau"], mu),
        (label != CODE["htautau"], None if nu_bkg is None else (1 + RATE["nu_bkg"]) ** nu_bkg),
        (label == CODE["ttbar"], None if nu_tt is None else (1 + RATE["nu_tt"]) ** nu_tt),
        (label == CODE["diboson"], None if nu_diboson is None else (1 + RATE["nu_diboson"]) ** nu_diboson),
    ):
        if scale is not None:
            factor = factor * F.when(rows, F.lit(float(scale))).otherwise(F.lit(1.0))
    return events.withColumn("weight", F.col("weight") * factor)


def sides(toy: DataFrame | None, simulation: DataFrame | None) -> DataFrame:
    """The rows of both, those of the toy marked by is_toy."""
    every = [events_for(df).withColumn("is_toy", F.lit(toys)) for df, toys in ((toy, True), (simulation, False)) if df is not None]
    return every[0] if len(every) == 1 else every[0].unionByName(every[1])


def region_terms(toy: DataFrame | None, simulation: DataFrame | None, points: list[Point], log_yields: dict[str, list[float]], *by: str) -> DataFrame:
    """(point, region, shift, log_term, u): the inclusive shift on simulation, the log term on the toy, and -2 times their sum.

    Both sides are added up in one pass over their union; a side that is None adds nothing. Regions without events have no row, which is
    a contribution of 0. A density ratio that is not positive makes its log term NaN. With ``by`` given ("point") sums go over the rest.
    """
    return terms_of(sides(toy, simulation), points, log_yields, *by)


def terms_of(both: DataFrame, points: list[Point], log_yields: dict[str, list[float]], *by: str) -> DataFrame:
    """region_terms of rows that have both sides."""
    by = by or ("point", "region")
    shape = np.array([monomials([p.get(n, 0.0) for n in SHAPES]) for p in points]).T  # monomials x points
    factors = [rate_factors(p) for p in points]
    scale = {p: np.array([f[p] for f in factors]) for p in PROCESSES}
    offset = {p: np.asarray(log_yields.get(p, [0.0] * len(MONOMIALS)), float) @ shape for p in PROCESSES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in added(batches, "weight"):
            names, number = regions_of(batch)
            weight, toys = batch.column("weight").to_numpy(), batch.column("is_toy").to_numpy(zero_copy_only=False)
            ratio = np.zeros((batch.num_rows, len(points)))
            for p in PROCESSES:
                d = batch.column(f"d_{p}").flatten().to_numpy().reshape(batch.num_rows, -1)
                ratio += batch.column(f"p_{p}").to_numpy()[:, None] * (scale[p] * np.exp(offset[p] + d @ shape))
            with np.errstate(divide="ignore", invalid="ignore"):
                log = np.where(ratio > 0, np.log(ratio), np.nan)
            for r, name in enumerate(names):
                out = sums.setdefault(name, np.zeros((2, len(points))))
                for side, values in ((0, 1.0 - ratio), (1, log)):
                    rows = (number == r) & (toys == bool(side))
                    out[side] += weight[rows] @ values[rows]
        for name, out in sums.items():
            columns = [pa.array(np.arange(len(points), dtype=np.int32)), pa.array([name] * len(points)), pa.array(out[0]), pa.array(out[1])]
            yield pa.RecordBatch.from_arrays(columns, ["point", "region", "shift", "log_term"])

    summed = both.mapInArrow(run, "point int, region string, shift double, log_term double").groupBy(*by)
    return summed.agg(F.sum("shift").alias("shift"), F.sum("log_term").alias("log_term")).withColumn("u", -2.0 * (F.col("shift") + F.col("log_term")))


def penalty(point: Point, floating: Iterable[str] = ()) -> float:
    return sum(point.get(n, 0.0) ** 2 for n in (*NORMS, *SHAPES) if n not in floating)


# -- Poisson regions -----------------------------------------------------------------------------------------------------
def in_poisson_region(name: str, regions=POISSON_REGIONS) -> Column:
    selection, windows = regions[name]
    condition = predicate(selection)
    for process, low, high in windows:
        condition = condition & score_window(process, low, high)
    return condition


def poisson_rows(events: DataFrame, regions=POISSON_REGIONS) -> DataFrame:
    """Events with the Poisson region they are in (column region); one scan for all regions (name -> selection and score windows)."""
    inside = F.array_compact(F.array(*(F.when(in_poisson_region(n, regions), F.lit(n)) for n in regions)))
    return events.withColumn("region", F.explode(inside))


def poisson_yields(events: DataFrame, observed: Column, regions=POISSON_REGIONS) -> DataFrame:
    """Per region: yield of each process, and the observation, which sums the given weight."""
    sums = [F.sum(F.when(F.col("label") == CODE[p], F.col("weight")).otherwise(0.0)).alias(f"s_{p}") for p in PROCESSES]
    return poisson_rows(events, regions).groupBy("region").agg(*sums, F.sum(observed).alias("observed"))


def poisson_term(point: Point, yields: dict[str, float], observed: float, log_yields: dict[str, list[float]]) -> float:
    """-2 log of the Poisson probability of the observation, over that at the nominal point."""
    factors, shape = rate_factors(point), np.array(monomials([point.get(s, 0.0) for s in SHAPES]))
    scale = {p: factors[p] * math.exp(float(np.dot(log_yields.get(p, np.zeros(len(shape))), shape))) for p in PROCESSES}
    every = sum(yields.values())
    expected = sum(scale[p] * yields[p] for p in PROCESSES)
    if every <= 0:
        return 0.0
    log = math.log(expected / every) if expected > 0 else -math.inf
    return 2 * sum(yields[p] * (scale[p] - 1) for p in PROCESSES) - (2 * observed * log if observed else 0.0)


def poisson_term_column(parameters: dict[str, Column], log_yields: dict[str, list[float]]) -> Column:
    """The same as a Column over rows of poisson_yields."""
    shapes = monomial_columns(columns=parameters)
    scale = {}
    for p in PROCESSES:
        exponent = log_norm(p, parameters) + dot(log_yields.get(p, [0.0] * len(MONOMIALS)), shapes)
        scale[p] = F.exp(exponent) * (parameters["mu"] if p == "htautau" else F.lit(1.0))
    every = total([F.col(f"s_{p}") for p in PROCESSES])
    shift = total([F.col(f"s_{p}") * (scale[p] - 1.0) for p in PROCESSES])
    return 2.0 * shift - 2.0 * F.col("observed") * log1p_or_nan(F.try_divide(total([scale[p] * F.col(f"s_{p}") for p in PROCESSES]), every) - 1.0)


# -- the objective -------------------------------------------------------------------------------------------------------
class Likelihood:
    """-2 log likelihood ratio as a function of parameter points. Each call evaluates all its points in one Spark job.

    toy and simulation are scored event rows with region. They are read once: calls go over a written table, in which rows that agree in
    region, shares and coefficients are one. With cubes the inclusive shift comes from them and the simulation is not read. A region
    without toy events still has its shift.
    """

    def __init__(self, toy: DataFrame, simulation: DataFrame | None, log_yields: dict[str, list[float]], poisson: DataFrame | None = None, floating: Iterable[str] = (), cubes: Cubes | None = None):
        if (simulation is None) == (cubes is None):
            raise ValueError("give either simulation or cubes")
        self.log_yields, self.floating, self.cubes = log_yields, tuple(floating), cubes
        self.events = cut(added_up(sides(toy, simulation), "weight"))
        rows = [] if poisson is None else poisson.collect()  # one row a Poisson region
        self.poisson = [({p: r[f"s_{p}"] for p in PROCESSES}, r["observed"]) for r in rows]

    def __call__(self, points: list[Point]) -> np.ndarray:
        terms = terms_of(self.events, points, self.log_yields, "point").collect()  # one row a point
        u = {r.point: r.u for r in terms}
        shift = -2.0 * self.cubes.totals(points) if self.cubes else np.zeros(len(points))
        return np.array([u.get(i, 0.0) + shift[i] + penalty(p, self.floating) + sum(poisson_term(p, y, n, self.log_yields) for y, n in self.poisson) for i, p in enumerate(points)])


def scan_frame(toy: DataFrame, simulation: DataFrame, poisson: DataFrame, points: list[Point], log_yields: dict[str, list[float]]) -> DataFrame:
    """(point, mu, unbinned, poisson, penalty, q) of each point as a DataFrame."""
    spark = toy.sparkSession
    grid = spark.createDataFrame([(i, float(p.get("mu", 1.0)), float(penalty(p))) for i, p in enumerate(points)], "point int, mu double, penalty double")
    unbinned = region_terms(toy, simulation, points, log_yields, "point").select("point", F.col("u").alias("unbinned"))
    counted = with_points(poisson, points).groupBy("point").agg(F.sum(poisson_term_column(from_columns(), log_yields)).alias("poisson"))
    zero = F.lit(0.0)
    joined = grid.join(unbinned, "point", "left").join(counted, "point", "left").na.fill(0.0, ["unbinned", "poisson"])
    return joined.withColumn("q", F.coalesce("unbinned", zero) + F.col("poisson") + F.col("penalty"))
