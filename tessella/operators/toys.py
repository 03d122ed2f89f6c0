"""Many toys at once: replicates of the simulation as columns of weights, and a likelihood whose points name their toy.

A toy is a Poisson number for each event, drawn by the event's key, so that toys of all signal strengths come from one pass and no event is
repeated. Events with the same shares and coefficients are added up, their numbers with them. A call evaluates the points of all toys in
one job over one table; each fit keeps its own optimiser state on the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.alike import added_up
from tessella.operators.cubes import Cubes, Point, rate_factors
from tessella.operators.likelihood import penalty, poisson_rows, poisson_term
from tessella.operators.resampling import SEED, with_replicates
from tessella.operators.spline import RadialBasis
from tessella.operators.yields import monomials
from tessella.schema import CODE, MONOMIALS, POISSON_REGIONS, PROCESSES, RATE, SHAPES
from tessella.sources.scratch import cut

#: Ratios of a batch that are held at once.
CELLS = 1 << 21


@dataclass(frozen=True)
class Truth:
    """What a toy is made with."""

    mu: float = 1.0
    nu_bkg: float = 0.0
    nu_tt: float = 0.0
    nu_diboson: float = 0.0

    def scale(self) -> Column:
        """Of an event's weight, by its label."""
        background, out = (1 + RATE["nu_bkg"]) ** self.nu_bkg, F.lit(1.0)
        for process, s in (("htautau", self.mu), ("ztautau", background), ("ttbar", background * (1 + RATE["nu_tt"]) ** self.nu_tt), ("diboson", background * (1 + RATE["nu_diboson"]) ** self.nu_diboson)):
            out = F.when(F.col("label") == CODE[process], F.lit(float(s))).otherwise(out)
        return out


def draw_toys(events: DataFrame, truths: list[Truth], key: list[str], seed: int = SEED) -> DataFrame:
    """events with an array column toys: how often each toy has the event."""
    return with_replicates(events, "toys", [F.col("weight") * t.scale() for t in truths], seed, key)


class ToyLikelihood:
    """-2 log likelihood ratio of points that name their toy by the key "toy". Each call is one job, whatever toys it asks for.

    simulation: scored rows of the unbinned regions, with key columns. cubes: the inclusive shift, as it does not depend on the toy.
    poisson_events: scored rows, from which the Poisson regions' yields and each toy's counts are taken, once.
    """

    def __init__(self, simulation: DataFrame, truths: list[Truth], key: list[str], log_yields: dict[str, list[float]], cubes: Cubes, poisson_events: DataFrame | None = None, seed: int = SEED, floating: Iterable[str] = (), regions=POISSON_REGIONS):
        self.log_yields, self.cubes, self.floating, self.truths = log_yields, cubes, tuple(floating), truths
        columns = [*(f"p_{p}" for p in PROCESSES), *(f"d_{p}" for p in PROCESSES)]
        toys = draw_toys(simulation.select(*key, "label", "weight", *columns).dropna(), truths, key, seed).select("toys", *columns)
        drawn = toys.where(F.exists("toys", lambda n: n > 0)).withColumn("toys", F.col("toys").cast("array<long>"))
        self.table = cut(added_up(drawn, "toys"))
        self.poisson: list[tuple[dict[str, float], list[float]]] = []
        if poisson_events is not None:
            rows = draw_toys(poisson_rows(poisson_events, regions).select(*key, "region", "label", "weight"), truths, key, seed)
            sums = [F.sum(F.when(F.col("label") == CODE[p], F.col("weight")).otherwise(0.0)).alias(f"s_{p}") for p in PROCESSES]
            counts = [F.sum(F.col("toys")[k]).cast("double").alias(f"n_{k}") for k in range(len(truths))]
            for r in rows.groupBy("region").agg(*sums, *counts).collect():  # one row a Poisson region
                self.poisson.append(({p: r[f"s_{p}"] for p in PROCESSES}, [r[f"n_{k}"] for k in range(len(truths))]))

    def __call__(self, points: list[Point]) -> np.ndarray:
        logs, shifts = self.log_terms(points), self.cubes.totals(points)
        out = np.empty(len(points))
        for i, p in enumerate(points):
            counted = sum(poisson_term(p, yields, n[int(p["toy"])], self.log_yields) for yields, n in self.poisson)
            out[i] = -2.0 * (shifts[i] + logs[i]) + penalty(p, self.floating) + counted
        return out

    def log_terms(self, points: list[Point]) -> np.ndarray:
        """Sum of n log ratio over a toy's events, at each point; NaN if a ratio that counts is not positive."""
        shape = np.array([monomials([p.get(n, 0.0) for n in SHAPES]) for p in points]).T
        factors = [rate_factors(p) for p in points]
        scale = {p: np.array([f[p] for f in factors]) for p in PROCESSES}
        offset = {p: np.asarray(self.log_yields.get(p, [0.0] * len(MONOMIALS)), float) @ shape for p in PROCESSES}
        of = defaultdict(list)
        for i, p in enumerate(points):
            of[int(p["toy"])].append(i)
        toys, width, n_toys = {t: np.array(x) for t, x in of.items()}, len(points), len(self.truths)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(width)
            for whole in batches:
                for at in range(0, whole.num_rows, max(1, CELLS // width)):
                    batch = whole.slice(at, max(1, CELLS // width))
                    n = batch.column("toys").flatten().to_numpy().reshape(batch.num_rows, n_toys)
                    ratio = np.zeros((batch.num_rows, width))
                    for p in PROCESSES:
                        d = batch.column(f"d_{p}").flatten().to_numpy().reshape(batch.num_rows, -1)
                        ratio += batch.column(f"p_{p}").to_numpy()[:, None] * (scale[p] * np.exp(offset[p] + d @ shape))
                    bad = ratio <= 0
                    log = np.log(np.where(bad, 1.0, ratio))
                    for t, columns in toys.items():
                        sums[columns] += n[:, t] @ log[:, columns]
                        if bad.any():
                            sums[columns] += np.where((n[:, t] > 0) @ bad[:, columns], np.nan, 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(sums)], ["point", "part"])

        out = np.zeros(width)
        for r in self.table.mapInArrow(run, "point int, part double").groupBy("point").agg(F.sum("part").alias("s")).collect():  # one row a point
            out[r.point] = r.s
        return out


def calibration(fits: list[dict[str, float]]) -> RadialBasis:
    """What a fitted mu misses, as a function of where the fit ended. fits: mu_true, mu, nu_jes, nu_tes, nu_met."""
    at = np.array([[f["mu"], f["nu_jes"], f["nu_tes"], f["nu_met"]] for f in fits])
    return RadialBasis(at, np.array([f["mu_true"] - f["mu"] for f in fits]))
