"""The inclusive shift as a function of the shape nuisances: sums on a grid of points, for every region and process, interpolated.

A cube is a table (region, process, cell, value) with one row a grid point. All regions and processes are filled in one pass over the
scored events: rows that share a region and a process's coefficients are added up in the task, a batch of what is left is one matrix
product for each process, and gives one vector of partial sums for each region in it.
Fits call the interpolated cubes and never come back to the simulation.
"""

from __future__ import annotations

import copy
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.alike import Added
from tessella.operators.spline import Cube
from tessella.operators.yields import monomials
from tessella.schema import MONOMIALS, PROCESSES, RATE, SHAPES

Point = dict[str, float]
#: Normalisations that scale each process beside mu.
SCALED_BY = {"htautau": (), "ztautau": ("nu_bkg",), "ttbar": ("nu_bkg", "nu_tt"), "diboson": ("nu_bkg", "nu_diboson")}
# The grid's axes.
SCALE_AXIS = (
    -10.0, -9.0, -8.0, -7.0, -6.0, -5.0, -4.0, -3.0, -2.5, -2.0, -1.5, -1.0, -0.5, 0.0,
    0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0,
)
MET_AXIS = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)
#: 27 x 27 x 9 points of nu_tes, nu_jes and nu_met.
AXES = (SCALE_AXIS, SCALE_AXIS, MET_AXIS)
#: Distinct events that are multiplied with the grid at once.
CHUNK = 250


def rate_factors(point: Point) -> dict[str, float]:
    """What mu and the normalisations multiply each process with."""
    out = {p: math.exp(sum(point.get(n, 0.0) * math.log1p(RATE[n]) for n in SCALED_BY[p])) for p in PROCESSES}
    return out | {"htautau": point.get("mu", 1.0)}


def interpolated_shift(point: Point, cubes: dict[str, float], constants: dict[str, float]) -> float:
    """The inclusive shift from cube values and constants per process at a point."""
    f = rate_factors(point)
    return -sum(f[p] * cubes[p] + (f[p] - 1.0) * constants[p] for p in PROCESSES)


def grid(axes=AXES) -> np.ndarray:
    """The points, the last axis running fastest."""
    return np.array(list(itertools.product(*axes)))


def events_for(scored: DataFrame) -> DataFrame:
    """What the sums need: region, weights of all processes and their coefficients; rows with a null among them add nothing and go."""
    needed = ["region", "weight", *(f"p_{p}" for p in PROCESSES), *(f"d_{p}" for p in PROCESSES)]
    return scored.select(*needed).dropna()


def weighted(batch: pa.RecordBatch, process: str) -> pa.RecordBatch:
    """Region, coefficients of a process, and weight times share, which adds up over rows that agree in the others."""
    w = batch.column("weight").to_numpy() * batch.column(f"p_{process}").to_numpy()
    return pa.RecordBatch.from_arrays([batch.column("region"), batch.column(f"d_{process}"), pa.array(w)], ["region", "d", "w"])


def regions_of(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """The regions of a batch and the number of each row's."""
    coded = batch.column("region").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def cube_table(scored: DataFrame, log_yields: dict[str, list[float]], axes=AXES) -> DataFrame:
    """(region, process, cell, value): sum of weight x share x (exp(L) - 1) at each grid point; cell -1 holds the sum of weight x share."""
    shape = np.array([monomials(g) for g in grid(axes)]).T  # monomials x grid
    offset = {p: np.asarray(log_yields.get(p, [0.0] * len(MONOMIALS)), float) @ shape for p in PROCESSES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        alike = {p: Added(("w",)) for p in PROCESSES}

        def fill(p: str, batch: pa.RecordBatch | None) -> None:
            if batch is None:
                return
            names, number = regions_of(batch)
            w, d = batch.column("w").to_numpy(), batch.column("d").flatten().to_numpy().reshape(batch.num_rows, -1)
            for r, name in enumerate(names):
                rows = np.flatnonzero(number == r)
                out = sums.setdefault((name, p), np.zeros(shape.shape[1] + 1))
                out[0] += w[rows].sum()
                for at in range(0, len(rows), CHUNK):
                    some = rows[at : at + CHUNK]
                    out[1:] += w[some] @ np.expm1(offset[p] + d[some] @ shape)

        for batch in batches:
            for p in PROCESSES:
                fill(p, alike[p].add(weighted(batch, p)))
        for p in PROCESSES:
            fill(p, alike[p].rest())
        for (name, p), out in sums.items():
            n = len(out)
            columns = [pa.array([name] * n), pa.array([p] * n), pa.array(np.arange(-1, n - 1, dtype=np.int32)), pa.array(out)]
            yield pa.RecordBatch.from_arrays(columns, ["region", "process", "cell", "part"])

    parts = events_for(scored).mapInArrow(run, "region string, process string, cell int, part double")
    return parts.groupBy("region", "process", "cell").agg(F.sum("part").alias("value"))


def write_cubes(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder a region, so that regions can be filled by different jobs."""
    table.write.mode(mode).partitionBy("region").parquet(path)


class Cubes:
    """The interpolated cubes of some regions, and the constants beside them."""

    def __init__(self, cubes: dict[tuple[str, str], Cube], constants: dict[tuple[str, str], float]):
        self.cubes, self.constants = cubes, constants
        self.regions = sorted({r for r, _ in cubes})

    @classmethod
    def of(cls, table: DataFrame, axes=AXES) -> Cubes:
        """From a cube table, which has one row a grid point, region and process, whatever the number of events."""
        cubes, constants, shape = {}, {}, [len(a) for a in axes]
        flat: dict[tuple[str, str], np.ndarray] = {}
        for r in table.toLocalIterator():
            flat.setdefault((r.region, r.process), np.full(int(np.prod(shape)) + 1, np.nan))[r.cell + 1] = r.value
        for key, values in flat.items():
            if np.isnan(values).any():
                raise ValueError(f"the cube of {key} lacks grid points")
            constants[key] = float(values[0])
            cubes[key] = Cube([np.array(a) for a in axes], values[1:].reshape(shape))
        return cls(cubes, constants)

    @classmethod
    def read(cls, spark: SparkSession, path: str, regions: Iterable[str] | None = None, axes=AXES) -> Cubes:
        table = spark.read.parquet(path)
        return cls.of(table if regions is None else table.where(F.col("region").isin(list(regions))), axes)

    def shift(self, region: str, point: Point) -> float:
        """The inclusive shift of a region at a point."""
        at = [point.get(n, 0.0) for n in SHAPES]
        values = {p: self.cubes[region, p](at) for p in PROCESSES}
        return interpolated_shift(point, values, {p: self.constants[region, p] for p in PROCESSES})

    def total(self, point: Point) -> float:
        return float(self.totals([point])[0])

    def totals(self, points: list[Point]) -> np.ndarray:
        """The inclusive shift of all regions together at each point. Cubes of a process add up before they are evaluated."""
        at = np.array([[p.get(n, 0.0) for n in SHAPES] for p in points])
        factors, out = [rate_factors(p) for p in points], np.zeros(len(points))
        for p in PROCESSES:
            cubes = [self.cubes[r, p] for r in self.regions]
            if not cubes:
                continue
            every = copy.copy(cubes[0])
            every.coefficients = np.sum([c.coefficients for c in cubes], axis=0)
            f = np.array([x[p] for x in factors])
            out -= f * every.many(at) + (f - 1.0) * sum(self.constants[r, p] for r in self.regions)
        return out
