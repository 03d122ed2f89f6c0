"""Weighted yields, feature statistics, and yields as log-polynomials of the nuisances."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.numeric import dot
from tessella.schema import BASE_POINTS, CODE, MONOMIALS, NOMINAL, SHAPES


def weight_sum(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight_sum"), F.count("*").alias("n"))


def class_yields(events: DataFrame, *by: str) -> DataFrame:
    """Per class (and by): sum of weights and number of events."""
    return events.groupBy(*by, "label").agg(F.sum("weight").alias("yield"), F.count("*").alias("n"))


def signal_over_background(events: DataFrame, *by: str) -> DataFrame:
    part = lambda rows: F.sum(F.when(rows, F.col("weight")).otherwise(0.0))
    signal = F.col("label") == CODE["htautau"]
    return events.groupBy(*by).agg(F.try_divide(part(signal), part(~signal)).alias("s_over_b"))


def yield_of(yields: DataFrame, process: str | int) -> float:
    """One yield by name or code."""
    if process not in CODE and process not in CODE.values():
        raise RuntimeError(f"unknown process {process}")
    row = yields.where(F.col("label") == CODE.get(process, process)).first()
    return row["yield"] if row else 0.0


def class_weights(yields: DataFrame) -> DataFrame:
    """(label, class_weight): total yield over the class's."""
    every = F.sum("yield").over(W.partitionBy(F.lit(1)))  # one row a class
    return yields.select("label", F.try_divide(every, F.col("yield")).alias("class_weight"))


def balance_classes(events: DataFrame) -> DataFrame:
    """Weights times the class weight, so that all classes weigh the same."""
    factors = F.broadcast(class_weights(class_yields(events)))  # one row a class
    return events.join(factors, "label").withColumn("weight", F.col("weight") * F.col("class_weight")).drop("class_weight")


def feature_statistics(events: DataFrame, features: Iterable[str]) -> DataFrame:
    """(feature, mean, variance) without weights; the variance of the population. All features in one pass."""
    features = list(features)
    value = lambda f: F.col(f).cast("double")
    row = events.agg(*(x for f in features for x in (F.avg(value(f)).alias(f"{f}__m"), F.var_pop(value(f)).alias(f"{f}__v"))))
    each = [F.struct(F.lit(f).alias("feature"), F.col(f"{f}__m").alias("mean"), F.col(f"{f}__v").alias("variance")) for f in features]
    return row.select(F.inline(F.array(*each)))


def standardised(value: Column, mean: float, variance: float) -> Column:
    """0 where the variance is 0."""
    return (value - mean) / float(np.sqrt(variance)) if variance > 0 else value * 0.0


# -- log-polynomials -----------------------------------------------------------------------------------------------------
def monomials(point: Iterable[float], combinations=MONOMIALS) -> list[float]:
    at = dict(zip(SHAPES, point, strict=True))
    return [float(np.prod([at[name] for name in c])) for c in combinations]


def monomial_columns(combinations=MONOMIALS, columns: dict[str, Column] | None = None) -> list[Column]:
    """The products as Columns, of nu_tes, nu_jes, nu_met by default."""
    columns = columns or {name: F.col(name) for name in SHAPES}
    out = []
    for c in combinations:
        product = columns[c[0]]
        for name in c[1:]:
            product = product * columns[name]
        out.append(product)
    return out


def design(points=BASE_POINTS, combinations=MONOMIALS) -> dict[str, np.ndarray]:
    """Matrices of the fit: V (points x monomials), C = V'V, its inverse, M = V C^-1 and MV = M V'."""
    v = np.array([monomials(p, combinations) for p in points if tuple(p) != NOMINAL])
    c = v.T @ v
    if np.linalg.matrix_rank(c) < len(combinations):
        raise ValueError("the base points do not determine all coefficients")
    inverse = np.linalg.inv(c)
    return {"V": v, "C": c, "C_inverse": inverse, "M": v @ inverse, "MV": v @ inverse @ v.T}


def yields_by_point(events: DataFrame) -> DataFrame:
    """Per (process label and) base point: yield. events: nu_tes, nu_jes, nu_met, weight."""
    return events.groupBy(*SHAPES).agg(F.sum("weight").alias("yield"))


def fit_log_polynomial(yields: dict[tuple[float, ...], float], combinations=MONOMIALS) -> np.ndarray:
    """Coefficients of log(yield / nominal yield) by least squares over the points that are not nominal. A few numbers: driver-side."""
    if NOMINAL not in yields:
        raise ValueError("the nominal point is missing")
    points = [p for p in yields if p != NOMINAL]
    d = design(points, combinations)
    return d["C_inverse"] @ d["V"].T @ np.log(np.array([yields[p] for p in points]) / yields[NOMINAL])


def fit_yields(table: DataFrame, combinations=MONOMIALS) -> np.ndarray:
    """The same from a (nu_tes, nu_jes, nu_met, yield) table of base points, which is a table of dozens of rows."""
    rows = table.select(*SHAPES, "yield").collect()
    return fit_log_polynomial({tuple(float(r[s]) for s in SHAPES): float(r["yield"]) for r in rows}, combinations)


def log_ratio(coefficients: Iterable[float], combinations=MONOMIALS, columns: dict[str, Column] | None = None) -> Column:
    """log(yield(nu) / yield(0)); exp of it is the ratio."""
    return dot(list(coefficients), monomial_columns(combinations, columns))


def base_point_table(spark: SparkSession, points=BASE_POINTS) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, nu_tes double, nu_jes double, nu_met double")


def with_base_points(events: DataFrame, points=BASE_POINTS) -> DataFrame:
    """Every event once for each base point other than the nominal one, with point number i and the point's columns: the nominal
    counterpart of varied events. A narrow step."""
    rows = [F.struct(F.lit(i).alias("i"), *(F.lit(x).alias(s) for s, x in zip(SHAPES, p, strict=True))) for i, p in enumerate(points) if p != NOMINAL]
    return events.select("*", F.inline(F.array(*rows)))
