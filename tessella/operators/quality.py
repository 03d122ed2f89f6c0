"""How well scores and intervals do: ROC, calibration curves, coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.sources.scratch import cut

#: Share of a standard interval, and what is added to a width before its logarithm is taken (fixed values).
COVERAGE, WIDTH_EPSILON = 0.6827, 0.01


def roc_curve(scored: DataFrame, score: str, positive: Column) -> DataFrame:
    """(threshold, tpr, fpr), one row a distinct score, highest first, and the start at (0, 0) with a null threshold.

    Scores are counted before the running sums, so windows see distinct scores, split by ranges of them, not events.
    """
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    counted = scored.groupBy(F.col(score).alias("threshold")).agg(one(positive)("tp"), one(~positive)("fp"))
    summed = running_sums(counted, "threshold", ["tp", "fp"], descending=True)
    totals = F.broadcast(scored.agg(one(positive)("p"), one(~positive)("n")))  # one row
    curve = summed.join(totals).select("threshold", F.try_divide(F.col("run_tp"), F.col("p")).alias("tpr"), F.try_divide(F.col("run_fp"), F.col("n")).alias("fpr"))
    start = scored.sparkSession.range(1).select(F.lit(None).cast(counted.schema["threshold"].dataType).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return curve.unionByName(start)


def running_sums(rows: DataFrame, key: str, values: list[str], by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """rows with run_<value>, the sums within by up to and with a row, in the order of a key that is unique within by.

    Ranges of the key are sorted and summed on their own; each then adds the totals of the ranges before it. No window goes over all
    rows in one task. Totals and rows must agree on the ranges, so both come from one written table.
    """
    order = F.col(key).desc() if descending else F.col(key).asc()
    parts = cut(rows.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()))
    totals = parts.groupBy(*by, "__part").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    ahead = W.partitionBy(*by or (F.lit(1),)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    before = totals.select(*by, "__part", *(F.coalesce(F.sum(f"__{v}").over(ahead), F.lit(0)).alias(f"__{v}") for v in values))
    within = W.partitionBy("__part", *by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    joined = parts.withColumns({f"run_{v}": F.sum(v).over(within) for v in values}).join(before, [*by, "__part"])
    return joined.withColumns({f"run_{v}": F.col(f"run_{v}") + F.col(f"__{v}") for v in values}).drop("__part", *(f"__{v}" for v in values))


def auc(scored: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by trapezoids: of each score, its negatives times the positives above it and half of those at it."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    counted = scored.groupBy(F.col(score).alias("threshold")).agg(one(positive)("tp"), one(~positive)("fp"))
    summed = running_sums(counted, "threshold", ["tp"], descending=True)
    area = F.sum(F.col("fp").cast("double") * (F.col("run_tp") - F.col("tp") / 2.0))
    return summed.agg(F.try_divide(area, F.sum("tp").cast("double") * F.sum("fp").cast("double")).alias("auc"))


def calibration_curve(rows: DataFrame, score: str, target: str, weight: str = "weight", bins: int = 10) -> DataFrame:
    """(bin, true, pred): weighted share of the target and plain mean of the score, in equal bins from the lowest to the highest score.

    Bins are closed on both sides: a score on an inner edge counts in both bins. Empty bins give 0.
    """
    data = rows.select(F.col(score).alias("s"), F.col(target).cast("double").alias("y"), F.col(weight).alias("w"))
    span = F.broadcast(data.agg(F.min("s").alias("low"), F.max("s").alias("high")))  # one row
    edge = lambda k: F.col("low") + k * ((F.col("high") - F.col("low")) / bins)
    inside = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: (F.col("s") >= edge(k)) & (F.col("s") <= F.when(k == bins - 1, F.col("high")).otherwise(edge(k + 1))))
    filled = data.join(span).select("s", "y", "w", F.explode(inside).alias("bin"))
    true = F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w")) + F.lit(1e-16)
    found = filled.groupBy("bin").agg(true.alias("true"), F.avg("s").alias("pred"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("true", F.lit(0.0)).alias("true"), F.coalesce("pred", F.lit(0.0)).alias("pred"))


def coverage_penalty(coverage: Column, toys: Column) -> Column:
    """1 within two standard errors of the nominal coverage; steeper below than above."""
    sigma = F.sqrt(F.lit((1 - COVERAGE) * COVERAGE) / toys)
    low, high = F.lit(COVERAGE) - 2 * sigma, F.lit(COVERAGE) + 2 * sigma
    return F.when(coverage < low, 1 + F.pow((coverage - low) / sigma, 4)).when(coverage > high, 1 + F.pow((coverage - high) / sigma, 3)).otherwise(F.lit(1.0))


def coverage_score(intervals: DataFrame, true: str = "mu_true", low: str = "mu_down", high: str = "mu_up", toys: int | None = None) -> DataFrame:
    """score, width and coverage of intervals; an interval covers what lies strictly inside."""
    covered = (F.col(true) > F.col(low)) & (F.col(true) < F.col(high))
    row = intervals.agg(F.avg(F.col(high) - F.col(low)).alias("width"), F.avg(F.when(covered, 1.0).otherwise(0.0)).alias("coverage"), F.count("*").cast("double").alias("__n"))
    penalty = coverage_penalty(F.col("coverage"), F.lit(float(toys)) if toys else F.col("__n"))
    return row.select((-F.log((F.col("width") + WIDTH_EPSILON) * penalty)).alias("score"), "width", "coverage")


def closure(toys: DataFrame) -> DataFrame:
    """toys with residual, true minus measured."""
    return toys.withColumn("residual", F.col("mu_true") - F.col("mu_measured"))


def correlations(covariance) -> list[list[float]]:
    """Of a small covariance matrix (one row a fit parameter)."""
    n = len(covariance)
    return [[covariance[i][j] / math.sqrt(covariance[i][i] * covariance[j][j]) for j in range(n)] for i in range(n)]


def impacts(covariance) -> list[float]:
    """What one standard deviation of each parameter shifts the first by."""
    import numpy as np

    c = np.asarray(covariance, float)
    inverse = np.linalg.inv(c)
    return [float(-inverse[0, i] * math.sqrt(c[i, i]) / inverse[0, 0]) for i in range(len(c))]
