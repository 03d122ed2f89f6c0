"""Row-wise models: small networks, trees, isotonic calibration, ratio nets and their losses.

Everything that can be a Column is one. Networks run batch by batch in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.numeric import below, dot, sigmoid, softplus, sure, total
from tessella.operators.quality import running_sums
from tessella.operators.yields import design, monomial_columns, standardised
from tessella.schema import PROCESSES

#: Calibrated scores stay this far from 0 and 1 (fixed value).
CLIP = 1e-6


# -- networks ------------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Network:
    """Dense layers (weights: inputs x outputs, bias), relu between them; output "softmax" or "linear". Inputs are standardised first."""

    features: tuple[str, ...]
    layers: tuple[tuple[list, list], ...]
    output: str = "softmax"
    mean: tuple[float, ...] = ()
    variance: tuple[float, ...] = ()
    scale: tuple[float, ...] = field(default=())

    def run(self, x: np.ndarray) -> np.ndarray:
        if self.mean:
            sd = np.sqrt(np.asarray(self.variance))
            x = np.divide(x - np.asarray(self.mean), sd, out=np.zeros_like(x), where=sd > 0)
        for i, (weights, bias) in enumerate(self.layers):
            x = x @ np.asarray(weights, float) + np.asarray(bias, float)
            if i < len(self.layers) - 1:
                x = np.maximum(x, 0)
        if self.output == "softmax":
            x = np.exp(x - x.max(axis=1, keepdims=True))
            x /= x.sum(axis=1, keepdims=True)
        return x / np.asarray(self.scale) if self.scale else x


def with_network(events: DataFrame, network: Network, name: str) -> DataFrame:
    """events with the network's outputs as an array column. ``scale`` divides them, as class weights do."""

    @F.pandas_udf("array<double>")
    def apply(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in columns:
            every = batch if isinstance(batch, tuple) else (batch,)  # a net of one feature gets its column alone
            yield pd.Series(list(network.run(np.column_stack([c.to_numpy(float) for c in every]))))

    return events.withColumn(name, apply(*(F.col(f).cast("double") for f in network.features)))


def with_class_scores(events: DataFrame, network: Network, classes: tuple[str, ...] = PROCESSES) -> DataFrame:
    scored = with_network(events, network, "__p")
    return scored.withColumns({f"p_{c}": F.col("__p")[i] for i, c in enumerate(classes)}).drop("__p")


def network_inputs(statistics: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Ten inputs: momenta, the missing momentum's angle and two masses standardised by (mean, variance); four differences of angles as
    they are."""
    norm = lambda c: standardised(F.col(c), *statistics[c])
    gap = lambda a, b: F.col(a) - F.col(b)
    return {
        "had_pt": norm("PRI_had_pt"), "lep_pt": norm("PRI_lep_pt"), "met": norm("PRI_met"), "met_phi": norm("PRI_met_phi"), "had_lep_eta": gap("PRI_had_eta", "PRI_lep_eta"),
        "had_lep_phi": gap("PRI_had_phi", "PRI_lep_phi"), "met_lep_phi": gap("PRI_met_phi", "PRI_lep_phi"), "met_had_phi": gap("PRI_met_phi", "PRI_had_phi"),
        "mt": norm("DER_mass_transverse_met_lep"), "mass_vis": norm("DER_mass_vis"),
    }


def learning_rate(epoch: Column, start: float, epochs: int, phase_out: int) -> Column:
    """Constant, then falling in a line to 0 over the last phase_out epochs."""
    if phase_out <= 0:
        return F.lit(start)
    left = (F.lit(float(epochs)) - epoch) / float(phase_out)
    return F.lit(start) * F.least(F.lit(1.0), left)


# -- class scores --------------------------------------------------------------------------------------------------------
def score_shares(scores: dict[str, Column]) -> dict[str, Column]:
    """Scores over their sum."""
    every = total(list(scores.values()))
    return {c: F.try_divide(p, every) for c, p in scores.items()}


def rescaled(scores: dict[str, Column], calibrated: Column, first: str = "htautau") -> dict[str, Column]:
    """The first score replaced by its calibrated value, the others scaled so that the sum stays."""
    k = F.try_divide(1 - calibrated, 1 - scores[first])
    return {c: calibrated if c == first else p * F.coalesce(k, F.lit(0.0)) for c, p in scores.items()}


def rescaled_multi(calibrated: dict[str, Column], first: str = "htautau") -> dict[str, Column]:
    """Each score calibrated on its own: the first stays, the others are scaled so that all sum to 1."""
    rest = total([p for c, p in calibrated.items() if c != first])
    k = F.try_divide(1 - calibrated[first], rest)
    return {c: p if c == first else p * F.coalesce(k, F.lit(0.0)) for c, p in calibrated.items()}


def fit_isotonic(rows: DataFrame, score: str, target: Column, weight: str = "weight"):
    """Weighted isotonic regression of the target on a score."""
    data = rows.select(F.col(score).cast("double").alias("score"), target.cast("double").alias("target"), F.col(weight).cast("double").alias("w"))
    return IsotonicRegression(featuresCol="score", labelCol="target", weightCol="w").fit(data)


def isotonic_column(model, score: Column) -> Column:
    """The fitted curve as a Column: linear between its points, constant beyond them, clipped to (CLIP, 1 - CLIP).

    Every point is written into the expression: for curves of few points. calibrate_isotonic has no such bound.
    """
    xs, ys = [float(x) for x in model.boundaries.toArray()], [float(y) for y in model.predictions.toArray()]
    if not xs:
        raise ValueError("no points")
    points = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("x2"), F.lit(d).alias("y2")) for a, b, c, d in zip(xs, ys, xs[1:], ys[1:], strict=False)))
    if len(xs) == 1:
        return F.lit(min(max(ys[0], CLIP), 1 - CLIP))
    inside = F.element_at(F.filter(points, lambda p: (score >= p["x"]) & (score <= p["x2"])), 1)
    line = inside["y"] + (inside["y2"] - inside["y"]) * F.when(inside["x2"] > inside["x"], (score - inside["x"]) / (inside["x2"] - inside["x"])).otherwise(0.0)
    value = F.when(score <= xs[0], F.lit(ys[0])).when(score >= xs[-1], F.lit(ys[-1])).otherwise(line)
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), value))


def calibrate_isotonic(rows: DataFrame, model, score: str, name: str = "calibrated") -> DataFrame:
    """rows with the same curve at a score, for any number of points: the model finds the interval of a row by binary search."""
    if not model._java_obj.boundaries().size():
        raise ValueError("no points")
    data = rows.withColumn("__score", F.col(score).cast("double"))
    value = model.transform(data, {model.featuresCol: "__score", model.predictionCol: "__value"})
    return value.withColumn(name, F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), F.col("__value")))).drop("__score", "__value")


#: Rows of a partition that boosting holds in memory and reads again for every level of every tree.
TRAIN_ROWS = 500_000


def dealt(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows in partitions of about ``most`` at most; as they are where there are enough partitions."""
    need = -(-rows.count() // (most or TRAIN_ROWS))
    return rows.repartition(need) if need > rows.rdd.getNumPartitions() else rows


def fit_residuals(rows: DataFrame, features: list[str], target: str = "residual", **options) -> GBTRegressionModel:
    """Boosted trees that predict what a measurement misses its true value by."""
    data = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(dealt(rows.select(*features, target)))
    return GBTRegressor(featuresCol="__x", labelCol=target, **{"maxIter": 50, "maxDepth": 4, "stepSize": 0.1, "seed": 42} | options).fit(data)


def predict_residuals(rows: DataFrame, features: list[str], model: GBTRegressionModel, name: str = "correction") -> DataFrame:
    data = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep").transform(rows)
    return model.transform(data).withColumnRenamed(model.getPredictionCol(), name).drop("__x")


# -- ratio nets ----------------------------------------------------------------------------------------------------------
def log_ratio_of(delta: str, columns: dict[str, Column] | None = None) -> Column:
    """Coefficients in an array column times the monomials of the nuisances."""
    return total([F.col(delta)[k] * m for k, m in enumerate(monomial_columns(columns=columns))])


def ratio(delta: str, bias: Column | float = 1.0) -> Column:
    return (bias if isinstance(bias, Column) else F.lit(float(bias))) * F.exp(log_ratio_of(delta))


def ratio_loss(log_r: Column, nominal: Column, varied: Column, bias: float = 1.0) -> Column:
    """Sum of the cross entropy between nominal and varied weights, 0 where the net says nothing."""
    return F.sum(nominal * softplus(log_r)) + F.sum(varied * softplus(-log_r)) / bias - math.log(2) * F.sum(nominal + varied)


def logistic_gradients(margin: Column, tag: Column) -> tuple[Column, Column, Column]:
    """loss, gradient and second derivative: log(1 + e^f) for tag 0, log(1 + e^-f) for tag 1."""
    p = sigmoid(margin)
    return F.when(tag == 0, softplus(margin)).otherwise(softplus(-margin)), F.when(tag == 0, p).otherwise(p - 1.0), p * (1.0 - p)


# -- trees ---------------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Leaf:
    value: tuple[float, ...]


@dataclass(frozen=True)
class Split:
    """left takes feature <= threshold; a null or NaN goes right, or left with missing_left."""

    feature: str
    threshold: float
    left: Split | Leaf
    right: Split | Leaf
    missing_left: bool = False

    def goes_left(self) -> Column:
        """Never null, so that its complement is all the rest."""
        x = F.col(self.feature).cast("double")
        known = below(x, self.threshold, True)
        return known | x.isNull() | sure(F.isnan(x)) if self.missing_left else known


def tree_column(node: Split | Leaf, k: int = 0) -> Column:
    """Component k of the tree's leaf value as nested conditions."""
    if isinstance(node, Leaf):
        return F.lit(float(node.value[k]))
    return F.when(node.goes_left(), tree_column(node.left, k)).otherwise(tree_column(node.right, k))


def ensemble(trees: list[Split | Leaf], rate: float, k: int = 0, n_trees: int | None = None, last_counts_full: bool = False) -> Column:
    """Sum of the trees times the learning rate; of the last tree in full if asked for."""
    used = trees[:n_trees]
    rates = [1.0 if last_counts_full and i == len(used) - 1 else rate for i in range(len(used))]
    return dot(rates, [tree_column(t, k) for t in used])


def boosted_weight(weight: Column, delta: list[Column], rate: float) -> Column:
    """The weight of an event at its base point once a tree has taken its share."""
    return weight * F.exp(-rate * total([d * m for d, m in zip(delta, monomial_columns(), strict=True)]))


def best_split(events: DataFrame, features: list[str], points: list[tuple[float, ...]], combinations, min_size: int = 1) -> DataFrame:
    """(feature, threshold, loss) of the best split of each feature, best first.

    events: features, weight and point (0 nominal, else the number of its base point). Weights and counts are added up by distinct
    value, so the running sums see values, not events. A split needs min_size events of every point on both sides; events without a value
    count on the right side.
    """
    n = len(points)
    mm = design(points, combinations)["MV"]
    cells = [F.struct(F.lit(f).alias("feature"), F.nanvl(F.col(f).cast("double"), F.lit(None)).alias("value")) for f in features]
    flat = events.select("weight", "point", F.inline(F.array(*cells)))
    at = lambda k, v: F.sum(F.when(F.col("point") == k, v).otherwise(0))
    names = [f"{x}{k}" for k in range(n) for x in "wc"]
    counted = flat.groupBy("feature", "value").agg(*(at(int(m[1:]), F.col("weight") if m[0] == "w" else F.lit(1)).alias(m) for m in names))
    summed = running_sums(counted.where("value is not null"), "value", names, by=("feature",))
    totals = counted.groupBy("feature").agg(*(F.sum(m).alias(f"all_{m}") for m in names), F.max("value").alias("last"))
    both = summed.join(F.broadcast(totals), "feature").where("value < last")  # one row a feature
    left, right = {m: F.col(f"run_{m}") for m in names}, {m: F.col(f"all_{m}") - F.col(f"run_{m}") for m in names}
    large = [side[f"c{k}"] >= min_size for side in (left, right) for k in range(n)]
    positive = [side[f"w{k}"] > 0 for side in (left, right) for k in range(n)]
    both = both.where(large[0] if len(large) == 1 else F.forall(F.array(*large, *positive), lambda x: x))

    def side_loss(side: dict[str, Column]) -> Column:
        logs = [F.log(side[f"w{k}"] / side["w0"]) for k in range(1, n)]
        out = F.lit(0.0)
        for k in range(1, n):
            x = dot(list(mm[k - 1]), logs)
            out = out + side["w0"] * (softplus(x) - math.log(2)) + side[f"w{k}"] * (softplus(-x) - math.log(2))
        return out

    scored = both.select("feature", F.col("value").alias("threshold"), (side_loss(left) + side_loss(right)).alias("loss"))
    best = scored.groupBy("feature").agg(F.min(F.struct(F.round("loss", 9).alias("loss"), "threshold")).alias("b"))
    return best.select("feature", "b.threshold", "b.loss").orderBy("loss", "feature")


def grow_tree(events: DataFrame, features: list[str], points: list[tuple[float, ...]], combinations, depth: int, min_size: int) -> Split | Leaf:
    """A tree of best splits; a leaf holds the log-polynomial coefficients of its yields. The driver sees yields and splits only."""
    d = design(points, combinations)
    sums = {r.point: (r.w, r.c) for r in events.groupBy("point").agg(F.sum("weight").alias("w"), F.count("*").alias("c")).collect()}  # one row a point
    w = [float(sums.get(k, (0.0, 0))[0]) for k in range(len(points))]
    counts = [sums.get(k, (0.0, 0))[1] for k in range(len(points))]
    value = d["M"].T @ np.log(np.array(w[1:]) / w[0]) if min(w) > 0 else np.zeros(len(combinations))
    leaf = Leaf(tuple(float(x) for x in value))
    if depth == 0 or min(counts) < 2 * min_size:
        return leaf
    best = best_split(events, features, points, combinations, min_size).first()
    if best is None:
        return leaf
    left = Split(best.feature, float(best.threshold), leaf, leaf).goes_left()
    grow = lambda part: grow_tree(part, features, points, combinations, depth - 1, min_size)
    return Split(best.feature, float(best.threshold), grow(events.where(left)), grow(events.where(~left)))
