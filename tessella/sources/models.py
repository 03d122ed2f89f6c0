"""Saving and loading of models and statistics as JSON, and trees from another library's saved ensemble.

A model is one JSON object {"kind", ...} in a text file that Spark writes, so any file system of the cluster takes it. What is stored is
numbers and names only: nothing of it is run when it is read.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.numeric import total
from tessella.operators.scoring import CLIP, Leaf, Network, Split, score_shares, tree_column
from tessella.plans.fit import Fit


@dataclass(frozen=True)
class Curve:
    """Points of a calibration curve, linear between them and constant beyond."""

    x: tuple[float, ...]
    y: tuple[float, ...]

    @classmethod
    def of(cls, model) -> Curve:
        """Of a fitted isotonic regression."""
        return cls(tuple(map(float, model.boundaries.toArray())), tuple(map(float, model.predictions.toArray())))

    def __call__(self, rows: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
        """rows with the clipped value at a score. Each batch is one binary search in the points."""
        x, y = np.array(self.x), np.array(self.y)

        @F.pandas_udf("double")
        def at(scores: pd.Series) -> pd.Series:
            return pd.Series(np.clip(np.interp(scores.to_numpy(float), x, y), CLIP, 1 - CLIP))

        return rows.withColumn(name, F.when(F.col(score).isNotNull(), at(F.col(score).cast("double"))))


@dataclass(frozen=True)
class Table:
    """Named numbers: yields by class, statistics by feature, coefficients by monomial."""

    columns: tuple[str, ...]
    rows: tuple[tuple, ...]

    @classmethod
    def of(cls, df: DataFrame) -> Table:
        """Of a table of a few rows: one a class, a feature or a monomial."""
        return cls(tuple(df.columns), tuple(sorted((tuple(r) for r in df.collect()), key=repr)))

    def __str__(self) -> str:
        """As text, columns under one another."""
        shown = [self.columns, *([f"{v:.6g}" if isinstance(v, float) else str(v) for v in r] for r in self.rows)]
        widths = [max(len(r[i]) for r in shown) for i in range(len(self.columns))]
        return "\n".join("  ".join(v.ljust(w) if k == 0 else v.rjust(w) for k, (v, w) in enumerate(zip(r, widths, strict=True))).rstrip() for r in shown)


def _node(tree: Split | Leaf) -> dict:
    if isinstance(tree, Leaf):
        return {"value": list(tree.value)}
    return {"feature": tree.feature, "threshold": tree.threshold, "missing_left": tree.missing_left, "left": _node(tree.left), "right": _node(tree.right)}


def _tree(node: dict) -> Split | Leaf:
    if "value" in node:
        return Leaf(tuple(node["value"]))
    return Split(node["feature"], node["threshold"], _tree(node["left"]), _tree(node["right"]), node["missing_left"])


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


def to_json(model) -> str:
    """A Network, a tree or list of trees, a Curve, a Table or a Fit."""
    if isinstance(model, Network):
        body = {"kind": "network", **{k: getattr(model, k) for k in ("features", "layers", "output", "mean", "variance", "scale")}}
    elif isinstance(model, Split | Leaf):
        body = {"kind": "tree", "tree": _node(model)}
    elif isinstance(model, list):
        body = {"kind": "trees", "trees": [_node(t) for t in model]}
    elif isinstance(model, Curve):
        body = {"kind": "curve", "x": model.x, "y": model.y}
    elif isinstance(model, Table):
        body = {"kind": "table", "columns": model.columns, "rows": model.rows}
    elif isinstance(model, Fit):
        body = {"kind": "fit", "values": model.values, "q": model.q, "calls": model.calls, "names": model.names, "covariance": None if model.covariance is None else model.covariance.tolist()}
    else:
        raise TypeError(f"{type(model).__name__} is not stored")
    return json.dumps(body)


def from_json(text: str):
    body = json.loads(text)
    kind = body.pop("kind")
    if kind == "network":
        return Network(**{k: v if k == "output" else _tuples(v) for k, v in body.items()})
    if kind == "tree":
        return _tree(body["tree"])
    if kind == "trees":
        return [_tree(t) for t in body["trees"]]
    if kind == "curve":
        return Curve(tuple(body["x"]), tuple(body["y"]))
    if kind == "table":
        return Table(tuple(body["columns"]), _tuples(body["rows"]))
    if kind == "fit":
        return Fit(body["values"], body["q"], None if body["covariance"] is None else np.array(body["covariance"]), body["calls"], tuple(body["names"]))
    raise ValueError(f"unknown kind {kind}")


def save(spark: SparkSession, model, path: str, mode: str = "overwrite") -> None:
    spark.createDataFrame([(to_json(model),)], "value string").coalesce(1).write.mode(mode).text(path)


def load(spark: SparkSession, path: str):
    return from_json(spark.read.text(path).first().value)


# -- boosted trees of another library ------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Ensemble:
    """Boosted trees, a list for each class, and the margin that each class starts at."""

    trees: tuple[tuple[Split | Leaf, ...], ...]
    base: tuple[float, ...]

    def margins(self) -> list[Column]:
        return [total([F.lit(b), *(tree_column(t) for t in trees)]) for trees, b in zip(self.trees, self.base, strict=True)]

    def scores(self, classes: tuple[str, ...]) -> dict[str, Column]:
        """Class shares by softmax."""
        margins = self.margins()
        top = F.greatest(*margins) if len(margins) > 1 else margins[0]
        return score_shares({c: F.exp(m - top) for c, m in zip(classes, margins, strict=True)})


def read_ensemble(text: str, features: list[str] | None = None) -> Ensemble:
    """Of the JSON in which gradient boosting libraries of the "learner / gradient_booster" format save a model.

    There a value strictly below the condition, both as 32-bit numbers, goes left; here a value up to the number before it does.
    ``features`` names the columns where the file does not.
    """
    learner = json.loads(text)["learner"]
    names = features or learner.get("feature_names") or []
    model = learner["gradient_booster"]["model"]
    classes = max(1, int(learner["learner_model_param"].get("num_class", 0)))
    start = learner["learner_model_param"].get("base_score", "0")
    start = [float(x) for x in str(start).strip("[]").split(",")]
    every: list[list[Split | Leaf]] = [[] for _ in range(classes)]
    for tree, at in zip(model["trees"], model["tree_info"], strict=True):
        every[int(at)].append(_grown(tree, names, 0))
    return Ensemble(tuple(map(tuple, every)), tuple(start * classes if len(start) == 1 else start))


def _grown(tree: dict, names: list[str], k: int) -> Split | Leaf:
    left, right, condition = int(tree["left_children"][k]), int(tree["right_children"][k]), float(tree["split_conditions"][k])
    if left < 0:
        return Leaf((condition,))
    feature = names[int(tree["split_indices"][k])] if names else f"f{int(tree['split_indices'][k])}"
    before = float(np.nextafter(np.float32(condition), np.float32(-math.inf)))
    return Split(feature, before, _grown(tree, names, left), _grown(tree, names, right), bool(int(tree["default_left"][k])))
