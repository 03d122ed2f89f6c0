"""Weighted histograms. Many features, points or sums are filled in one pass over the events."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessella.functions.numeric import bin_of
from tessella.schema import BINNING


def histogram(rows: DataFrame, value: Column, bins: int, low: float, high: float, sums: dict[str, Column], *by: str) -> DataFrame:
    """(by, bin, sums): values outside the range are left out, empty bins do not appear."""
    return rows.withColumn("bin", bin_of(value, bins, low, high)).where("bin is not null").groupBy(*by, "bin").agg(*(F.sum(v).alias(n) for n, v in sums.items()))


def feature_histograms(events: DataFrame, features: Iterable[str] = tuple(BINNING), *by: str, weight: str = "weight") -> DataFrame:
    """(by, feature, bin, sum) of all features with their standard binning, in one pass.

    A batch of events fills all its histograms at once, and a task hands on one row for each of its bins; events are never multiplied.
    A null weight counts as 0.
    """
    features = list(features)
    rows = events.select(*by, F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("__w"), *(F.col(f).cast("double").alias(f"__{i}") for i, f in enumerate(features)))
    keys = [rows.schema[b] for b in by]
    schema = T.StructType([*keys, T.StructField("feature", T.StringType()), T.StructField("bin", T.IntegerType()), T.StructField("part", T.DoubleType())])
    cells = sum(BINNING[f][0] for f in features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups, code = _groups(batch, by)
            w = batch.column("__w").to_numpy()
            filled, begin = np.zeros((len(groups), 2, cells)), 0  # sums and counts
            for i, f in enumerate(features):
                bins, low, high = BINNING[f]
                x = batch.column(f"__{i}").to_numpy(zero_copy_only=False)
                here = np.flatnonzero((x >= low) & (x <= high))
                at = code[here] * bins + np.minimum(np.floor((x[here] - low) / ((high - low) / bins)).astype(np.int64), bins - 1)
                for k, values in enumerate((w[here], None)):
                    filled[:, k, begin : begin + bins] = np.bincount(at, values, len(groups) * bins).reshape(len(groups), bins)
                begin += bins
            for g, part in zip(groups, filled, strict=True):
                sums[g] = sums[g] + part if g in sums else part
        name = np.repeat(np.array(features, object), [BINNING[f][0] for f in features])
        number = np.concatenate([np.arange(BINNING[f][0], dtype=np.int32) for f in features])
        for g, (value, count) in sums.items():
            at = np.flatnonzero(count)
            columns = [pa.array([v] * len(at), t.type) for v, t in zip(g, to_arrow_schema(T.StructType(keys)), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(name[at], pa.string()), pa.array(number[at]), pa.array(value[at])], [*by, "feature", "bin", "part"])

    return rows.mapInArrow(run, schema).groupBy(*by, "feature", "bin").agg(F.sum("part").alias("sum"))


def _groups(batch: pa.RecordBatch, by: tuple[str, ...]) -> tuple[list[tuple], np.ndarray]:
    """The distinct keys of a batch, and which of them each row has."""
    code, values = np.zeros(batch.num_rows, np.int64), []
    for b in by:
        coded = batch.column(b).dictionary_encode(null_encoding="encode")
        values.append(coded.dictionary.to_pylist())
        code = code * len(values[-1]) + coded.indices.to_numpy()
    every, code = np.unique(code, return_inverse=True)
    groups = []
    for c in every.tolist():
        key = []
        for v in reversed(values):
            c, k = divmod(c, len(v))
            key.append(v[k])
        groups.append(tuple(reversed(key)))
    return groups, code


def rebin(hist: DataFrame, factor: int, *by: str, value: str = "sum") -> DataFrame:
    """Neighbouring bins added, factor at a time."""
    return hist.groupBy(*by, F.floor(F.col("bin") / factor).cast("int").alias("bin")).agg(F.sum(value).alias(value))


def normalised(hist: DataFrame, *by: str, value: str = "sum") -> DataFrame:
    """value over its sum within by; a sum of 0 counts as 1."""
    every = F.sum(value).over(W.partitionBy(*by))
    return hist.withColumn(value, F.col(value) / F.when(every == 0, 1.0).otherwise(every))


def ratio_to(hist: DataFrame, nominal: DataFrame, *by: str, value: str = "sum") -> DataFrame:
    """hist over the nominal histogram of the same (by, bin); 0 where that is not positive or missing."""
    base = nominal.select(*by, "bin", F.col(value).alias("__base"))
    return hist.join(base, [*by, "bin"], "left").withColumn("ratio", F.when(F.col("__base") > 0, F.col(value) / F.col("__base")).otherwise(0.0)).drop("__base")


def class_histograms(scored: DataFrame, feature: str, classes: Iterable[str]) -> DataFrame:
    """(bin, true_c and pred_c of each class): weights of a class's events, and weights times its score p_c."""
    classes = list(classes)
    sums = {f"true_{c}": F.when(F.col("label") == i, F.col("weight")).otherwise(0.0) for i, c in enumerate(classes)}
    sums |= {f"pred_{c}": F.col("weight") * F.col(f"p_{c}") for c in classes}
    return histogram(scored, F.col(feature).cast("double"), *BINNING[feature], sums)


def score_histograms(scored: DataFrame, classes: Iterable[str], bins: int = 30) -> DataFrame:
    """(predicted, label, bin, sum, share): each class score over 0 to 1 by true class; share is normalised within both."""
    cells = [F.struct(F.lit(c).alias("predicted"), bin_of(F.col(f"p_{c}"), bins, 0.0, 1.0).alias("bin")) for c in classes]
    filled = scored.select("label", "weight", F.inline(F.array(*cells))).where("bin is not null")
    hist = filled.groupBy("predicted", "label", "bin").agg(F.sum("weight").alias("sum"))
    return normalised(hist.withColumn("share", F.col("sum")), "predicted", "label", value="share")


def histogram_2d(rows: DataFrame, x: Column, y: Column, bins: int = 50) -> DataFrame:
    """(bin_x, bin_y, n) over the range that the values span; a range without width is one bin."""
    data = rows.select(x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    span = F.broadcast(data.agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max)))))  # one row
    wide = lambda c: F.col(f"high_{c}") - F.col(f"low_{c}")
    at = lambda c: F.when(wide(c) > 0, F.least(F.floor((F.col(c) - F.col(f"low_{c}")) / wide(c) * bins).cast("int"), F.lit(bins - 1))).otherwise(F.lit(0))
    return data.join(span).groupBy(at("x").alias("bin_x"), at("y").alias("bin_y")).agg(F.count("*").alias("n"))


def ratio_histograms(scored: DataFrame, ratio: Column, features: Iterable[str] = tuple(BINNING), *by: str, varied: str = "weight_varied") -> DataFrame:
    """(by, feature, bin, true_sum, predicted): varied weights, and nominal weights times a predicted ratio, e.g. of each base point."""
    features = list(features)
    both = scored.withColumn("__predicted", F.col("weight") * ratio)
    true = feature_histograms(both, features, *by, weight=varied).withColumnRenamed("sum", "true_sum")
    return true.join(feature_histograms(both, features, *by, weight="__predicted").withColumnRenamed("sum", "predicted"), [*by, "feature", "bin"], "full")
