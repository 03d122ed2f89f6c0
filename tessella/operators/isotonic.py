"""Weighted isotonic regression without a pass over all scores in one place.

Scores are counted by distinct value and pooled range by range: neighbours whose means fall are put together until none falls. What is left
of a range are its blocks. Then neighbouring ranges are put together and pooled on, until no range starts below the end of the one before
it; whatever the order of pooling, the blocks are those of the regression. The driver sees two numbers a range.

The curve goes in a line from block to block, is flat within a block and beyond the ends, and is clipped as scores are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.scoring import CLIP
from tessella.sources.scratch import cut

_BLOCK = "part int, first double, last double, w double, wy double"
#: Blocks of a curve that are broadcast; a longer curve is joined by ranges.
BROADCAST_BLOCKS = 200_000


class _Pool:
    """Blocks so far; a new one takes in those before it whose mean is not below its own."""

    def __init__(self):
        self.blocks: list[list[float]] = []

    def add(self, first: float, last: float, w: float, wy: float) -> None:
        block = [first, last, w, wy]
        while self.blocks and self.blocks[-1][3] * block[2] >= block[3] * self.blocks[-1][2]:
            before = self.blocks.pop()
            block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
        self.blocks.append(block)


def _pooled(part_of):
    """Rows come sorted by (part, first): the blocks of each part. part_of(batch) gives the parts of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pool = None, _Pool()

        def packed() -> pa.RecordBatch:
            values = np.array(pool.blocks)
            return pa.RecordBatch.from_arrays([pa.array([at] * len(values), pa.int32()), *(pa.array(values[:, k]) for k in range(4))], [c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for part, *row in zip(part_of(batch), *(batch.column(c).to_pylist() for c in ("first", "last", "w", "wy")), strict=True):
                if part != at:
                    if pool.blocks:
                        yield packed()
                    at, pool = part, _Pool()
                pool.add(*row)
        if pool.blocks:
            yield packed()

    return run


def fit(rows: DataFrame, score: str, target: Column, weight: str = "weight") -> DataFrame:
    """The written curve (part, first, last, w, wy): blocks in order, with the sums of weights and of weights times target."""
    x, w = F.col(score).cast("double"), F.col(weight).cast("double")
    given = rows.where(x.isNotNull() & ~F.isnan(x) & (w > 0)).select(x.alias("first"), w.alias("w"), (w * target.cast("double")).alias("wy"))
    counted = given.groupBy("first").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy")).withColumn("last", F.col("first"))
    here = lambda batch: [TaskContext.get().partitionId()] * batch.num_rows
    blocks = cut(counted.repartitionByRange("first").sortWithinPartitions("first").mapInArrow(_pooled(here), _BLOCK))
    while True:
        mean = F.col("wy") / F.col("w")
        ends = blocks.groupBy("part").agg(F.min_by(mean, "first").alias("low"), F.max_by(mean, "first").alias("high")).orderBy("part").collect()  # one row a range
        if all(a.high < b.low for a, b in zip(ends, ends[1:], strict=False)):
            return blocks
        number = {r.part: i // 2 for i, r in enumerate(ends)}
        again = F.element_at(F.create_map(*(F.lit(v) for pair in number.items() for v in pair)), F.col("part"))
        paired = blocks.withColumn("part", again).repartition("part").sortWithinPartitions("part", "first")
        blocks = cut(paired.mapInArrow(_pooled(lambda batch: batch.column("part").to_pylist()), _BLOCK))


def _line(first: np.ndarray, last: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
    at, y = np.column_stack([first, last]).ravel(), np.repeat(value, 2)
    new = np.r_[True, at[1:] > at[:-1]]
    return np.clip(np.interp(x, at[new], y[new]), CLIP, 1 - CLIP) if len(at) else np.full(len(x), np.nan)


def calibrate(rows: DataFrame, curve: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
    """rows with the curve's value at their score; null where the score is null or NaN."""
    if curve.isEmpty():
        raise ValueError("no points")
    if curve.count() > BROADCAST_BLOCKS:
        return _by_ranges(rows, curve, score, name)
    table = curve.orderBy("first").toPandas()
    first, last, value = table["first"].to_numpy(), table["last"].to_numpy(), (table["wy"] / table["w"]).to_numpy()

    @F.pandas_udf("double")
    def at(x: pd.Series) -> pd.Series:
        return pd.Series(np.where(x.isna(), np.nan, _line(first, last, value, x.to_numpy(float)))).where(~x.isna().to_numpy(), None)

    return rows.withColumn(name, at(F.nanvl(F.col(score).cast("double"), F.lit(None))))


def _by_ranges(rows: DataFrame, curve: DataFrame, score: str, name: str) -> DataFrame:
    """The same for long curves: rows meet the blocks of their range, and the last and first block beside it."""
    value = F.struct("first", "last", (F.col("wy") / F.col("w")).alias("value"))
    ends = curve.groupBy("part").agg(F.min_by(value, "first").alias("head"), F.max_by(value, "first").alias("tail")).orderBy("part").collect()  # one row a range
    begins, parts = [r["head"]["first"] for r in ends], [r.part for r in ends]
    beside = [(parts[i], *e) for i in range(len(ends)) for e in ([ends[i - 1]["tail"]] if i else []) + ([ends[i + 1]["head"]] if i + 1 < len(ends) else [])]
    spark = rows.sparkSession
    pieces = curve.select("part", "first", "last", (F.col("wy") / F.col("w")).alias("value"))
    if beside:
        pieces = pieces.unionByName(spark.createDataFrame(beside, "part int, first double, last double, value double"))
    x = F.nanvl(F.col(score).cast("double"), F.lit(None))
    place = F.greatest(F.lit(0), F.size(F.filter(F.array(*map(F.lit, begins)), lambda b: b <= x)) - 1)
    columns = rows.columns
    placed = rows.select(F.element_at(F.array(*map(F.lit, parts)), place + 1).alias("__part"), F.lit(1).alias("__kind"), x.alias("__x"), F.lit(None).cast("double").alias("__last"), F.lit(None).cast("double").alias("__value"), F.struct(*columns).alias("__row"))
    none = F.lit(None).cast(placed.schema["__row"].dataType)
    both = placed.unionByName(pieces.select(F.col("part").alias("__part"), F.lit(0).alias("__kind"), F.col("first").alias("__x"), F.col("last").alias("__last"), F.col("value").alias("__value"), none.alias("__row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            part, kind, x, last, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__part", "__kind", "__x", "__last", "__value"))
            for i in np.flatnonzero(kind == 0).tolist():
                held.setdefault(int(part[i]), []).append((x[i], last[i], value[i]))
            mine = np.flatnonzero(kind == 1)
            out = np.full(len(mine), np.nan)
            for p in np.unique(part[mine]).tolist():
                here = part[mine] == p
                line = np.array(sorted(held[p]))
                out[here] = _line(line[:, 0], line[:, 1], line[:, 2], x[mine][here])
            missing = np.isnan(x[mine])
            yield pa.RecordBatch.from_arrays([batch.column("__row").take(pa.array(mine)), pa.array(out, mask=missing)], ["__row", name])

    dealt = both.repartition("__part").sortWithinPartitions("__part", "__kind")
    schema = placed.select("__row").withColumn(name, F.lit(None).cast("double")).schema
    return dealt.mapInArrow(run, schema).select("__row.*", name)
