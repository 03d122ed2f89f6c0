"""Scores of samples that are kept by what made them: model, calibration and selection.

A part (a sample, a process, a variation) is a folder below the digest of these three. What is there whole is read; only parts that are
missing are scored, and written. Another model, calibration or selection has another digest, so nothing stale is ever read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tessella.operators.trees import Store
from tessella.sources.models import to_json


class ScoreCache:
    """Scored tables under a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    @staticmethod
    def key(model, calibration=None, selection: str = "") -> str:
        text = "\0".join([to_json(model), "" if calibration is None else to_json(calibration), selection])
        return hashlib.sha256(text.encode()).hexdigest()

    def scored(self, parts: dict[str, Callable[[], DataFrame]], model, calibration=None, selection: str = "") -> DataFrame:
        """All parts together; a part's function is called only if the part is missing."""
        key, found = self.key(model, calibration, selection), []
        for name, score in parts.items():
            at = f"{key}/{name}"
            if not self.store.has(at):
                score().write.mode("overwrite").parquet(f"{self.store.path}/{at}")
            found.append(self.spark.read.parquet(f"{self.store.path}/{at}"))
        return reduce(DataFrame.unionByName, found)

    def clear(self, model=None, calibration=None, selection: str = "") -> None:
        """What one model, calibration and selection made; without a model, everything."""
        path, files = self.store._at("" if model is None else self.key(model, calibration, selection))
        files.delete(path, True)
