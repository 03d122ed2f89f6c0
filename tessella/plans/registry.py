"""Helpers that the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.kinematics import with_derived
from tessella.schema import FEATURES
from tessella.sources.fixture import SQL_NAMES, collision_events, with_scores

DIGITS = 6


def events(spark, sf_dir: str) -> DataFrame:
    return collision_events(spark, sf_dir)


def derived(spark, sf_dir: str) -> DataFrame:
    return with_derived(events(spark, sf_dir))


def scored(spark, sf_dir: str) -> DataFrame:
    return with_scores(derived(spark, sf_dir))


def r(x: Column | str, digits: int = DIGITS) -> Column:
    """Rounded for comparison; a negative zero becomes zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def rs(x: str, digits: int = DIGITS) -> str:
    """The same in SQL."""
    return f"round({x}, {digits}) + 0.0::double"


def feature(sql_name: str) -> str:
    return SQL_NAMES[sql_name]


SQL_OF = {f: s for s, f in SQL_NAMES.items()}
assert set(SQL_OF) == set(FEATURES)
