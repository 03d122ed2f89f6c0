"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node in (a, b) links except those that are their own label: the smallest node of the component.

    Each step writes its edges, so a lost executor repeats one step. Edges only ever point to smaller nodes, and there are never
    more of them than links.
    """
    name = f"star-{scratch.serial()}"
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, step, before = scratch.table(edges, f"{name}-0"), 0, None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = state
        wide = scratch.table(_large_star(edges), f"{name}-{step + 1}")
        edges = scratch.table(_small_star(wide), f"{name}-{step + 2}")
        scratch.drop(f"{name}-{step}")
        scratch.drop(f"{name}-{step + 1}")
        step += 2
