"""Row numbers without a sort, rows by number, and cached scores."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import scoring
from tessella.operators.score_cache import ScoreCache
from tessella.sources import events as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows"))
    spark.range(1000).select(F.col("id"), (F.col("id") * 2).alias("twice")).repartitionByRange(7, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)
    return path


def test_numbers_follow_files_and_rows(spark, folder):
    got = S.numbered_rows(spark, folder)
    assert {(r.row_idx, r.id) for r in got.collect()} == {(i, i) for i in range(1000)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "SinglePartition" not in plan and "Sort " not in plan


def test_rows_by_number_read_their_files_only(spark, folder):
    got = S.pick_numbered(spark, folder, [0, 5, 5, 999, 4000])
    assert sorted((r.row_idx, r.id, r.twice) for r in got.collect()) == [(0, 0, 0), (5, 5, 10), (999, 999, 1998)]
    assert len(got.inputFiles()) == 2
    assert S.pick_numbered(spark, folder, [4000]).count() == 0


def test_scores_are_made_once(spark, tmp_path):
    net = scoring.Network(("x",), (([[1.0, -1.0]], [0.0, 0.0]),))
    df, calls = spark.createDataFrame([(float(i),) for i in range(6)], "x double"), []

    def part(name, low, high):
        def score():
            calls.append(name)
            return scoring.with_network(df.where((F.col("x") >= low) & (F.col("x") < high)), net, "p")

        return score

    parts = {"a": part("a", 0, 3), "b": part("b", 3, 6)}
    cache = ScoreCache(spark, str(tmp_path))
    first = {r.x: list(r.p) for r in cache.scored(parts, net, None, "all").collect()}
    assert calls == ["a", "b"] and {r.x: list(r.p) for r in cache.scored(parts, net, None, "all").collect()} == first and calls == ["a", "b"]
    cache.scored({**parts, "c": part("c", 0, 1)}, net, None, "all")
    assert calls == ["a", "b", "c"]
    leaf = scoring.Leaf((1.0,))
    cache.scored({"a": parts["a"]}, net, leaf, "all")
    assert calls[3:] == ["a"]
    cache.clear(net, None, "all")
    cache.scored({"a": parts["a"]}, net, leaf, "all")
    assert calls[4:] == []
    cache.scored({"a": parts["a"]}, net, None, "all")
    assert calls[4:] == ["a"]
