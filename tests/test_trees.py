"""Trees grown level by level and boosting, against brute force on small tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.kinematics import with_derived
from tessella.operators import scoring, trees
from tessella.operators.yields import design
from tessella.schema import FEATURES, PRIMARY
from tessella.sources.fixture import collision_events

POINTS, TERMS = ((0.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 2.0, 0.0)), (("nu_jes",), ("nu_jes", "nu_jes"))
EDGES = trees.Edges({"x": (1.0, 2.0, 3.0, 4.0), "y": (0.5, 1.5)})


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        x, y, point = float(rng.integers(0, 6)), float(rng.integers(0, 3)), i % 3
        x = None if i % 50 == 0 else math.nan if i % 50 == 1 else x
        rows.append((i, x, y, 1.0 + 0.1 * (i % 7) + (0.3 * point if y > 0.5 else 0.0) + (0.2 * point if x is not None and x <= 2 else 0.0), point, i % 4))
    return rows, spark.createDataFrame(rows, "id int, x double, y double, weight double, point int, label int").repartition(5)


def brute_parametric(rows, depth, min_size):
    """The coefficients of each row's leaf, split by split from the definition."""
    d = design(POINTS, TERMS)
    coded = [(i, 5 if x is None or math.isnan(x) else sum(e < x for e in EDGES.of["x"]), sum(e < y for e in EDGES.of["y"]), w, p) for i, x, y, w, p, _ in rows]

    def sums(part):
        return [(sum(r[3] for r in part if r[4] == p), sum(r[4] == p for r in part)) for p in range(3)]

    def loss(part):
        w = [s[0] for s in sums(part)]
        x = d["MV"] @ np.log(np.array(w[1:]) / w[0])
        return sum(w[0] * (np.logaddexp(0, v) - math.log(2)) + w[k + 1] * (np.logaddexp(0, -v) - math.log(2)) for k, v in enumerate(x))

    def delta(part):
        w = np.array([s[0] for s in sums(part)])
        return d["M"].T @ np.log(w[1:] / w[0])

    out = {}

    def grow(part, left, parent):
        small = any(n < 2 * min_size for _, n in sums(part))
        value = delta(parent if small else part)
        tries = []
        if left and not small:
            for f, n in ((1, 4), (2, 2)):
                for b in range(n + 1):
                    sides = [r for r in part if r[f] <= b], [r for r in part if r[f] > b]
                    if all(s and all(n >= min_size for _, n in sums(s)) for s in sides):
                        tries.append((round(loss(sides[0]) + loss(sides[1]), 6), f, b, sides))
        if not tries:
            out.update((r[0], value) for r in part)
            return
        _, _, _, sides = min(tries, key=lambda t: t[:3])
        for s in sides:
            grow(s, left - 1, part)

    grow(coded, depth, coded)
    return out


def test_parametric_tree_is_that_of_the_definition(spark, events):
    rows, df = events
    objective = trees.Parametric(POINTS, TERMS, 15)
    table = trees.binned(df, EDGES, "weight", "point", "id")
    for depth in (1, 3):
        grown, jobs = trees.grow(table, EDGES, objective, depth)
        assert jobs <= depth
        want = brute_parametric(rows, depth, 15)
        tree = grown[0].tree(EDGES)
        got = df.select("id", *(scoring.tree_column(tree, k).alias(f"d{k}") for k in range(2))).collect()
        for r in got:
            assert (r.d0, r.d1) == pytest.approx(tuple(want[r.id]), abs=1e-9)
        assert trees.Grown.of(tree, EDGES).tree(EDGES) == tree
    assert len(grown[0].feature) > 3


def test_jobs_follow_levels_not_nodes(spark, events, monkeypatch):
    _, df = events
    table, calls, real = trees.binned(df, EDGES, "weight", "point"), [], trees.histograms
    monkeypatch.setattr(trees, "histograms", lambda *a: calls.append(a[-1]) or real(*a))
    _, jobs = trees.grow(table, EDGES, trees.Parametric(POINTS, TERMS, 5), 4)
    assert jobs == len(calls) == 4 and len(calls[2]) <= 2 and len(calls[3]) <= 4  # of two siblings one is filled


def test_siblings_by_subtraction(spark, events):
    _, df = events
    objective, table = trees.Parametric(POINTS, TERMS, 5), trees.binned(df, EDGES, "weight", "point")
    grown = trees.Grown()
    whole = trees.histograms(table, EDGES, objective, [grown], [(0, 0)])[0, 0]
    grown.split(0, 0, 1)
    both = trees.histograms(table, EDGES, objective, [grown], [(0, 1), (0, 2)])
    assert np.allclose(both[0, 1] + both[0, 2], whole) and whole[0, :, :, 1].sum() == 600


def test_boosting_goes_on_where_it_ended(spark, events, tmp_path):
    rows, df = events
    objective = trees.Parametric(POINTS, TERMS, 15)
    options = {"depth": 2, "rate": 0.3, "first_full": True, "objective": objective, "keep": ("id",)}
    one = trees.Store(spark, f"{tmp_path}/one")
    want = trees.boost_parametric(one, df, EDGES, 3, **options)
    two = trees.Store(spark, f"{tmp_path}/two")
    trees.boost_parametric(two, df, EDGES, 1, **options)
    path, files = two._at("version-1")
    files.delete(path, True)  # as if it had ended between the tree and the version
    assert trees.boost_parametric(two, df, EDGES, 3, **options) == want == trees.boost_parametric(two, df, EDGES, 3, **options)
    weights = [{r.id: r.weight for r in s.version(3).collect()} for s in (one, two)]
    assert weights[0] == pytest.approx(weights[1])
    assert not one.has("version-1") and one.has("version-2")
    first = brute_parametric(rows, 2, 15)
    v = {p: [POINTS[p][1], POINTS[p][1] ** 2] for p in range(3)}
    three = trees.Store(spark, f"{tmp_path}/three")
    trees.boost_parametric(three, df, EDGES, 1, **options)
    got = {r.id: r.weight for r in three.version(1).collect()}
    for i, _, _, w, p, _ in rows:
        assert got[i] == pytest.approx(w * math.exp(-float(np.dot(first[i], v[p]))) if p else w)


def brute_newton(rows, targets, derive, depth, rate, l2):
    """The steps of one round for each row, one tree a target."""
    coded = [(i, 5 if x is None or math.isnan(x) else sum(e < x for e in EDGES.of["x"]), sum(e < y for e in EDGES.of["y"])) for i, x, y, *_ in rows]
    steps = {i: [] for i, *_ in coded}
    for k in range(targets):
        g, h = derive(k)

        def score(part, g=g, h=h):
            return sum(g[r[0]] for r in part) ** 2 / (sum(h[r[0]] for r in part) + l2)

        def grow(part, left, g=g, h=h, score=score):
            best = None
            if left and sum(h[r[0]] for r in part) >= 2:
                for f, n in ((1, 4), (2, 2)):
                    for b in range(n + 1):
                        a, c = [r for r in part if r[f] <= b], [r for r in part if r[f] > b]
                        gain = (score(a) + score(c) - score(part)) / 2
                        if min(sum(h[r[0]] for r in s) for s in (a, c)) >= 1 and gain > 1e-6 and (best is None or round(-gain, 6) < best[0]):
                            best = (round(-gain, 6), a, c)
            if best:
                grow(best[1], left - 1)
                grow(best[2], left - 1)
            else:
                for r in part:
                    steps[r[0]].append(-rate * sum(g[x[0]] for x in part) / (sum(h[x[0]] for x in part) + l2))

        grow(coded, depth)
    return steps


def test_class_trees_of_a_round(spark, events, tmp_path):
    rows, df = events
    store = trees.Store(spark, f"{tmp_path}/soft")
    made = trees.boost_newton(store, df.withColumn("target", F.col("label")), EDGES, 2, 2, trees.Newton(rate=0.5), ("id",))
    assert len(made) == 2 and len(made[0]) == 4
    margins = {i: [0.0] * 4 for i, *_ in rows}
    for _ in range(2):
        p = {i: np.exp(m) / np.exp(m).sum() for i, m in margins.items()}
        derive = lambda k, p=p: ({r[0]: r[3] * (p[r[0]][k] - (r[5] == k)) for r in rows}, {r[0]: 2 * r[3] * p[r[0]][k] * (1 - p[r[0]][k]) for r in rows})
        steps = brute_newton(rows, 4, derive, 2, 0.5, 1.0)
        margins = {i: [a + b for a, b in zip(margins[i], steps[i], strict=True)] for i in margins}
    for r in store.version(2).collect():
        assert list(r.margins) == pytest.approx(margins[r.id], abs=1e-9)


def test_tags_stand_for_copies(spark, events, tmp_path):
    """Nominal events with the weight of a copy for each other point give the round that the copies give."""
    rows, df = events
    objective = trees.Newton("tags", rate=0.4)
    a = trees.boost_newton(trees.Store(spark, f"{tmp_path}/a"), trees.tagged(df, 3), EDGES, 2, 2, objective)
    copies = df.withColumn("target", F.when(F.col("point") == 0, 0).otherwise(1)).withColumn("copy", F.explode(F.when(F.col("point") == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    b = trees.boost_newton(trees.Store(spark, f"{tmp_path}/b"), copies, EDGES, 2, 2, objective)

    def flat(t):
        return [t.feature, t.threshold, *flat(t.left), *flat(t.right)] if isinstance(t, scoring.Split) else list(t.value)

    for x, y in zip(itertools.chain(*a), itertools.chain(*b), strict=True):
        assert [v if isinstance(v, str) else pytest.approx(v) for v in flat(x)] == flat(y)


def test_quantile_edges(spark):
    df = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(1.0).alias("y"), F.lit(None).cast("double").alias("z"))
    edges = trees.quantile_edges(df, ["x", "y", "z"], 4)
    assert edges.of["y"] == (1.0,) and edges.of["z"] == () and len(edges.of["x"]) == 3
    assert [abs(e - q) <= 1 for e, q in zip(edges.of["x"], (24, 49, 74), strict=True)] == [True] * 3
    with pytest.raises(ValueError):
        trees.quantile_edges(df, ["x"], 300)


def test_equal_leaves_are_pruned():
    leaf = scoring.Leaf((1.0,))
    assert trees.pruned(scoring.Split("x", 1.0, scoring.Split("y", 0.0, leaf, leaf), leaf)) == leaf
    other = scoring.Split("x", 1.0, leaf, scoring.Leaf((2.0,)))
    assert trees.pruned(other) == other


def test_no_events(spark, events, tmp_path):
    none = events[1].where("false")
    grown, jobs = trees.grow(trees.binned(none, EDGES, "weight", "point"), EDGES, trees.Parametric(POINTS, TERMS), 3)
    assert jobs == 1 and grown[0].tree(EDGES) == scoring.Leaf((0.0, 0.0))


def test_derived_features_are_those_of_the_columns(spark):
    """Binning derives what events lack as the Columns do, also of events with nulls and NaN; leaves are those of the tree's Columns."""
    e = collision_events(spark, "/root/testdata/sf0.001")
    for i, c in enumerate(c for c in PRIMARY if c != "PRI_n_jets"):
        odd = F.when(F.pmod(F.xxhash64("event_id", F.lit(c)), F.lit(60)) == 0, F.lit(None) if i % 2 else F.lit(float("nan")))
        e = e.withColumn(c, F.when(F.pmod(F.xxhash64("event_id", F.lit(c)), F.lit(60)) == 0, odd).otherwise(F.col(c)))
    e = e.withColumn("PRI_n_jets", F.when(F.col("event_id") % 41 != 0, F.col("PRI_n_jets"))).withColumn("id", F.monotonically_increasing_id())
    edges = trees.equal_edges(FEATURES)
    lacking, given = (trees.binned(x, edges, "id") for x in (e, with_derived(e)))
    want = {r.id: bytes(r.bins) for r in given.collect()}
    got = {r.id: bytes(r.bins) for r in lacking.collect()}
    differ = [(FEATURES[k], i) for i in want for k in range(len(FEATURES)) if want[i][k] != got[i][k]]
    assert len(want) == len(got) == 6000 and differ == []
    grown = trees.Grown()
    child = grown.split(0, FEATURES.index("DER_pt_h"), 5)
    grown.value[child], grown.value[child + 1] = (1.0, 2.0), (3.0, 4.0)
    tree = grown.tree(edges)
    columns = {r.id: [r.a, r.b] for r in with_derived(e).select("id", scoring.tree_column(tree, 0).alias("a"), scoring.tree_column(tree, 1).alias("b")).collect()}
    assert {r.id: list(r.value) for r in trees.placed(lacking, grown, "id").collect()} == columns


def test_boosting_reads_partitions_of_bounded_size(spark, monkeypatch):
    """A partition that is too large is dealt out before it is held; the model is that of the same rows in one partition."""
    rows = spark.range(3000).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 * 2.0).alias("residual")).coalesce(1)
    want = scoring.fit_residuals(rows, ["x"], maxIter=2).toDebugString
    held, real = [], scoring.GBTRegressor.fit

    def fit(self, data, *more):
        held.append([len(p) for p in data.rdd.glom().collect()])
        return real(self, data, *more)

    monkeypatch.setattr(scoring.GBTRegressor, "fit", fit)
    monkeypatch.setattr(scoring, "TRAIN_ROWS", 500)
    got = scoring.fit_residuals(rows, ["x"], maxIter=2).toDebugString
    assert sum(held[0]) == 3000 and max(held[0]) <= 550
    assert got.split("\n")[1:] == want.split("\n")[1:]
