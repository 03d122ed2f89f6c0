"""The batch kernel of variations against the Column formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import systematics, variations
from tessella.operators.histograms import feature_histograms
from tessella.schema import BASE_POINTS, FEATURES, PRIMARY
from tessella.sources.fixture import collision_events

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("number", [0, 2, 11, 32])
def test_kernel_is_the_treatment(spark, number):
    tes, jes, met = variations.shift_of(BASE_POINTS[number])
    events = collision_events(spark, SF).limit(500).cache()
    x, y = systematics.keyed_normals(F.col("event_id"), 31415)
    rows = events.select(*(F.col(c).cast("double").alias(c) for c in PRIMARY), "weight", x.alias("noise_x"), y.alias("noise_y")).toPandas()
    got = variations.derive(variations.cut_off(variations.varied({c: rows[c].to_numpy() for c in rows}, tes, jes, met)))
    shift = systematics.Shift(tes=tes, jes=jes, soft_met=met, key="event_id", seed=31415)
    want = systematics.systematic_events(events, shift).select(*(F.col(f).cast("double").alias(f) for f in FEATURES), "weight").toPandas()
    assert 0 < len(want) == len(got["weight"])
    for f in FEATURES:
        assert np.allclose(got[f], want[f], rtol=1e-9, atol=2e-6 if "mass" in f else 1e-9, equal_nan=True), f


def test_histograms_of_all_points(spark):
    events = collision_events(spark, SF).where("event_id % 7 = 0")
    points = (BASE_POINTS[0], BASE_POINTS[3])
    got = {(r.point, r.feature, r.bin): r["sum"] for r in variations.varied_histograms(events, points).collect()}
    for i, p in enumerate(points):
        tes, jes, met = variations.shift_of(p)
        d = systematics.systematic_events(events, systematics.Shift(tes=tes, jes=jes, soft_met=met, key="event_id"))
        want = {(i, r.feature, r.bin): r["sum"] for r in feature_histograms(d).collect()}
        assert {k: v for k, v in got.items() if k[0] == i} == pytest.approx(want)
    assert variations.varied_histograms(events.where("false"), points).count() == 0


def test_points_of_one_pair_of_scales_share_the_rest(spark, monkeypatch):
    """What differs in the missing momentum alone is derived once; the histograms are those of each point on its own."""
    x, y = systematics.keyed_normals(F.col("event_id"), 31415)
    rows = collision_events(spark, SF).limit(800).select(*(F.col(c).cast("double").alias(c) for c in PRIMARY), "weight", x.alias("noise_x"), y.alias("noise_y")).toPandas()
    e, shifts, features, calls = {c: rows[c].to_numpy() for c in rows}, [variations.shift_of(p) for p in BASE_POINTS], list(FEATURES), []
    own = variations.derive_own
    monkeypatch.setattr(variations, "derive_own", lambda e: calls.append(1) or own(e))
    empty = lambda: [np.zeros((variations.BINNING[f][0], 2)) for f in features]
    filled = {i: empty() for i in range(len(shifts))}
    variations.fill(e, shifts, features, filled)
    assert len(calls) == len({s[:2] for s in shifts}) == 17
    for i, shift in enumerate(shifts):
        at_point = variations.derive(variations.cut_off(variations.varied(e, *shift)))
        for f, got in zip(features, filled[i], strict=True):
            at = variations.bins_of(at_point[f], f)
            want = np.array([[np.sum(at == b), at_point["weight"][at == b].sum()] for b in range(len(got))])
            assert got == pytest.approx(want), f
