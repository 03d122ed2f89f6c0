"""Histograms of all features at all base points from one scan.

A batch of events is varied in numpy once for each pair of energy scales among the points: scaled, cut, derived and counted in; points of
one pair differ in the missing momentum, which is derived for each of them. Nothing is multiplied by the number of points
but the arithmetic; a task hands on one row for each bin it filled. The formulas are those of kinematics and systematics.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.kinematics import EPSILON
from tessella.operators.systematics import HAD_PT, JET_PT, LEP_PT, ROUNDED, keyed_normals
from tessella.operators.yields import monomials
from tessella.schema import ALPHA_MEAN, ALPHA_SIGMA, BASE_POINTS, BINNING, MONOMIALS, NOMINAL, PRIMARY, UNDEFINED

Columns = dict[str, np.ndarray]
_OBJECTS = _LEP, _HAD, _J1, _J2 = "PRI_lep", "PRI_had", "PRI_jet_leading", "PRI_jet_subleading"
#: Rounded columns that no point changes; those that scaled leaves to with_met.
_FIXED = {f"{name}_{x}" for name in _OBJECTS for x in ("eta", "phi")} | {f"{_LEP}_pt", "PRI_met", "PRI_met_phi"}
#: Features that the missing momentum is part of.
OF_MET = {"PRI_met", "PRI_met_phi", "DER_mass_transverse_met_lep", "DER_pt_h", "DER_pt_tot", "DER_met_phi_centrality"}


def shift_of(point: tuple[float, float, float]) -> tuple[float, float, float]:
    """Energy scales of hadron and jets, and the size of the soft term, at a point of the nuisances."""
    tes, jes, met = (ALPHA_MEAN[a] + x * ALPHA_SIGMA[a] for a, x in zip(("tes", "jes", "met"), point, strict=True))
    return tes, jes, met


def prepared(e: Columns) -> Columns:
    """Events with what no point changes, taken once for all of them: missing momentum, directions as they are and as they are rounded."""
    out = e | {"__x": e["PRI_met"] * np.cos(e["PRI_met_phi"]), "__y": e["PRI_met"] * np.sin(e["PRI_met_phi"])}
    for name in (_HAD, _J1, _J2):
        out |= {f"__{name}_x": np.cos(e[f"{name}_phi"]), f"__{name}_y": np.sin(e[f"{name}_phi"])}
    for name in _OBJECTS:
        eta, phi = (np.rint(e[f"{name}_{x}"] * 1000.0) / 1000.0 for x in ("eta", "phi"))
        out |= {f"{name}_eta": eta, f"{name}_phi": phi} | _directions(name, eta, phi)
    return out | {f"{_LEP}_pt": np.rint(e[f"{_LEP}_pt"] * 1000.0) / 1000.0}


def _directions(name: str, eta: np.ndarray, phi: np.ndarray) -> Columns:
    return {f"__{name}_cos": np.cos(phi), f"__{name}_sin": np.sin(phi), f"__{name}_sinh": np.sinh(eta), f"__{name}_cosh": np.cosh(eta)}


def scaled(e: Columns, tes: float, jes: float) -> Columns:
    """Prepared events with scaled energies, rounded, and the missing momentum that balances them (__x, __y), without its soft term."""
    out, n, x, y = dict(e), e["PRI_n_jets"], e["__x"], e["__y"]
    if tes != 1.0:
        k, pt = (1 - tes) / tes, e[f"{_HAD}_pt"]
        out[f"{_HAD}_pt"] = pt * tes
        x, y = x + pt * out.pop(f"__{_HAD}_x") * tes * k, y + pt * out.pop(f"__{_HAD}_y") * tes * k
    if jes != 1.0:
        k = (1 - jes) / jes
        for i, jet in ((1, _J1), (2, _J2)):
            here, pt = n >= i, e[f"{jet}_pt"]
            out[f"{jet}_pt"] = np.where(here, pt * jes, pt)
            x = x + np.where(here, pt * jes * out.pop(f"__{jet}_x"), 0.0) * k
            y = y + np.where(here, pt * jes * out.pop(f"__{jet}_y"), 0.0) * k
        out["PRI_jet_all_pt"] = e["PRI_jet_all_pt"] * jes
    for c in (f"__{name}_{a}" for name in (_HAD, _J1, _J2) for a in "xy"):
        out.pop(c, None)
    return out | {"__x": x, "__y": y} | {c: np.rint(out[c] * 1000.0) / 1000.0 for c in ROUNDED if c not in _FIXED}


def with_met(e: Columns, soft: float) -> Columns:
    """The missing momentum, rounded, with a soft term of this size. noise_x and noise_y are its draws."""
    x, y = e["__x"], e["__y"]
    if soft > 0:
        x, y = x + e["noise_x"] * soft, y + e["noise_y"] * soft
    return e | {"PRI_met": np.rint(np.hypot(x, y) * 1000.0) / 1000.0, "PRI_met_phi": np.rint(np.arctan2(y, x) * 1000.0) / 1000.0}


def varied(e: Columns, tes: float, jes: float, soft: float) -> Columns:
    """Events with scaled energies and the missing momentum that balances them, rounded. noise_x and noise_y are the soft term's draws."""
    return with_met(scaled(prepared(e), tes, jes), soft)


def cut_off(e: Columns) -> Columns:
    """The documented thresholds: hadron, soft jets (the subleading one first), lepton."""
    rows = np.flatnonzero((e[f"{_HAD}_pt"] > HAD_PT) & (e[f"{_LEP}_pt"] >= LEP_PT))
    e = dict(e) if len(rows) == len(e[f"{_LEP}_pt"]) else {c: v.take(rows) for c, v in e.items()}
    undefined = np.array([UNDEFINED])
    for jet in (_J2, _J1):
        soft = (e[f"{jet}_pt"] >= 0.0) & (e[f"{jet}_pt"] <= JET_PT)
        if not soft.any():
            continue
        e["PRI_jet_all_pt"] = np.where(soft, e["PRI_jet_all_pt"] - e[f"{jet}_pt"], e["PRI_jet_all_pt"])
        e["PRI_n_jets"] = e["PRI_n_jets"] - soft
        for x in ("pt", "eta", "phi"):
            e[f"{jet}_{x}"] = np.where(soft, UNDEFINED, e[f"{jet}_{x}"])
        for c, v in _directions(jet, undefined, undefined).items():
            e[c] = np.where(soft, v, e[c])
    return e


def derive(e: Columns) -> Columns:
    """The derived features."""
    return derive_met(derive_own(e))


def derive_own(e: Columns) -> Columns:
    """Those without the missing momentum, and what the others need of the rest (names that begin with __)."""
    n = e["PRI_n_jets"]

    def polar(name: str) -> tuple[np.ndarray, ...]:
        pt = e[f"{name}_pt"]
        return tuple(pt * e[f"__{name}_{x}"] for x in ("cos", "sin", "sinh", "cosh"))

    lep, had, jets = polar(_LEP), polar(_HAD), {i: polar(j) for i, j in ((1, _J1), (2, _J2))}
    own = {i: [np.where(n >= i, c, 0.0) for c in jets[i][:2]] for i in jets}
    two = lambda v: np.where(n >= 2, v, UNDEFINED)
    a, b = e[f"{_J1}_eta"], e[f"{_J2}_eta"]
    angle = np.abs(np.mod(e[f"{_HAD}_phi"] - e[f"{_LEP}_phi"] + 3 * math.pi, 2 * math.pi) - math.pi)
    gap = np.where(a - b == 0, EPSILON, a - b)
    both = [lep[i] + had[i] for i in range(4)]
    jj = [jets[1][i] + jets[2][i] for i in range(4)]
    parts = {"__lep": lep[:2], "__both": both[:2], "__had": had[:2], "__own": (*own[1], *own[2])}
    with np.errstate(divide="ignore", invalid="ignore"):
        return e | {f"{c}{i}": v for c, of in parts.items() for i, v in enumerate(of)} | {
            "__sign": np.sign(np.sin(e[f"{_HAD}_phi"] - e[f"{_LEP}_phi"])),
            "DER_mass_vis": np.sqrt(both[3] ** 2 - both[0] ** 2 - both[1] ** 2 - both[2] ** 2),
            "DER_deltaeta_jet_jet": two(np.abs(a - b)),
            "DER_mass_jet_jet": two(_root(jj[3] ** 2 - jj[0] ** 2 - jj[1] ** 2 - jj[2] ** 2)),
            "DER_prodeta_jet_jet": two(a * b),
            "DER_deltar_had_lep": np.sqrt((e[f"{_HAD}_eta"] - e[f"{_LEP}_eta"]) ** 2 + angle**2),
            "DER_sum_pt": e[f"{_HAD}_pt"] + e[f"{_LEP}_pt"] + e["PRI_jet_all_pt"],
            "DER_pt_ratio_lep_tau": np.where(e[f"{_HAD}_pt"] != 0, e[f"{_LEP}_pt"] / e[f"{_HAD}_pt"], np.nan),
            "DER_lep_eta_centrality": two(np.exp(-4.0 / (gap * gap) * (e[f"{_LEP}_eta"] - (a + b) / 2) ** 2)),
        }


def _root(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, v))


def derive_met(e: Columns) -> Columns:
    """The derived features of the missing momentum."""
    met = e["PRI_met"] * np.cos(e["PRI_met_phi"]), e["PRI_met"] * np.sin(e["PRI_met_phi"])
    all_ = [e[f"__had{i}"] + e[f"__lep{i}"] + met[i] + e[f"__own{i}"] + e[f"__own{2 + i}"] for i in range(2)]
    right = np.sin(e[f"{_HAD}_phi"] - e["PRI_met_phi"])

    def centrality(lep_phi: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v = np.sin(e["PRI_met_phi"] - lep_phi) * sign, right * sign
        return u + v, np.sqrt(u * u + v * v)

    top, base = centrality(e[f"{_LEP}_phi"], e["__sign"])
    with np.errstate(divide="ignore", invalid="ignore"):
        central = top / base
        if (base == 0).any():
            moved = e[f"{_LEP}_phi"] + EPSILON
            top_2, base_2 = centrality(moved, np.sign(np.sin(e[f"{_HAD}_phi"] - moved)))
            central = np.where(base != 0, central, np.where(base_2 != 0, top_2 / base_2, UNDEFINED))
        return e | {
            "DER_mass_transverse_met_lep": _root((e["PRI_met"] + e[f"{_LEP}_pt"]) ** 2 - (e["__lep0"] + met[0]) ** 2 - (e["__lep1"] + met[1]) ** 2),
            "DER_pt_h": np.sqrt((e["__both0"] + met[0]) ** 2 + (e["__both1"] + met[1]) ** 2),
            "DER_pt_tot": np.sqrt(all_[0] ** 2 + all_[1] ** 2),
            "DER_met_phi_centrality": central,
        }


def derived_as_they_are(e: Columns, nulls: Columns) -> Columns:
    """The derived features of events that are neither varied nor rounded, as the Columns of kinematics give them. A null is NaN in e, and
    nulls says where: a clamped root takes it for 0, the centrality of the missing momentum is undefined then."""
    with np.errstate(invalid="ignore", over="ignore"):
        for name in _OBJECTS:
            e = e | _directions(name, e[f"{name}_eta"], e[f"{name}_phi"])
        out = derive(e)
    void = lambda *names: np.logical_or.reduce([nulls[c] for c in names])
    met = void("PRI_met", "PRI_met_phi", f"{_LEP}_pt", f"{_LEP}_phi")
    jets = void(*(f"{j}_{x}" for j in (_J1, _J2) for x in ("pt", "eta", "phi"))) & (e["PRI_n_jets"] >= 2)
    angles = void("PRI_met_phi", f"{_LEP}_phi", f"{_HAD}_phi")
    for c, at, value in (("DER_mass_transverse_met_lep", met, 0.0), ("DER_mass_jet_jet", jets, 0.0), ("DER_met_phi_centrality", angles, UNDEFINED)):
        out[c] = np.where(at, value, out[c])
    return out


def fill(e: Columns, shifts: list[tuple[float, float, float]], features: list[str], filled: dict[int, list[np.ndarray]]) -> None:
    """Add events to the (number of rows, sum) of each bin, by point and feature.

    Points with the same energy scales differ in the missing momentum only: they share all else, and the histograms of it.
    """
    e, of = prepared(e), {}
    for i, (tes, jes, soft) in enumerate(shifts):
        of.setdefault((tes, jes), []).append((i, soft))
    for (tes, jes), points in of.items():
        one = derive_own(cut_off(scaled(e, tes, jes)))
        for k, f in enumerate(features):
            if f not in OF_MET:
                more = _counted(one[f], f, one["weight"])
                for i, _ in points:
                    filled[i][k] += more
        for i, soft in points:
            at_point = derive_met(with_met(one, soft))
            for k, f in enumerate(features):
                if f in OF_MET:
                    filled[i][k] += _counted(at_point[f], f, one["weight"])


def _counted(x: np.ndarray, feature: str, weight: np.ndarray) -> np.ndarray:
    """bins x (number of rows, sum)."""
    at = bins_of(x, feature)
    at += 1  # rows outside are in bin 0
    n = BINNING[feature][0] + 1
    return np.column_stack([np.bincount(at, minlength=n), np.bincount(at, weight, n)])[1:]


def bins_of(x: np.ndarray, feature: str) -> np.ndarray:
    """Bin numbers of the standard binning, -1 outside and for NaN."""
    n, low, high = BINNING[feature]
    with np.errstate(invalid="ignore"):
        outside = ~((x >= low) & (x <= high))
    at = x - low
    at /= (high - low) / n
    at[outside] = -1.0
    return np.minimum(np.floor(at, out=at), n - 1, out=at).astype(np.int64)


def _rows(features: list[str], filled: dict[int, list[np.ndarray]], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """filled: per point and feature the sums (bins x (number of rows, sums))."""
    for point, of in filled.items():
        for f, values in zip(features, of, strict=True):
            at = np.flatnonzero(values[:, 0])
            columns = [pa.array([point] * len(at), pa.int32()), pa.array([f] * len(at), pa.string()), pa.array(at.astype(np.int32)), *(pa.array(values[at, k + 1]) for k in range(len(names)))]
            yield pa.RecordBatch.from_arrays(columns, ["point", "feature", "bin", *names])


def varied_histograms(events: DataFrame, points: tuple = BASE_POINTS, features: Iterable[str] = tuple(BINNING), key: str = "event_id", seed: int = 31415) -> DataFrame:
    """(point, feature, bin, sum): weighted histograms of the features as they are at each point. Points go by their number."""
    features, shifts = list(features), [shift_of(p) for p in points]
    x, y = keyed_normals(F.col(key), seed)
    rows = events.select(*(F.col(c).cast("double").alias(c) for c in PRIMARY), F.col("weight").cast("double").alias("weight"), x.alias("noise_x"), y.alias("noise_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = {i: [np.zeros((BINNING[f][0], 2)) for f in features] for i in range(len(points))}
        for batch in batches:
            primary = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            fill(primary, shifts, features, filled)
        yield from _rows(features, filled, ("part",))

    parts = rows.mapInArrow(run, "point int, feature string, bin int, part double")
    return parts.groupBy("point", "feature", "bin").agg(F.sum("part").alias("sum"))


def point_histograms(events: DataFrame, true: list[float], predicted: str, bias: float = 1.0, points: tuple = BASE_POINTS, features: Iterable[str] = tuple(BINNING)) -> DataFrame:
    """(point, feature, bin, true_sum, predicted) of every point but the nominal one: weights times the ratio of a log-polynomial, and weights
    times bias and the ratio of an event's own coefficients (an array column). A batch has its weights of all points as one matrix."""
    features, at_points = list(features), [i for i, p in enumerate(points) if p != NOMINAL]
    v = np.array([monomials(points[i]) for i in at_points]).T
    rows = events.select(F.col("weight").cast("double").alias("__w"), F.col(predicted).alias("__d"), *(F.col(f).cast("double").alias(f"__{i}") for i, f in enumerate(features)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((BINNING[f][0], 1 + 2 * len(at_points))) for f in features]
        for batch in batches:
            w = batch.column("__w").to_numpy(zero_copy_only=False)[:, None]
            d = batch.column("__d").flatten().to_numpy().reshape(batch.num_rows, len(MONOMIALS))
            weights = np.hstack([np.ones((batch.num_rows, 1)), w * np.exp(np.asarray(true) @ v), w * bias * np.exp(d @ v)])
            for i, f in enumerate(features):
                at = bins_of(batch.column(f"__{i}").to_numpy(zero_copy_only=False), f)
                sums[i] += (at == np.arange(BINNING[f][0])[:, None]).astype(float) @ weights
        n = len(at_points)
        yield from _rows(features, {p: [s[:, [0, 1 + k, 1 + n + k]] for s in sums] for k, p in enumerate(at_points)}, ("true_part", "predicted_part"))

    parts = rows.mapInArrow(run, "point int, feature string, bin int, true_part double, predicted_part double")
    return parts.groupBy("point", "feature", "bin").agg(F.sum("true_part").alias("true_sum"), F.sum("predicted_part").alias("predicted"))
