"""Bounded minimisation, curvature, scans and intervals of an objective that evaluates many points in one job.

An objective takes a list of parameter dicts and gives their values; parameters always go by name. The driver holds a handful of
numbers; whatever sums over events is the objective's single Spark job for each list. Fits, sides of intervals and whole toys are
problems that ask for points and wait for values: any number of them goes in step, with one job for a step of all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.schema import PARAMETERS

Objective = Callable[[list[dict[str, float]]], np.ndarray]

# Bounds of the parameters.
BOUNDS = {"mu": (0.0, math.inf), "nu_bkg": (-10.0, 10.0), "nu_tt": (-10.0, 10.0), "nu_diboson": (-4.0, 4.0), "nu_tes": (-10.0, 10.0), "nu_jes": (-10.0, 10.0), "nu_met": (0.0, 5.0)}
# Widening of an interval, and its limits (threshold, value put in place).
INFLATE, LOWEST, HIGHEST = 1.045, (0.1, 0.09), (3.0, 3.01)
#: What a point outside the bounds costs the simplex method.
OUTSIDE = 1e10


@dataclass
class Fit:
    values: dict[str, float]
    q: float
    covariance: np.ndarray | None = None
    calls: int = 0
    names: tuple[str, ...] = field(default=PARAMETERS)

    def row(self) -> dict[str, float]:
        """Flat: parameters, q_mle, and cov__a__b of each pair."""
        out = {("mu_mle" if n == "mu" else n): v for n, v in self.values.items()} | {"q_mle": self.q}
        if self.covariance is not None:
            out |= {f"cov__{a}__{b}": float(self.covariance[i, j]) for i, a in enumerate(self.names) for j, b in enumerate(self.names)}
        return out


#: A problem that asks for the values of points and goes on with them. Many of them are run in step: their points go into one call.
Steps = Generator[list[dict[str, float]], np.ndarray, object]


def in_step(objective: Objective, problems: list[Steps]) -> tuple[list, int]:
    """The results of all problems, and the number of calls: as many as the longest of them takes, not as all take together."""
    results: list = [None] * len(problems)
    asked, calls = {}, 0

    def go_on(i: int, values: np.ndarray | None) -> None:
        try:
            asked[i] = problems[i].send(values)
        except StopIteration as end:
            asked.pop(i, None)
            results[i] = end.value

    for i in range(len(problems)):
        go_on(i, None)
    while asked:
        now = list(asked)
        values, at = np.asarray(objective([p for i in now for p in asked[i]]), float), 0
        calls += 1
        for i in now:
            n = len(asked[i])
            go_on(i, values[at : at + n])
            at += n
    return results, calls


def _alone(objective: Objective, problem: Steps):
    return in_step(objective, [problem])[0][0]


class _Points:
    """Vectors over the named parameters, the others fixed, as points within bounds."""

    def __init__(self, names: tuple[str, ...], fixed: dict[str, float] | None, bounds: dict[str, tuple[float, float]]):
        self.names, self.fixed, self.calls = names, fixed or {}, 0
        self.low = np.array([bounds[n][0] for n in names])
        self.high = np.array([bounds[n][1] for n in names])

    def of(self, xs: np.ndarray) -> list[dict[str, float]]:
        self.calls += 1
        return [{**self.fixed, **dict(zip(self.names, map(float, x), strict=True))} for x in np.atleast_2d(xs)]

    def clip(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x, self.low, self.high)


def _gradient(f: _Points, x: np.ndarray, step: np.ndarray):
    """Value, gradient and a first inverse curvature in one call: central, one-sided where a bound is near.

    The inverse is that of each parameter on its own, so that first steps have the right length however large the sample; where the
    points do not tell a curvature the step is at most 1.
    """
    n = len(x)
    up, down = np.tile(x, (n, 1)), np.tile(x, (n, 1))
    up[np.arange(n), np.arange(n)] = np.minimum(x + step, f.high)
    down[np.arange(n), np.arange(n)] = np.maximum(x - step, f.low)
    values = yield f.of(np.vstack([x, up, down]))
    ahead, back = np.diag(up) - x, x - np.diag(down)
    slope = (values[1 : n + 1] - values[n + 1 :]) / np.maximum(ahead + back, 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        bend = 2 * ((values[1 : n + 1] - values[0]) / ahead - (values[0] - values[n + 1 :]) / back) / (ahead + back)
    known = np.isfinite(bend) & (bend > 1e-3)
    return values[0], slope, np.diag(1.0 / np.where(known, bend, np.maximum(1.0, np.abs(slope))))


def minimise_steps(start: dict[str, float], fixed: dict[str, float] | None = None, bounds=BOUNDS, tolerance: float = 1e-6, max_steps: int = 100, step: float = 1e-3, inverse: np.ndarray | None = None):
    """minimise as a problem that can be run in step with others. inverse: the inverse curvature to begin with, if it is known."""
    names = tuple(start)
    f = _Points(names, fixed, bounds)
    x = f.clip(np.array([start[n] for n in names], float))
    h = np.full(len(x), step)
    value, g, own = yield from _gradient(f, x, h)
    inverse = own if inverse is None else inverse
    ladder = 2.0 ** np.arange(2, -14, -1.0)
    for _ in range(max_steps):
        free = ~(((x <= f.low) & (g > 0)) | ((x >= f.high) & (g < 0)))
        if not free.any() or np.max(np.abs(g[free])) < 1e-9:
            break
        direction = np.zeros_like(x)
        direction[free] = -inverse[np.ix_(free, free)] @ g[free]
        if direction @ g >= 0:
            inverse = own
            direction = np.where(free, -own @ g, 0.0)
        tries = f.clip(x + ladder[:, None] * direction)
        found = np.array((yield f.of(tries)))
        found[~np.isfinite(found)] = np.inf
        best = int(np.argmin(found))
        if not found[best] < value:
            if inverse is own:
                break
            inverse = own
            continue
        moved, gain = tries[best], value - found[best]
        value, new, own = yield from _gradient(f, moved, h)
        s, y = moved - x, new - g
        if s @ y > 1e-12:
            rho, eye = 1.0 / (s @ y), np.eye(len(x))
            inverse = (eye - rho * np.outer(s, y)) @ inverse @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        x, g = moved, new
        if gain < tolerance:
            break
    return Fit(dict(zip(names, map(float, x), strict=True)), float(value), None, f.calls, names)


def minimise(objective: Objective, start: dict[str, float], fixed: dict[str, float] | None = None, bounds=BOUNDS, tolerance: float = 1e-6, max_steps: int = 100, step: float = 1e-3) -> Fit:
    """Quasi-Newton (BFGS) within bounds. Each line search tries a ladder of step lengths in one call."""
    return _alone(objective, minimise_steps(start, fixed, bounds, tolerance, max_steps, step))


def simplex(objective: Objective, start: dict[str, float], fixed: dict[str, float] | None = None, bounds=BOUNDS, x_tolerance: float = 0.01, f_tolerance: float = 0.01, max_steps: int = 2000, spread: float = 0.5) -> Fit:
    """Nelder and Mead; points outside the bounds cost OUTSIDE. The candidate points of a step are evaluated in one call."""
    return _alone(objective, simplex_steps(start, fixed, bounds, x_tolerance, f_tolerance, max_steps, spread))


def simplex_steps(start: dict[str, float], fixed: dict[str, float] | None = None, bounds=BOUNDS, x_tolerance: float = 0.01, f_tolerance: float = 0.01, max_steps: int = 2000, spread: float = 0.5):
    names = tuple(start)
    f = _Points(names, fixed, bounds)

    def value(xs: np.ndarray):
        inside = np.all((xs >= f.low) & (xs <= f.high), axis=1)
        return np.where(inside, (yield f.of(f.clip(xs))), OUTSIDE)

    x0 = np.array([start[n] for n in names], float)
    points = np.vstack([x0, x0 + spread * np.eye(len(x0))])
    values = yield from value(points)
    for _ in range(max_steps):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if np.max(np.abs(points[1:] - points[0])) <= x_tolerance and values[-1] - values[0] <= f_tolerance:
            break
        centre = points[:-1].mean(axis=0)
        away = centre - points[-1]
        tries = np.vstack([centre + away, centre + 2 * away, centre + 0.5 * away, centre - 0.5 * away])
        reflected, expanded, outer, inner = yield from value(tries)
        if reflected < values[0]:
            points[-1], values[-1] = (tries[1], expanded) if expanded < reflected else (tries[0], reflected)
        elif reflected < values[-2]:
            points[-1], values[-1] = tries[0], reflected
        elif min(outer, inner) < values[-1]:
            points[-1], values[-1] = (tries[2], outer) if outer <= inner else (tries[3], inner)
        else:
            points[1:] = points[0] + 0.5 * (points[1:] - points[0])
            values[1:] = yield from value(points[1:])
    best = int(np.argmin(values))
    return Fit(dict(zip(names, map(float, points[best]), strict=True)), float(values[best]), None, f.calls, names)


def hessian(objective: Objective, at: dict[str, float], fixed: dict[str, float] | None = None, bounds=BOUNDS, step: float = 0.2) -> np.ndarray:
    """Second derivatives by finite differences, all points in one call.

    Points are cut to the bounds and the formulas take the distances that are left. Where a parameter stands at a bound, the diagonal is
    taken from two steps inside and mixed terms are 0.
    """
    return _alone(objective, hessian_steps(at, fixed, bounds, step))


def hessian_steps(at: dict[str, float], fixed: dict[str, float] | None = None, bounds=BOUNDS, step: float = 0.2):
    names = tuple(at)
    f = _Points(names, fixed, bounds)
    x, n = f.clip(np.array([at[k] for k in names], float)), len(at)
    up, down = np.minimum(x + step, f.high) - x, x - np.maximum(x - step, f.low)
    shifts: list[np.ndarray] = [np.zeros(n)]

    def ask(*places: tuple[int, float]) -> int:
        shift = np.zeros(n)
        for i, by in places:
            shift[i] = by
        shifts.append(shift)
        return len(shifts) - 1

    diagonal, mixed = {}, {}
    for i in range(n):
        if up[i] > 0 and down[i] > 0:
            ahead, back = up[i], -down[i]
        else:  # two steps away from the bound
            way = 1.0 if up[i] > 0 else -1.0
            far = min(2 * step, f.high[i] - x[i] if way > 0 else x[i] - f.low[i])
            ahead, back = way * far / 2, way * far
        if ahead != back:
            diagonal[i] = (ask((i, ahead)), ask((i, back)), ahead, back)
        for j in range(i):
            if min(up[i], down[i], up[j], down[j]) > 0:
                corners = [ask((i, a), (j, b)) for a in (up[i], -down[i]) for b in (up[j], -down[j])]
                mixed[i, j] = (corners, (up[i] + down[i]) * (up[j] + down[j]))
    v = yield f.of(x + np.array(shifts))
    out = np.zeros((n, n))
    for i, (a, b, p, q) in diagonal.items():  # second derivative of the parabola through three points
        out[i, i] = 2 * ((v[a] - v[0]) / p - (v[b] - v[0]) / q) / (p - q)
    for (i, j), ((a, b, c, d), area) in mixed.items():
        out[i, j] = out[j, i] = (v[a] - v[b] - v[c] + v[d]) / area
    return out


def covariance(curvature: np.ndarray, errordef: float = 0.5) -> np.ndarray:
    """Inverse curvature times 2 errordef. errordef 0.5 on -2 log L gives the inverse curvature; 1 gives one standard deviation."""
    return 2 * errordef * np.linalg.pinv(curvature)


def global_fit(objective: Objective, start: dict[str, float] | None = None, bounds=BOUNDS, errordef: float = 0.5, **options) -> Fit:
    return _alone(objective, global_fit_steps(start, None, bounds, errordef, **options))


def global_fit_steps(start: dict[str, float] | None = None, fixed: dict[str, float] | None = None, bounds=BOUNDS, errordef: float = 0.5, **options):
    start = start or {n: (1.0 if n == "mu" else 0.0) for n in PARAMETERS}
    fit = yield from minimise_steps(start, fixed, bounds, **options)
    fit.covariance = covariance((yield from hessian_steps(fit.values, fixed, bounds)), errordef)
    return fit


def scan_points(low: float, high: float, n: int) -> list[float]:
    """n points from low, the last one a step below high."""
    return [low + i * (high - low) / n for i in range(n)]


def mu_scan(objective: Objective, fit: Fit, n: int = 21, delta: float | None = None) -> list[tuple[float, float]]:
    """(mu, q - best q) with the nuisances where the fit left them: one job. The range is 3 delta on both sides, 0.5 at least."""
    delta = delta if delta is not None else math.sqrt(abs(fit.covariance[0, 0])) if fit.covariance is not None else 0.0
    mu, reach = fit.values["mu"], max(3 * delta, 0.5)
    mus = scan_points(mu - reach, mu + reach, n)
    q = objective([{**fit.values, "mu": m} for m in mus])
    return [(m, float(v - fit.q)) for m, v in zip(mus, q, strict=True)]


def _beside(fit: Fit, name: str, at: float, bounds=BOUNDS) -> tuple[dict[str, float], np.ndarray | None]:
    """Where the other parameters are expected with one held elsewhere, and their inverse curvature, by the fit's covariance."""
    others = {k: v for k, v in fit.values.items() if k != name}
    if fit.covariance is None:
        return others, None
    i, rest = fit.names.index(name), [k for k, n in enumerate(fit.names) if n != name]
    variance = fit.covariance[i, i]
    if variance > 0:
        others = {n: float(np.clip(v + fit.covariance[fit.names.index(n), i] / variance * (at - fit.values[name]), *bounds[n])) for n, v in others.items()}
    curvature = np.linalg.pinv(fit.covariance)[np.ix_(rest, rest)]
    inverse = np.linalg.pinv(curvature)
    return others, inverse if np.all(np.linalg.eigvalsh((inverse + inverse.T) / 2) > 0) else None


def profile_scan(objective: Objective, fit: Fit, mus: list[float], fixed: dict[str, float] | None = None, **options) -> list[tuple[float, float]]:
    """(mu, q - best q) with the nuisances minimised at each mu, from where the fit expects them. All points of the scan go in step."""
    problems = []
    for m in mus:
        start, inverse = _beside(fit, "mu", m, options.get("bounds", BOUNDS))
        problems.append(minimise_steps(start, {**(fixed or {}), "mu": m}, inverse=inverse, **options))
    found, _ = in_step(objective, problems)
    return [(m, f.q - fit.q) for m, f in zip(mus, found, strict=True)]


def crossings(scan: list[tuple[float, float]], threshold: float = 1.0) -> list[float]:
    """Where the line through the points changes its side of the threshold, strictly."""
    out = []
    for (m0, q0), (m1, q1) in zip(scan, scan[1:], strict=False):
        a, b = q0 - threshold, q1 - threshold
        if a * b < 0:
            out.append(m0 + (m1 - m0) * a / (a - b))
    return out


def crossings_frame(scan: DataFrame, threshold: float = 1.0) -> DataFrame:
    """The same over a (mu, q) table, which has one row a scan point."""
    after = W.orderBy("mu")
    a, b = F.col("q") - threshold, F.col("q1") - threshold
    paired = scan.withColumns({"mu1": F.lead("mu").over(after), "q1": F.lead("q").over(after)})
    return paired.where(a * b < 0).select((F.col("mu") + (F.col("mu1") - F.col("mu")) * a / (a - b)).alias("mu"))


def finalise_columns(mu_hat: Column, low: Column, high: Column) -> dict[str, Column]:
    """p16, p84 and their half distance: distances from mu_hat widened, then cut to the limits."""
    p16, p84 = mu_hat - INFLATE * (mu_hat - low), mu_hat + INFLATE * (high - mu_hat)
    p16 = F.when(p16 < LOWEST[0], F.lit(LOWEST[1])).otherwise(p16)
    p84 = F.when(p84 > HIGHEST[0], F.lit(HIGHEST[1])).otherwise(p84)
    return {"p16": p16, "p84": p84, "delta_mu": (p84 - p16) / 2}


def finalise(mu_hat: float, found: list[float], delta: float, inflate: float = INFLATE) -> dict[str, float]:
    """The interval: the last crossing below and above mu_hat, mu_hat -+ delta where there is none; widened and cut."""
    below, above = [c for c in found if c < mu_hat], [c for c in found if c > mu_hat]
    p16 = mu_hat - inflate * (mu_hat - below[-1]) if below else mu_hat - inflate * delta
    p84 = mu_hat + inflate * (above[-1] - mu_hat) if above else mu_hat + inflate * delta
    p16 = LOWEST[1] if p16 < LOWEST[0] else p16
    p84 = HIGHEST[1] if p84 > HIGHEST[0] else p84
    return {"mu_hat": mu_hat, "p16": p16, "p84": p84, "delta_mu_hat": (p84 - p16) / 2}


def mu_scan_steps(fit: Fit, fixed: dict[str, float] | None = None, n: int = 21, delta: float | None = None):
    """mu_scan as a problem that can be run in step with others."""
    delta = delta if delta is not None else math.sqrt(abs(fit.covariance[0, 0])) if fit.covariance is not None else 0.0
    mu, reach = fit.values["mu"], max(3 * delta, 0.5)
    mus = scan_points(mu - reach, mu + reach, n)
    q = yield [{**(fixed or {}), **fit.values, "mu": m} for m in mus]
    return [(m, float(v - fit.q)) for m, v in zip(mus, q, strict=True)]


def toy_steps(start: dict[str, float] | None = None, fixed: dict[str, float] | None = None, **options):
    """Fit, and interval by the scan, of one toy."""
    fit = yield from global_fit_steps(start, fixed, **options)
    delta = math.sqrt(abs(fit.covariance[0, 0]))
    scan = yield from mu_scan_steps(fit, fixed, delta=delta)
    return fit, finalise(fit.values["mu"], crossings(scan), delta)


def interval_of(objective: Objective, fit: Fit) -> dict[str, float]:
    """Scan and interval of a fit."""
    delta = math.sqrt(abs(fit.covariance[0, 0]))
    return finalise(fit.values["mu"], crossings(mu_scan(objective, fit, delta=delta)), delta)


def predict_interval(objective: Objective, start: dict[str, float] | None = None) -> dict[str, float]:
    """Fit, scan and interval of one toy."""
    return _alone(objective, toy_steps(start))[1]


def _side_steps(fit: Fit, name: str, side: float, errordef: float, bounds, reach: float, fixed: dict[str, float] | None, options: dict):
    """Where q, minimised over all other parameters, has risen by errordef on one side, and the others there."""
    bound = bounds[name][0 if side < 0 else 1]
    first = math.sqrt(abs(fit.covariance[fit.names.index(name), fit.names.index(name)])) if fit.covariance is not None else 0.5

    def rise(at: float, start: dict[str, float] | None = None):
        expected, inverse = _beside(fit, name, at, bounds)
        found = yield from minimise_steps(start or expected, {**(fixed or {}), name: at}, bounds, inverse=inverse, **options)
        return found.q - fit.q - errordef, found.values

    inside, below, start, step = fit.values[name], -errordef, None, max(first, 1e-2)
    while True:  # outwards, until it has risen far enough
        outside = max(inside + side * step, bound) if side < 0 else min(inside + side * step, bound)
        above, start = yield from rise(outside)
        if above >= 0 or outside == bound:
            break
        inside, below, step = outside, above, 2 * step
    for _ in range(60 if above > 0 else 0):  # inwards, by halving where the secant is slow
        if abs(outside - inside) <= reach or abs(above) <= reach * errordef:
            break
        share = below / (below - above)
        middle = inside + min(max(share, 0.1), 0.9) * (outside - inside)
        value, start = yield from rise(middle, start)
        inside, below, outside, above = (inside, below, middle, value) if value > 0 else (middle, value, outside, above)
    return (outside if above <= 0 else inside + below / (below - above) * (outside - inside)), start


def minos(objective: Objective, fit: Fit, name: str = "mu", errordef: float = 1.0, bounds=BOUNDS, reach: float = 1e-3, fixed: dict[str, float] | None = None, **options) -> tuple[float, float]:
    """Where q, minimised over all other parameters, is errordef above its minimum, below and above the fitted value.

    A side that never rises that far within the bounds gives the bound. The place is found to ``reach``, in the parameter or in q. Both
    sides go in step.
    """
    (low, high), _ = in_step(objective, [_side_steps(fit, name, side, errordef, bounds, reach, fixed, options) for side in (-1.0, 1.0)])
    return low[0], high[0]


def impacts_of(objective: Objective, fit: Fit, names: list[str], threshold: float = 1.0, bounds=BOUNDS, reach: float = 1e-3, fixed: dict[str, float] | None = None, **options) -> tuple[dict[str, dict[str, float]], int]:
    """impact_of of many nuisances, all sides in step, and the number of calls."""

    def steps(name: str, side: float):
        at, start = yield from _side_steps(fit, name, side, threshold, bounds, reach, fixed, options)
        found = yield from minimise_steps(start, {**(fixed or {}), name: at}, bounds, **options)
        return at, found.values["mu"]

    sides = [(name, which, side) for name in names for which, side in (("down", -1.0), ("up", 1.0))]
    found, calls = in_step(objective, [steps(name, side) for name, _, side in sides])
    out: dict[str, dict[str, float]] = {name: {} for name in names}
    for (name, which, _), (at, mu) in zip(sides, found, strict=True):
        out[name] |= {f"nu_{which}": at, f"mu_{which}": mu, f"impact_{which}": mu - fit.values["mu"]}
    return out, calls


def impact_of(objective: Objective, fit: Fit, name: str, threshold: float = 1.0, bounds=BOUNDS, fixed: dict[str, float] | None = None, **options) -> dict[str, float]:
    """The values of one nuisance where the profiled q rises by the threshold (or its bound), and what mu does there."""
    return impacts_of(objective, fit, [name], threshold, bounds, fixed=fixed, **options)[0][name]
