"""Trees grown level by level on binned events, and boosting with what an event carries from tree to tree in a versioned table.

Events are binned once: a row of the written table holds a byte for each feature; derived features that the events lack are computed batch
by batch as they are binned. A level of all trees that are grown together is one
job: a task adds up (tree, node, feature, bin, group) histograms of its rows in numpy and hands on one row for each node and feature that
it met. Only the smaller child of a split is filled, its sibling is the parent less that. The driver sees histograms, whose size is
nodes x features x bins x groups x sums whatever the number of events, and chooses the splits.

An objective says what is added up and what a split is worth: Parametric (log-polynomial yields of base points) or Newton (gradients and
second derivatives, for class scores or for tags).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.kinematics import DERIVE
from tessella.operators.scoring import Leaf, Split
from tessella.operators.variations import derived_as_they_are
from tessella.operators.yields import design
from tessella.schema import BASE_POINTS, BINNING, MONOMIALS, PRIMARY
from tessella.sources import models
from tessella.sources.scratch import cut

#: Losses are compared to so many digits; then the earlier feature and the lower threshold win.
DIGITS = 6


# -- bins ----------------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Edges:
    """Thresholds of each feature. Bin b of a feature is (threshold b - 1, threshold b]; the last two are above all and without a value."""

    of: dict[str, tuple[float, ...]]

    @property
    def features(self) -> list[str]:
        return list(self.of)

    @property
    def bins(self) -> int:
        return max(map(len, self.of.values())) + 2

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """rows x features, one byte each."""
        out = np.empty((len(columns[0]), len(columns)), np.uint8)
        for i, (x, edges) in enumerate(zip(columns, self.of.values(), strict=True)):
            out[:, i] = np.where(np.isnan(x), self.bins - 1, np.searchsorted(edges, x, "left"))
        return out


def equal_edges(features: Iterable[str] = tuple(BINNING)) -> Edges:
    """The edges of the standard histograms."""
    return Edges({f: tuple(low + k * ((high - low) / n) for k in range(n + 1)) for f, (n, low, high) in ((f, BINNING[f]) for f in features)})


def quantile_edges(events: DataFrame, features: Iterable[str], bins: int = 64, accuracy: int = 10_000) -> Edges:
    """Quantiles of each feature by mergeable sketches, in one pass; equal ones count once."""
    features = list(features)
    if not 2 <= bins <= 250:
        raise ValueError("a bin is a byte")
    shares = [k / bins for k in range(1, bins)]
    value = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None))
    row = events.agg(*(F.percentile_approx(value(f), shares, accuracy).alias(f"q{i}") for i, f in enumerate(features))).first()
    return Edges({f: tuple(sorted(set(row[i] or ()))) for i, f in enumerate(features)})


def binned(events: DataFrame, edges: Edges, *keep: str) -> DataFrame:
    """The written table of (bins, keep): what every level and every tree reads. Derived features that events lack come from the primary ones."""
    lacking = {f for f in edges.features if f in DERIVE and f not in events.columns}
    names = list(dict.fromkeys([f for f in edges.features if f not in lacking] + (list(PRIMARY) if lacking else [])))
    rows = events.select(*(F.col(f).cast("double").alias(f"__{i}") for i, f in enumerate(names)), *keep)
    schema = T.StructType([T.StructField("bins", T.BinaryType()), *(rows.schema[k] for k in keep)])
    n = len(edges.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {f: batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i, f in enumerate(names)}
            if lacking:
                nulls = {f: batch.column(i).is_null().to_numpy(zero_copy_only=False) for i, f in enumerate(names)}
                derived = derived_as_they_are(values, nulls)
                values |= {f: derived[f] for f in lacking}
            codes = edges.codes([values[f] for f in edges.features])
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets.buffers()[1], pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([packed, *batch.columns[len(names) :]], ["bins", *keep])

    return cut(rows.mapInArrow(run, schema))


def codes_of(batch: pa.RecordBatch) -> np.ndarray:
    """rows x features: a view of the batch, whose rows all have as many bytes."""
    column = batch.column("bins")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + batch.num_rows + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(batch.num_rows, -1)


# -- trees on bins -------------------------------------------------------------------------------------------------------
@dataclass
class Grown:
    """A tree by node number: children and split (feature, bin) of inner nodes, values of leaves. A row without a value goes right."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[tuple[float, ...]] = field(default_factory=lambda: [()])

    def split(self, node: int, feature: int, at: int) -> int:
        """The number of the left child; the right one follows."""
        self.feature[node], self.bin[node], self.left[node] = feature, at, len(self.feature)
        for values, new in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.value, ())):
            values += [new, new]
        return self.left[node]

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The node at which each row of codes ends."""
        feature, at, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while len(rows := rows[left[node[rows]] >= 0]):
            here = node[rows]
            node[rows] = left[here] + (codes[rows, feature[here]] > at[here])
        return node

    def values(self, codes: np.ndarray) -> np.ndarray:
        width = max(map(len, self.value))
        return np.array([v or (0.0,) * width for v in self.value])[self.place(codes)]

    def tree(self, edges: Edges, node: int = 0) -> Split | Leaf:
        """As a tree over the features themselves."""
        if self.left[node] < 0:
            return Leaf(self.value[node])
        name = edges.features[self.feature[node]]
        return Split(name, edges.of[name][self.bin[node]], self.tree(edges, self.left[node]), self.tree(edges, self.left[node] + 1))

    @classmethod
    def of(cls, tree: Split | Leaf, edges: Edges) -> Grown:
        """Of a tree whose thresholds are edges."""
        out = cls()

        def put(part: Split | Leaf, node: int) -> None:
            if isinstance(part, Leaf):
                out.value[node] = part.value
            else:
                child = out.split(node, edges.features.index(part.feature), edges.of[part.feature].index(part.threshold))
                put(part.left, child)
                put(part.right, child + 1)

        put(tree, 0)
        return out


def placed(table: DataFrame, tree: Grown, *keep: str) -> DataFrame:
    """keep of a binned table's rows, and the value of each row's leaf as an array column."""
    width = max(map(len, tree.value))
    schema = T.StructType([*(table.schema[k] for k in keep), T.StructField("value", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
            values = pa.ListArray.from_arrays(offsets, pa.array(tree.values(codes_of(batch)).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), values], [*keep, "value"])

    return table.mapInArrow(run, schema)


def pruned(tree: Split | Leaf) -> Split | Leaf:
    """Splits whose sides are leaves of one value become that leaf."""
    if isinstance(tree, Leaf):
        return tree
    left, right = pruned(tree.left), pruned(tree.right)
    if isinstance(left, Leaf) and left == right:
        return left
    return Split(tree.feature, tree.threshold, left, right, tree.missing_left)


# -- objectives ----------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Parametric:
    """Cross entropy between base points and the nominal point (number 0): rows have weight and point."""

    points: tuple[tuple[float, ...], ...] = BASE_POINTS
    combinations: tuple = MONOMIALS
    min_size: int = 50
    trees = 1
    sums = 2

    @property
    def groups(self) -> int:
        return len(self.points)

    def rows(self, batch: pa.RecordBatch) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        weight = batch.column("weight").to_numpy(zero_copy_only=False)
        return [(batch.column("point").to_numpy(zero_copy_only=False), [weight, np.ones(len(weight))])]

    def leaf(self, total: np.ndarray) -> tuple[float, ...]:
        """Coefficients of the log-polynomial of the yields; 0 where a point has none."""
        w = total[:, 0]
        if w.min() <= 0:
            return (0.0,) * len(self.combinations)
        return tuple((design(self.points, self.combinations)["M"].T @ np.log(w[1:] / w[0])).tolist())

    def opens(self, total: np.ndarray) -> bool:
        return bool((total[:, 1] >= 2 * self.min_size).all())

    def losses(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of splits by their sums (... x groups x 2); NaN where a side is too small."""
        mv = design(self.points, self.combinations)["MV"]
        out = np.zeros(left.shape[:-2])
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for side in (left, right):
                w0, w = side[..., :1, 0], side[..., 1:, 0]
                x = np.log(w / w0) @ mv.T
                out += (w0 * (np.logaddexp(0, x) - math.log(2)) + w * (np.logaddexp(0, -x) - math.log(2))).sum(axis=-1)
        good = np.all((left[..., 1] >= self.min_size) & (right[..., 1] >= self.min_size) & (left[..., 0] > 0) & (right[..., 0] > 0), axis=-1)
        return np.where(good, out, np.nan)

    def closed(self, total: np.ndarray, parent: np.ndarray) -> tuple[float, ...]:
        """A child too small to be split has its parent's coefficients."""
        return self.leaf(parent)


@dataclass(frozen=True)
class Newton:
    """Second-order steps: rows have margins (one for each tree of a round), weight and target, and the task computes the derivatives.

    kind "softprob": target is the class, one tree a class. kind "tags": target is 0 or 1, loss log(1 + e^f) or log(1 + e^-f).
    """

    kind: str = "softprob"
    classes: int = 4
    rate: float = 0.3
    l2: float = 1.0
    l1: float = 0.0
    gamma: float = 0.0
    min_hessian: float = 1.0
    groups = 1
    sums = 2

    @property
    def trees(self) -> int:
        return self.classes if self.kind == "softprob" else 1

    def derivatives(self, margins: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows x trees."""
        if self.kind == "softprob":
            p = np.exp(margins - margins.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            return weight[:, None] * (p - (target[:, None] == np.arange(self.classes))), np.maximum(2.0 * weight[:, None] * p * (1.0 - p), 1e-16)
        if self.kind == "tags":
            p = 1.0 / (1.0 + np.exp(-margins))
            return weight[:, None] * (p - target[:, None]), weight[:, None] * p * (1.0 - p)
        raise ValueError(f"unknown kind {self.kind}")

    def rows(self, batch: pa.RecordBatch) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        margins = batch.column("margins").flatten().to_numpy().reshape(batch.num_rows, self.trees)
        g, h = self.derivatives(margins, batch.column("target").to_numpy(zero_copy_only=False), batch.column("weight").to_numpy(zero_copy_only=False))
        none = np.zeros(batch.num_rows, np.int64)
        return [(none, [g[:, k], h[:, k]]) for k in range(self.trees)]

    def _score(self, total: np.ndarray) -> np.ndarray:
        g = np.maximum(np.abs(total[..., 0, 0]) - self.l1, 0.0)
        return g * g / (total[..., 0, 1] + self.l2)

    def leaf(self, total: np.ndarray) -> tuple[float, ...]:
        """The step, learning rate included."""
        g, h = total[0]
        return (float(-self.rate * np.sign(g) * max(abs(g) - self.l1, 0.0) / (h + self.l2)),)

    def opens(self, total: np.ndarray) -> bool:
        return bool(total[0, 1] >= 2 * self.min_hessian)

    def losses(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Minus the gain; NaN where there is none or a side is too light."""
        gain = (self._score(left) + self._score(right) - self._score(left + right)) / 2 - self.gamma
        return np.where((gain > 10.0**-DIGITS) & (left[..., 0, 1] >= self.min_hessian) & (right[..., 0, 1] >= self.min_hessian), -gain, np.nan)

    def closed(self, total: np.ndarray, parent: np.ndarray) -> tuple[float, ...]:
        return self.leaf(total)


# -- growing -------------------------------------------------------------------------------------------------------------
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (tree, node, feature): one row each, with the sum of the packed arrays."""
    at, held = None, None
    make = lambda key, x: pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([x.tobytes()], pa.binary())], ["tree", "node", "feature", "part"])
    for batch in batches:
        for *key, part in zip(*(batch.column(c).to_pylist() for c in ("tree", "node", "feature", "part")), strict=True):
            new = np.frombuffer(part)
            if key == at:
                held += new
            else:
                if at is not None:
                    yield make(at, held)
                at, held = key, new.copy()
    if at is not None:
        yield make(at, held)


def histograms(table: DataFrame, edges: Edges, objective, grown: list[Grown], wanted: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The sums (features x bins x groups x sums) of the wanted (tree, node), in one job."""
    n, bins, groups, sums = len(edges.features), edges.bins, objective.groups, objective.sums
    slots = []
    for k, tree in enumerate(grown):
        slots.append(np.full(len(tree.feature), -1))
        slots[k][[node for j, node in wanted if j == k]] = np.arange(sum(j == k for j, _ in wanted))
    nodes = [[node for j, node in wanted if j == k] for k in range(len(grown))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [np.zeros((len(of), n, bins * groups, sums)) for of in nodes]
        met = [np.zeros(len(of), bool) for of in nodes]
        for batch in batches:
            codes = codes_of(batch)
            for k, (group, values) in enumerate(objective.rows(batch)):
                if not nodes[k]:
                    continue
                slot = slots[k][grown[k].place(codes)]
                rows = np.flatnonzero(slot >= 0)
                met[k][slot[rows]] = True
                base = slot[rows] * (bins * groups) + group[rows]
                for f in range(n):
                    at = base + codes[rows, f].astype(np.int64) * groups
                    for s, v in enumerate(values):
                        filled[k][:, f, :, s] += np.bincount(at, v[rows], len(nodes[k]) * bins * groups).reshape(len(nodes[k]), -1)
        for k, of in enumerate(nodes):
            for i in np.flatnonzero(met[k]).tolist():
                columns = [pa.array([x] * n, pa.int32()) for x in (k, of[i])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(n), pa.int32()), pa.array([filled[k][i, f].tobytes() for f in range(n)], pa.binary())], ["tree", "node", "feature", "part"])

    parts = table.mapInArrow(run, "tree int, node int, feature int, part binary")
    dealt = parts.repartition("tree", "node", "feature").sortWithinPartitions("tree", "node", "feature")
    out = {w: np.zeros((n, bins, groups, sums)) for w in wanted}
    for r in dealt.mapInArrow(_added, parts.schema).collect():  # one row a node and feature
        out[r.tree, r.node][r.feature] = np.frombuffer(r.part).reshape(bins, groups, sums)
    return out


def best_of(hist: np.ndarray, objective) -> tuple[int, int] | None:
    """Feature and bin of the best split; rows without a value are on the right."""
    left = np.cumsum(hist[:, :-2], axis=1)
    losses = objective.losses(left, hist.sum(axis=1)[:, None] - left)
    if np.isnan(losses).all():
        return None
    rounded = np.where(np.isnan(losses), np.inf, np.round(losses, DIGITS))
    at = int(rounded.argmin())  # the first of the least, by feature, then threshold
    return divmod(at, rounded.shape[1])


def grow(table: DataFrame, edges: Edges, objective, depth: int) -> tuple[list[Grown], int]:
    """The trees of a round, with so many levels of splits at most, and the number of jobs, which is that of the levels."""
    grown, jobs = [Grown() for _ in range(objective.trees)], 0
    open_, fill, rest, before = [(k, 0) for k in range(objective.trees)], [(k, 0) for k in range(objective.trees)], [], {}
    for level in range(depth):
        if not open_:
            break
        found = histograms(table, edges, objective, grown, fill)
        jobs += 1
        for (k, node), parent, sibling in rest:
            found[k, node] = before[k, parent] - found[k, sibling]
        asked, open_, fill, rest = open_, [], [], []
        for k, node in asked:
            tree, hist = grown[k], found[k, node]
            total = hist[0].sum(axis=0)
            split = best_of(hist, objective) if objective.opens(total) else None
            if split is None:
                tree.value[node] = objective.leaf(total)
                continue
            side = hist[split[0], : split[1] + 1].sum(axis=0)
            sides = (side, total - side)
            child = tree.split(node, *split)
            goes_on = [level + 1 < depth and objective.opens(s) for s in sides]
            for i, s in enumerate(sides):
                tree.value[child + i] = objective.leaf(s) if objective.opens(s) else objective.closed(s, total)
            open_ += [(k, child + i) for i in range(2) if goes_on[i]]
            if all(goes_on):
                small = int(sides[1][:, -1].sum() < sides[0][:, -1].sum())
                fill.append((k, child + small))
                rest.append(((k, child + 1 - small), node, child + small))
            elif any(goes_on):
                fill.append((k, child + goes_on.index(True)))
        before = found
    return grown, jobs


# -- boosting ------------------------------------------------------------------------------------------------------------
class Store:
    """Trees by number, and versions of the table that events carry from tree to tree, in one folder that all machines share.

    A version counts once it is written whole. A run that ended goes on after its last tree: with a version that is missing it writes that
    one from the tree and the version before, else it grows the next tree. Only the two newest versions stay.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        path, files = self._at(f"{name}/_SUCCESS")
        return files.exists(path)

    def trees(self) -> list[list[Split | Leaf]]:
        out: list = []
        while self.has(f"tree-{len(out)}"):
            out.append(models.load(self.spark, f"{self.path}/tree-{len(out)}"))
        return out

    def put_trees(self, number: int, trees: list[Split | Leaf]) -> None:
        models.save(self.spark, trees, f"{self.path}/tree-{number}")

    def version(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version-{number}")

    def put_version(self, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/version-{number}")
        path, files = self._at(f"version-{number - 2}")
        files.delete(path, True)


def _moved(table: DataFrame, step) -> DataFrame:
    """table with one column replaced by what step (name, batch -> array) gives."""
    name, compute = step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(name)
            yield batch.set_column(at, batch.schema.field(at), compute(batch))

    return table.mapInArrow(run, table.schema)


def boost(store: Store, start: Callable[[], DataFrame], edges: Edges, objective, rounds: int, depth: int, step) -> list[list[Split | Leaf]]:
    """Grow the rounds that the store lacks. start() makes the first version; step(round, grown trees) is what a round does to a version."""
    done = store.trees()
    if not done and not store.has("version-0"):
        store.put_version(0, start())
    for k in range(rounds):
        if k >= len(done):
            done.append([g.tree(edges) for g in grow(store.version(k), edges, objective, depth)[0]])
            store.put_trees(k, done[k])
        if not store.has(f"version-{k + 1}") and (k + 1 == len(done) or store.has(f"version-{k}")):
            store.put_version(k + 1, _moved(store.version(k), step(k, [Grown.of(t, edges) for t in done[k]])))
    return done


def boost_parametric(store: Store, events: DataFrame, edges: Edges, rounds: int, depth: int = 3, rate: float = 0.2, first_full: bool = False,
                     objective: Parametric = Parametric(), keep: tuple[str, ...] = ()) -> list[list[Split | Leaf]]:
    """Parametric trees in a row: each one takes its share off the weights of all points but the nominal one, the first in full if asked for.

    events: the features, weight and point. The version after tree k has the weights that tree k + 1 is grown on.
    """
    v = np.array([[float(np.prod([dict(zip(("nu_tes", "nu_jes", "nu_met"), p, strict=True))[n] for n in c])) for c in objective.combinations] for p in objective.points])

    def step(k: int, trees: list[Grown]):
        share = 1.0 if first_full and k == 0 else rate

        def compute(batch: pa.RecordBatch) -> pa.Array:
            weight, point = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("weight", "point"))
            delta = trees[0].values(codes_of(batch))
            return pa.array(np.where(point == 0, weight, weight * np.exp(-share * (delta * v[point]).sum(axis=1))))

        return "weight", compute

    start = lambda: binned(events.withColumns({"weight": F.col("weight").cast("double"), "point": F.col("point").cast("int")}), edges, "weight", "point", *keep)
    return boost(store, start, edges, objective, rounds, depth, step)


def boost_newton(store: Store, events: DataFrame, edges: Edges, rounds: int, depth: int = 4, objective: Newton = Newton(), keep: tuple[str, ...] = ()) -> list[list[Split | Leaf]]:
    """Second-order boosting: the version after a round has the margins with that round's steps. events: features, weight, target."""
    k = objective.trees

    def step(_: int, trees: list[Grown]):
        def compute(batch: pa.RecordBatch) -> pa.Array:
            codes = codes_of(batch)
            more = np.column_stack([t.values(codes)[:, 0] for t in trees])
            margins = batch.column("margins").flatten().to_numpy().reshape(batch.num_rows, k) + more
            return pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k), pa.array(margins.ravel()))

        return "margins", compute

    def start() -> DataFrame:
        ready = events.withColumns({"weight": F.col("weight").cast("double"), "target": F.col("target").cast("int"), "margins": F.array(*[F.lit(0.0)] * k)})
        return binned(ready, edges, "weight", "target", "margins", *keep)

    return boost(store, start, edges, objective, rounds, depth, step)


def tagged(events: DataFrame, points: int = len(BASE_POINTS)) -> DataFrame:
    """Events of base points (column point, 0 nominal) with target 1, nominal ones with target 0 and the weight of one copy for each other
    point: what a copy a point would add up to, without the copies."""
    nominal = F.col("point") == 0
    return events.withColumns({"target": F.when(nominal, 0).otherwise(1), "weight": F.when(nominal, F.col("weight") * (points - 1)).otherwise(F.col("weight"))})
