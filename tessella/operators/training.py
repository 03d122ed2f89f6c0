"""Training of networks by summed gradients: one job an epoch, Adam on the driver, and a run that ended goes on after its last epoch.

A task runs its batches forwards and backwards in numpy and hands on one vector: its part of the gradient, of the loss and of the number
of events. Parts are added by a few tasks, each of which streams a share of them, so that the driver sees few vectors of the network's
size however many tasks there are. Epochs are stored with the state of the optimiser.

Class networks learn from class-weighted cross entropy. Ratio nets learn from samples of base points that are aligned once: the rows of
all samples with one batch number are packed into one row of a written table, which every epoch reads without a shuffle.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.scoring import Network
from tessella.operators.trees import Store
from tessella.operators.yields import monomials
from tessella.schema import BASE_POINTS, MONOMIALS
from tessella.sources.events import index_rows
from tessella.sources.scratch import cut

#: Rows of a sample in an aligned batch.
BATCH_ROWS = 4096


# -- networks as vectors -------------------------------------------------------------------------------------------------
def flat(network: Network) -> np.ndarray:
    """Weights and bias of all layers, one after another."""
    return np.concatenate([np.concatenate([np.asarray(w, float).ravel(), np.asarray(b, float)]) for w, b in network.layers])


def with_parameters(network: Network, vector: np.ndarray) -> Network:
    layers, at = [], 0
    for w, b in network.layers:
        rows, columns = np.shape(w)
        weights = vector[at : at + rows * columns].reshape(rows, columns)
        at += rows * columns
        layers.append((weights.tolist(), vector[at : at + len(b)].tolist()))
        at += len(b)
    return replace(network, layers=tuple(layers))


def random_network(features: tuple[str, ...], hidden: tuple[int, ...], outputs: int, output: str = "softmax", mean: tuple = (), variance: tuple = (), seed: int = 1) -> Network:
    """Weights uniform within +-sqrt(6 / (inputs + outputs)), no bias."""
    rng, sizes = np.random.default_rng(seed), (len(features), *hidden, outputs)
    layers = tuple((rng.uniform(-1, 1, (a, b)) * math.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False))
    return Network(features, tuple((w.tolist(), b.tolist()) for w, b in layers), output, mean, variance)


def _forwards(network: Network, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The inputs of each layer, and the last layer's sums."""
    if network.mean:
        sd = np.sqrt(np.asarray(network.variance))
        x = np.divide(x - np.asarray(network.mean), sd, out=np.zeros_like(x), where=sd > 0)
    inputs = []
    for i, (w, b) in enumerate(network.layers):
        inputs.append(x)
        x = x @ np.asarray(w) + np.asarray(b)
        if i < len(network.layers) - 1:
            x = np.maximum(x, 0)
    return inputs, x


def _backwards(network: Network, inputs: list[np.ndarray], at_output: np.ndarray) -> np.ndarray:
    """The gradient as a flat vector, from the loss's derivative by the last layer's sums."""
    out = []
    for (w, _), x in zip(reversed(network.layers), reversed(inputs), strict=True):
        out.append(np.concatenate([(x.T @ at_output).ravel(), at_output.sum(axis=0)]))
        at_output = (at_output @ np.asarray(w).T) * (x > 0)  # of a relu; the first layer's is not used
    return np.concatenate(out[::-1])


# -- losses --------------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class ClassLoss:
    """Cross entropy of the softmax, times weight and class weight, over the number of events. Rows: features, weight, label."""

    classes: int = 4
    class_weights: tuple[float, ...] = ()

    def columns(self, network: Network) -> list[str]:
        return [*network.features, "weight", "label"]

    def part(self, network: Network, batch: pa.RecordBatch) -> tuple[float, float, np.ndarray]:
        """Loss, number of events and gradient of a batch."""
        n = len(network.features)
        x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)])
        weight, label = (batch.column(n + i).to_numpy(zero_copy_only=False) for i in range(2))
        here = (label >= 0) & (label < self.classes)
        x, weight, label = x[here], weight[here].astype(float), label[here].astype(np.int64)
        if self.class_weights:
            weight = weight * np.asarray(self.class_weights)[label]
        inputs, z = _forwards(network, x)
        z = z - z.max(axis=1, keepdims=True) if len(z) else z
        log = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        own = log[np.arange(len(log)), label]
        at_output = np.exp(log)
        at_output[np.arange(len(log)), label] -= 1.0
        return float(-(weight * own).sum()), float(len(x)), _backwards(network, inputs, at_output * weight[:, None])


@dataclass(frozen=True)
class RatioLoss:
    """Cross entropy between each base point's rows and the nominal ones over aligned batches; the net gives the monomials' coefficients.

    bias: per base point what the yields' ratio already says.
    """

    points: tuple[tuple[float, ...], ...] = BASE_POINTS
    combinations: tuple = MONOMIALS
    bias: tuple[float, ...] = ()

    def columns(self, network: Network) -> list[str]:
        return ["sizes", "features", "weights"]

    def part(self, network: Network, batch: pa.RecordBatch) -> tuple[float, float, np.ndarray]:
        v = np.array([monomials(p, self.combinations) for p in self.points])
        loss, n, gradient = 0.0, 0.0, np.zeros(len(flat(network)))
        for sizes, features, weights in zip(*(batch.column(c) for c in ("sizes", "features", "weights")), strict=True):
            sizes = np.asarray(sizes.as_py())
            x = np.frombuffer(features.as_buffer()).reshape(-1, len(network.features))
            w, point = np.frombuffer(weights.as_buffer()), np.repeat(np.arange(len(sizes)), sizes)
            inputs, delta = _forwards(network, x)
            nominal, at_output = point == 0, np.zeros_like(delta)
            # a nominal row counts against every other point
            log = delta[nominal] @ v[1:].T
            loss += float((w[nominal][:, None] * (np.logaddexp(0, log) - math.log(2))).sum())
            at_output[nominal] = (w[nominal][:, None] / (1 + np.exp(-log))) @ v[1:]
            log, bias = (delta * v[point]).sum(axis=1), np.asarray(self.bias or (1.0,) * len(self.points))[point]
            rest = ~nominal
            loss += float((w[rest] * (np.logaddexp(0, -log[rest]) / bias[rest] - math.log(2))).sum())
            at_output[rest] = (-(w / bias) / (1 + np.exp(log)))[rest][:, None] * v[point[rest]]
            gradient += _backwards(network, inputs, at_output)
            n += len(x)
        return loss, n, gradient


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        for part in batch.column("part"):
            new = np.frombuffer(part.as_buffer())
            held = new.copy() if held is None else held + new
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([held.tobytes()], pa.binary())], ["slot", "part"])


def gradient_of(table: DataFrame, network: Network, loss, mean: bool = True) -> tuple[float, np.ndarray]:
    """Loss and gradient over the table, over the number of events if asked for: one job."""
    slots = max(1, math.isqrt(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 + len(flat(network)))
        for batch in batches:
            if batch.num_rows:
                a, n, g = loss.part(network, batch)
                held += np.concatenate([[a, n], g])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % slots]), pa.array([held.tobytes()], pa.binary())], ["slot", "part"])

    parts = table.select(*loss.columns(network)).mapInArrow(run, "slot long, part binary")
    rows = parts.repartition(slots, "slot").mapInArrow(_streamed, "slot long, part binary").collect()  # one row a slot
    out = np.sum([np.frombuffer(r.part) for r in rows], axis=0) if rows else np.zeros(2 + len(flat(network)))
    value, n, gradient = out[0], out[1], out[2:]
    return (float(value / n), gradient / n) if mean and n else (float(value), gradient)


# -- epochs --------------------------------------------------------------------------------------------------------------
@dataclass
class Adam:
    """Decay rates of the two moments and what is added to the root."""

    rate: float = 1e-3
    first: float = 0.9
    second: float = 0.999
    epsilon: float = 1e-7
    step: int = 0
    m: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def move(self, x: np.ndarray, gradient: np.ndarray, rate: float | None = None) -> np.ndarray:
        if not self.step:
            self.m, self.v = np.zeros_like(x), np.zeros_like(x)
        self.step += 1
        self.m = self.first * self.m + (1 - self.first) * gradient
        self.v = self.second * self.v + (1 - self.second) * gradient**2
        m, v = self.m / (1 - self.first**self.step), self.v / (1 - self.second**self.step)
        return x - (self.rate if rate is None else rate) * m / (np.sqrt(v) + self.epsilon)


def rate_at(epoch: int, start: float, epochs: int, phase_out: int) -> float:
    """Constant, then falling in a line to 0 over the last phase_out epochs."""
    return start if phase_out <= 0 else start * min(1.0, (epochs - epoch) / phase_out)


def _save(store: Store, epoch: int, network: Network, adam: Adam, loss: float) -> None:
    body = json.dumps({"x": flat(network).tolist(), "m": adam.m.tolist(), "v": adam.v.tolist(), "step": adam.step, "loss": loss})
    store.spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{store.path}/epoch-{epoch}")


def train(table: DataFrame, network: Network, loss, epochs: int, adam: Adam | None = None, store: Store | None = None, phase_out: int = 0, mean: bool = True,
          watch: Callable[[int, float], None] | None = None) -> tuple[Network, list[float]]:
    """The network after so many epochs of one full gradient each, and the loss before each. With a store the epochs it has are not repeated."""
    adam, losses = adam or Adam(), []
    while store is not None and len(losses) < epochs and store.has(f"epoch-{len(losses)}"):
        state = json.loads(store.spark.read.text(f"{store.path}/epoch-{len(losses)}").first().value)
        losses.append(state["loss"])
        if len(losses) == epochs or not store.has(f"epoch-{len(losses)}"):
            network = with_parameters(network, np.array(state["x"]))
            adam.m, adam.v, adam.step = np.array(state["m"]), np.array(state["v"]), state["step"]
    for epoch in range(len(losses), epochs):
        value, gradient = gradient_of(table, network, loss, mean)
        network = with_parameters(network, adam.move(flat(network), gradient, rate_at(epoch, adam.rate, epochs, phase_out)))
        losses.append(value)
        if store is not None:
            _save(store, epoch, network, adam, value)
        if watch:
            watch(epoch, value)
    return network, losses


# -- aligned samples -----------------------------------------------------------------------------------------------------
def aligned(samples: list[DataFrame], features: tuple[str, ...], order: tuple[str, ...], batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The written table of batches: (batch, sizes, features, weights). Sample k is that of base point k; rows are numbered by ``order``.

    Batch b has the rows b * batch_rows on of every sample. The batches of the shortest sample count, and of its last batch as many rows as
    it has. One shuffle puts a batch together; every epoch then reads whole batches.
    """
    columns = [*(F.col(f).cast("double").alias(f"__{i}") for i, f in enumerate(features)), F.col("weight").cast("double").alias("__w")]
    every = None
    for k, sample in enumerate(samples):
        rows = sample.select(*columns, F.lit(k).alias("__point"), *(F.col(o).alias(f"__o{i}") for i, o in enumerate(order)))
        every = rows if every is None else every.unionByName(rows)
    numbered = index_rows(every, [F.col("__point"), *(F.col(f"__o{i}") for i in range(len(order)))], "__row")
    first = {r["__point"]: (r.first, r.n) for r in numbered.groupBy("__point").agg(F.min("__row").alias("first"), F.count("*").alias("n")).collect()}  # one row a sample
    shortest = min((first[k][1] if k in first else 0 for k in range(len(samples))), default=0)
    start = F.element_at(F.array(*(F.lit(first[k][0] if k in first else 0) for k in range(len(samples)))), F.col("__point") + 1)
    placed = numbered.withColumn("__at", F.col("__row") - start).where(F.col("__at") < shortest).withColumn("batch", F.floor(F.col("__at") / batch_rows).cast("long"))
    n, points = len(features), len(samples)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(number: int, x: list[np.ndarray], w: list[np.ndarray], p: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.bincount(np.concatenate(p), minlength=points)
            values = [number, sizes.tolist(), np.concatenate(x).tobytes(), np.concatenate(w).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary()), strict=True)], ["batch", "sizes", "features", "weights"])

        at, held = None, ([], [], [])
        for batch in batches:
            number = batch.column("batch").to_numpy()
            for begin, end in zip(*(lambda e: (e[:-1], e[1:]))(np.r_[np.flatnonzero(np.r_[True, number[1:] != number[:-1]]), len(number)]), strict=True):
                if begin == end:
                    continue
                if number[begin] != at:
                    if at is not None:
                        yield packed(at, *held)
                    at, held = int(number[begin]), ([], [], [])
                part = batch.slice(begin, end - begin)
                held[0].append(np.column_stack([part.column(i).to_numpy() for i in range(n)]))
                held[1].append(part.column(n).to_numpy())
                held[2].append(part.column(n + 1).to_numpy())
        if at is not None:
            yield packed(at, *held)

    dealt = placed.repartition("batch").sortWithinPartitions("batch", "__point", "__at").select(*(f"__{i}" for i in range(n)), "__w", "__point", "batch")
    return cut(dealt.mapInArrow(pack, "batch long, sizes array<int>, features binary, weights binary"))
