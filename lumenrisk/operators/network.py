"""A network with one or more hidden layers (rectifiers, a logistic output) trained by Adam on mini-batches.

Steps follow each other, so a pass is a chain of tasks: Spark deals the mini-batches, in the pass's order, into runs of
bounded size, and a run's task takes all of its steps and hands weights and moments on. Where a single mini-batch is
larger than a run, a step sums its gradients instead: tasks over their rows, then Spark over the tasks, in groups; only
one vector of the weights' length a group reaches the driver, which takes the step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import scratch
from .boosting import matrix

#: Adam's decay rates and the term that keeps its step finite.
DECAY, DECAY2, TINY = 0.9, 0.999, 1e-8
#: Groups in which the tasks' gradients are added up before the driver adds the groups.
GROUPS = 8
#: Bytes of mini-batches whose steps one task takes, one after the other.
RUN_BYTES = 1 << 24
#: Passes without an improvement of the loss by so much that end the training.
PATIENCE, GAIN = 10, 1e-4


@dataclass
class Network:
    """Weights of all layers as one vector; ``sizes`` are the layers' widths from the input to the single output."""

    sizes: tuple[int, ...]
    w: np.ndarray
    losses: list[float] = field(default_factory=list)

    def layers(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        layers = self.layers(self.w)
        for k, (w, b) in enumerate(layers):
            x = x @ w + b
            x = np.maximum(x, 0) if k < len(layers) - 1 else x
        return x[:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """Sums over the rows: of the gradient, and of the logistic loss; row i counts ``times[i]`` times."""
        times = np.ones(len(x)) if times is None else times
        layers, acts = self.layers(self.w), [x]
        for k, (w, b) in enumerate(layers):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0) if k < len(layers) - 1 else z)
        z = acts[-1][:, 0]
        loss = float((times * (np.logaddexp(0, z) - y * z)).sum())
        delta, parts = (times * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y))[:, None], []
        for k in range(len(layers) - 1, -1, -1):
            parts.append(np.concatenate(((acts[k].T @ delta).ravel(), delta.sum(0))))
            if k:
                delta = (delta @ layers[k][0].T) * (acts[k] > 0)
        return np.concatenate(parts[::-1]), loss

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with x, an array) with score and predicted."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-np.clip(shared.value.margin(matrix(x)), -500, 500))))

        return rows.withColumn("score", score(F.col("x").cast("array<double>"))).withColumn("predicted", (F.col("score") > 0.5).cast("int"))


def blank(width: int, hidden: tuple[int, ...], seed: int) -> Network:
    """Uniform weights within sqrt(6 / (inputs + outputs)) of a layer, for its biases too; the last layer's are narrower."""
    sizes, rng, parts = (width, *hidden, 1), np.random.default_rng(seed), []
    for k, (a, b) in enumerate(zip(sizes, sizes[1:], strict=False)):
        bound = math.sqrt((2 if k == len(sizes) - 2 else 6) / (a + b))
        parts.append(rng.uniform(-bound, bound, a * b + b))
    return Network(sizes, np.concatenate(parts))


def batches_of(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with their mini-batch, by a hash of their values: reruns and layouts deal alike, equal rows together."""
    return rows.select(F.col("x").cast("array<double>").alias("x"), F.col("label").cast("int").alias("y")).withColumn("batch", F.pmod(F.xxhash64("x", F.lit(23)), F.lit(n)).cast("int"))


def summed(rows: DataFrame, network: Network, tasks: int = GROUPS + 1) -> tuple[np.ndarray, float, int]:
    """Gradient, loss and number of the rows (x, y): added up in tasks, then in groups (of ``tasks``, if those are more
    than there would be groups), then on the driver."""
    length = len(network.w)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros(length), 0.0, 0
        for b in batches:
            x = matrix(b.column(0).to_pandas())
            if len(x):
                g, one = network.gradient(x, b.column(1).to_numpy())
                total, loss, n = total + g, loss + one, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([loss]), pa.array([n], pa.int64())], names=["g", "loss", "n"])

    def join(part: pa.Table) -> pa.Table:
        g = np.array(part.column("g").to_pylist()).reshape(-1, length).sum(0)
        return pa.table({"g": pa.array([g.tolist()], pa.list_(pa.float64())), "loss": [float(np.sum(part.column("loss").to_numpy()))], "n": [int(np.sum(part.column("n").to_numpy()))]})

    schema = "g array<double>, loss double, n long"
    each = rows.select("x", "y").mapInArrow(add, schema)
    if tasks > GROUPS:
        each = each.withColumn("group", F.spark_partition_id() % GROUPS).groupBy("group").applyInArrow(lambda t: join(t.drop(["group"])), schema)
    some = each.collect()  # at most GROUPS rows
    return np.sum([r.g for r in some], axis=0) if some else np.zeros(length), sum(r.loss for r in some), sum(r.n for r in some)


@dataclass
class Adam:
    """A network in training: the moments of its gradient, and how many steps it took."""

    net: Network
    rate: float
    alpha: float
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    def step(self, g: np.ndarray, k: int) -> None:
        """One step by the summed gradient of ``k`` rows."""
        weighs = np.concatenate([np.concatenate((np.ones(a * b), np.zeros(b))) for a, b in zip(self.net.sizes, self.net.sizes[1:], strict=False)])
        g = (g + self.alpha * weighs * self.net.w) / k
        self.steps += 1
        self.first = DECAY * self.first + (1 - DECAY) * g
        self.second = DECAY2 * self.second + (1 - DECAY2) * g * g
        rate = self.rate * math.sqrt(1 - DECAY2**self.steps) / (1 - DECAY**self.steps)
        self.net.w = self.net.w - rate * self.first / (np.sqrt(self.second) + TINY)


#: A pass over all rows, the mini-batches in the given order: the trained state, the rows' loss and their number.
Pass = Callable[[Adam, np.ndarray], tuple[Adam, float, int]]


def _packed(rows: DataFrame) -> DataFrame:
    """(batch, x, y, times): a row for each mini-batch of ``rows`` (x, y, batch), with its different rows as the bytes
    of a matrix, in a fixed order, and how often each of them is there; so rows that repeat leave it small."""

    def pack(part: pa.Table) -> pa.Table:
        x, y, times = matrix(part.column("x").to_pandas()), part.column("y").to_numpy(), part.column("times").to_numpy()
        order = np.lexsort((y, *x.T))
        return pa.table({"batch": part.column("batch").slice(0, 1), "x": [x[order].tobytes()], "y": [y[order].astype(float).tobytes()], "times": [times[order].astype(float).tobytes()]})

    each = rows.groupBy("batch", "x", "y").agg(F.count("*").alias("times"))
    return each.groupBy("batch").applyInArrow(pack, "batch int, x binary, y binary, times binary")


def _in_runs(rows: DataFrame, width: int, batch_size: int) -> Pass:
    """Passes over ``rows`` (x, y, batch) in runs of mini-batches: a shuffle a pass, and a task for each run in turn."""
    path = scratch(rows.sparkSession, "packed")
    _packed(rows).write.parquet(path)
    held = rows.sparkSession.read.schema("batch int, x binary, y binary, times binary").parquet(path)
    each, in_run = held.rdd.map(tuple), max(RUN_BYTES // (8 * (width + 2) * batch_size), 1)

    def one_pass(state: Adam, order: np.ndarray) -> tuple[Adam, float, int]:
        place, total, size = np.argsort(order), 0.0, 0
        dealt = each.map(lambda r: (int(place[r[0]]) // in_run, (int(place[r[0]]), *r[1:]))).partitionBy(-(-len(order) // in_run), int)
        for run in range(-(-len(order) // in_run)):

            def steps(records: Iterator[tuple], state: Adam = state) -> list[tuple[Adam, float, int]]:
                total, size = 0.0, 0
                for _, (_, x, y, times) in sorted(records, key=lambda r: r[1][0]):
                    x, y, times = np.frombuffer(x).reshape(-1, width), np.frombuffer(y), np.frombuffer(times)
                    g, loss = state.net.gradient(x, y, times)
                    k = int(times.sum())
                    state.step(g, k)
                    total, size = total + loss, size + k
                return [(state, total, size)]

            state, loss, k = rows.sparkSession.sparkContext.runJob(dealt, steps, [run])[0]
            total, size = total + loss, size + k
        return state, total, size

    return one_pass


def _in_tasks(rows: DataFrame) -> Pass:
    """Passes over ``rows`` (x, y, batch) whose mini-batches are larger than a run: each step's gradient is summed by Spark."""
    path = scratch(rows.sparkSession, "batches")
    rows.sortWithinPartitions("batch").write.parquet(path)
    held = rows.sparkSession.read.schema("x array<double>, y int, batch int").parquet(path)
    tasks = held.rdd.getNumPartitions()

    def one_pass(state: Adam, order: np.ndarray) -> tuple[Adam, float, int]:
        total, size = 0.0, 0
        for b in order.tolist():
            g, loss, k = summed(held.where(F.col("batch") == b), state.net, tasks)
            if k:
                state.step(g, k)
                total, size = total + loss, size + k
        return state, total, size

    return one_pass


def fit(rows: DataFrame, width: int, hidden_layer_sizes: tuple[int, ...] = (128,), learning_rate_init: float = 0.001, max_iter: int = 500, batch_size: int = 200, alpha: float = 1e-4, seed: int = 42) -> Network:
    """The network after at most ``max_iter`` passes over ``rows`` (x: array of ``width``, label 0 or 1).

    A step's gradient is the mini-batch's mean plus alpha times the weights over the batch's size. Training ends once
    the passes' loss has not got better for a while. Mini-batches come in an order of their own in each pass.
    """
    n = max(rows.count() // batch_size, 1)
    dealt = batches_of(rows, n)
    one_pass = _in_runs(dealt, width, batch_size) if 8 * (width + 2) * batch_size <= RUN_BYTES else _in_tasks(dealt)
    net, rng = blank(width, tuple(hidden_layer_sizes), seed), np.random.default_rng(seed + 1)
    state, losses, waited = Adam(net, learning_rate_init, alpha, np.zeros_like(net.w), np.zeros_like(net.w)), [], 0
    for _ in range(max_iter):
        state, total, size = one_pass(state, rng.permutation(n))
        losses.append(total / max(size, 1))
        waited = waited + 1 if len(losses) > 1 and losses[-1] > min(losses[:-1]) - GAIN else 0
        if waited >= PATIENCE:
            break
    state.net.losses = losses
    return state.net
