"""Boosted trees with second-order gains: one histogram aggregate for each level of a tree.

Features are cut into bins once, at quantiles. For each level, tasks sum gradients and Hessians by (node, feature, bin)
over their rows, Spark adds these sums up and finds each node's best split with windows over the bins; only the splits
reach the driver, one row a node. Sums are whole numbers of 2^-30, so row order and partitions change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import scratch

#: Steps of a gradient sum; a sum of 8 thousand million rows fits a long.
UNIT = 1 << 30
#: The bin of a missing value, which is tried on both sides of each split.
MISSING = 255


@dataclass
class Tree:
    """Nodes in the order in which they were made; a leaf has no children (-1). A value below ``at`` goes left."""

    feature: list[int] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for where, x in ((self.feature, -1), (self.at, 0.0), (self.missing_left, True), (self.left, -1), (self.right, -1), (self.value, value), (self.cover, cover)):
            where.append(x)
        return len(self.feature) - 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        node = np.zeros(len(x), np.int64)
        feature, at, left, right, missing = (np.array(c) for c in (self.feature, self.at, self.left, self.right, self.missing_left))
        while len(rows := np.flatnonzero(left[node] >= 0)):
            n = node[rows]
            v = x[rows, feature[n]]
            node[rows] = np.where(np.where(np.isnan(v), missing[n], v < at[n]), left[n], right[n])
        return node


@dataclass
class BoostedTrees:
    """log-odds = base + the trees' values, which hold the learning rate already."""

    trees: list[Tree]
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.leaves(x)]
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with x, an array) with score and predicted; a missing value takes its split's own side."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-shared.value.margin(matrix(x)))))

        return rows.withColumn("score", score(F.col("x").cast("array<double>"))).withColumn("predicted", (F.col("score") > 0.5).cast("int"))


def matrix(x: pd.Series) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in row] for row in x], float).reshape(len(x), -1)


def quantile_cuts(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
    """For each feature the values from which its bins begin, but for the first; every value where there are few."""
    at = [i / bins for i in range(1, bins)]
    x = lambda f: F.get("x", F.lit(f)).cast("double")
    found = rows.agg(*[F.percentile_approx(F.when(~F.isnan(x(f)), x(f)), at, 100 * bins).alias(str(f)) for f in range(width)], *[F.min(x(f)).alias(f"least{f}") for f in range(width)]).first()
    return [sorted({v for v in found[str(f)] or () if v > found[f"least{f}"]}) for f in range(width)]


def fit(rows: DataFrame, width: int, n_estimators: int = 500, max_depth: int = 6, learning_rate: float = 0.05, reg_lambda: float = 1.0, gamma: float = 0.0, min_child_weight: float = 1.0, bins: int = 128, cuts: list[list[float]] | None = None, base_score: float | None = None) -> BoostedTrees:
    """Trees for the logistic loss from ``rows`` (x: array of ``width``, label 0 or 1), grown level by level.

    A split's gain is GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda), half of it, less gamma; ties go to
    the first feature and bin, missing values to the left. A leaf is worth -rate G / (H + lambda). ``cuts``: for each
    feature the rising values from which its bins begin, in place of quantiles; fewer than 255. ``base_score``: the
    probability before the first tree, by default the labels' mean.
    """
    cuts = cuts or quantile_cuts(rows, width, min(bins, MISSING))
    shared_cuts = rows.sparkSession.sparkContext.broadcast([np.array(c) for c in cuts])
    path = scratch(rows.sparkSession, "binned")

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0).to_pandas())
            codes = np.stack([np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(c, x[:, f], "right")) for f, c in enumerate(shared_cuts.value)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in codes], pa.binary()), b.column(1)], names=["codes", "y"])

    rows.select(F.col("x").cast("array<double>"), F.col("label").cast("int")).mapInArrow(binned, "codes binary, y int").write.parquet(path)
    packed = rows.sparkSession.read.schema("codes binary, y int").parquet(path)
    rate = packed.agg(F.avg("y")).first()[0]
    if rate is None:
        raise ValueError("boosting needs rows")
    rate = rate if base_score is None else base_score
    rate = min(max(rate, 1e-9), 1 - 1e-9)
    model = BoostedTrees([], math.log(rate / (1 - rate)))
    margins = _Margins(packed, width, cuts)
    for _ in range(n_estimators):
        tree = _grow(margins, model, width, cuts, max_depth, learning_rate, reg_lambda, gamma, min_child_weight)
        model.trees.append(tree)
        margins.advance(model)
    return model


class _Margins:
    """The rows with the sum of the trees so far; written anew each ``STEP`` trees, in between the last ones are added on the fly."""

    STEP = 16

    def __init__(self, packed: DataFrame, width: int, cuts: list[list[float]]) -> None:
        self.rows, self.width, self.known = packed.withColumn("margin", F.lit(0.0)), width, 0
        # a bin's representative for walking a tree: its own lower edge, so that it compares like the values in it
        self.edges = [np.array([-math.inf, *c] + [math.nan] * (256 - len(c) - 1)) for c in cuts]

    def advance(self, model: BoostedTrees) -> None:
        if len(model.trees) - self.known < self.STEP:
            return
        path = scratch(self.rows.sparkSession, "margins")
        late, edges, width = model.trees[self.known :], self.edges, self.width

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _values(b.column(0), edges, width)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_add(b.column(2).to_numpy(), late, x))], names=["codes", "y", "margin"])

        schema = "codes binary, y int, margin double"
        self.rows.mapInArrow(add, schema).write.parquet(path)
        self.rows, self.known = self.rows.sparkSession.read.schema(schema).parquet(path), len(model.trees)


def _add(margin: np.ndarray, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    margin = margin.copy()
    for t in trees:
        margin += np.array(t.value)[t.leaves(x)]
    return margin


def _codes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _values(column: pa.Array, edges: list[np.ndarray], width: int) -> np.ndarray:
    codes = _codes(column, width)
    return np.stack([edges[f][codes[:, f]] for f in range(width)], axis=1) if width else np.zeros((len(codes), 0))


def histograms(margins: _Margins, model: BoostedTrees, tree: Tree, open_: list[int]) -> DataFrame:
    """(node, f, bin, g, h) in units of ``UNIT``: sums of gradients and Hessians over the rows that stand in a node of ``open_``."""
    late, edges, width, base = model.trees[margins.known :], margins.edges, margins.width, model.base

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(open_), width, 256, 2), np.int64)
        place = np.full(len(tree.feature), -1)
        place[open_] = np.arange(len(open_))
        for b in batches:
            codes, x = _codes(b.column(0), width), _values(b.column(0), edges, width)
            p = 1 / (1 + np.exp(-(base + _add(b.column(2).to_numpy(), late, x))))
            g = np.rint((p - b.column(1).to_numpy()) * UNIT).astype(np.int64)
            h = np.rint(p * (1 - p) * UNIT).astype(np.int64)
            at = place[tree.leaves(x)]
            own = at >= 0
            cell = ((at[own, None] * width + np.arange(width)) * 256 + codes[own]).ravel()
            for i, part in enumerate((g, h)):  # a batch's sums are whole numbers that doubles hold exactly
                flat = np.bincount(cell, np.repeat(part[own], width), sums[..., 0].size)
                sums[..., i] += flat.reshape(sums.shape[:3]).astype(np.int64)
        n, f, k = np.nonzero(sums[:, :, :, 1] | sums[:, :, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(open_)[n], pa.int32()), pa.array(f, pa.int32()), pa.array(k, pa.int32()), pa.array(sums[n, f, k, 0]), pa.array(sums[n, f, k, 1])], names=["node", "f", "bin", "g", "h"])

    each = margins.rows.mapInArrow(add, "node int, f int, bin int, g long, h long")
    return each.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def best_splits(sums: DataFrame, reg_lambda: float, gamma: float, min_child_weight: float) -> DataFrame:
    """(node, f, bin, missing_left, gain, g, h, gl, hl): each node's best split; bins up to ``bin`` go left.

    g, h: the node's sums; gl, hl: those of its left side. A node without a gain over 0 has no row.
    """
    along = Window.partitionBy("node", "f").orderBy("bin")
    whole, lost = Window.partitionBy("node", "f"), F.col("bin") == MISSING
    part = lambda c: F.sum(F.when(lost, F.col(c)).otherwise(0)).over(whole)
    d = sums.select("node", "f", "bin", *[F.sum(c).over(whole).alias(f"{c}_all") for c in "gh"], *[part(c).alias(f"{c}_lost") for c in "gh"], *[F.sum(F.when(lost, 0).otherwise(F.col(c))).over(along).alias(f"{c}_upto") for c in "gh"]).where(~lost)
    sides = F.explode(F.array(F.lit(True), F.lit(False)))
    d = d.withColumn("missing_left", sides).where(F.col("missing_left") | (F.col("h_lost") > 0))
    real = lambda c: c / F.lit(float(UNIT))
    with_lost = lambda c: real(F.col(f"{c}_upto") + F.col("missing_left").cast("int") * F.col(f"{c}_lost"))
    d = d.select("node", "f", "bin", "missing_left", real(F.col("g_all")).alias("g"), real(F.col("h_all")).alias("h"), with_lost("g").alias("gl"), with_lost("h").alias("hl"))
    worth = lambda g, h: g * g / (h + reg_lambda)
    g, h, gl, hl = (F.col(c) for c in ("g", "h", "gl", "hl"))
    gain = (worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h)) / 2 - gamma
    d = d.where((hl >= min_child_weight) & (h - hl >= min_child_weight)).withColumn("gain", gain).where(F.col("gain") > 1e-6)
    first = F.struct("gain", -F.col("f"), -F.col("bin"), "missing_left")
    return d.groupBy("node").agg(F.max_by(F.struct("f", "bin", "missing_left", "gain", "g", "h", "gl", "hl"), first).alias("s")).select("node", "s.*")


def _grow(margins: _Margins, model: BoostedTrees, width: int, cuts: list[list[float]], depth: int, rate: float, reg_lambda: float, gamma: float, least: float) -> Tree:
    tree, open_ = Tree(), [0]
    tree.add(0.0, 0.0)
    leaf = lambda g, h: -rate * g / (h + reg_lambda)
    for level in range(depth):
        found = best_splits(histograms(margins, model, tree, open_), reg_lambda, gamma, least).collect() if open_ else []
        if not level and not found:  # no split at all: the whole is one leaf
            total = histograms(margins, model, tree, open_).where("f = 0").agg(F.sum("g"), F.sum("h")).first()
            g, h = (total[0] or 0) / UNIT, (total[1] or 0) / UNIT
            tree.value[0], tree.cover[0] = leaf(g, h), h
        open_ = []
        for s in sorted(found, key=lambda r: r.node):
            n = s.node
            tree.feature[n], tree.at[n], tree.missing_left[n] = s.f, _edge(cuts[s.f], s.bin), s.missing_left
            tree.value[n], tree.cover[n] = leaf(s.g, s.h), s.h
            tree.left[n] = tree.add(leaf(s.gl, s.hl), s.hl)
            tree.right[n] = tree.add(leaf(s.g - s.gl, s.h - s.hl), s.h - s.hl)
            open_ += [tree.left[n], tree.right[n]]
    return tree


def _edge(cuts: list[float], bin_: int) -> float:
    """The value from which the next bin begins."""
    return cuts[bin_] if bin_ < len(cuts) else math.inf
