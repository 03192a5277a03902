"""Shapley values: exact along the paths of trees, and by weighted least squares over coalitions for any other model.

Trees: without a feature a row goes down both sides of its splits, by the shares of the training rows (their cover). A
leaf of value v whose path asks d features, of which row x fulfils o_j in {0, 1} and a share z_j of the training rows,
adds v (o_f - z_f) times the integral over t in [0, 1] of the product over j != f of (o_j t + z_j (1 - t)) to feature f.
The integrand is a polynomial of degree d - 1, so Gauss-Legendre quadrature at ceil(d / 2) points is exact: time is
polynomial in the depth and linear in the leaves, not exponential in the features.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import scratch
from .boosting import BoostedTrees, Tree, matrix

#: Rows that are explained, rows of the background, coalitions that are drawn where not all of them can be taken.
MOST, BACKGROUND, DRAWN = 500, 50, 2048

#: A leaf: its value, and (feature, least value, value that is too large, whether missing values pass, share) for each feature of its path.
Leaf = tuple[float, list[tuple[int, float, float, bool, float]]]


def leaves(tree: Tree) -> list[Leaf]:
    """The leaves with the conditions of their paths, those of a feature as one."""
    out, todo = [], [(0, {})]
    while todo:
        n, asks = todo.pop()
        if tree.left[n] < 0:
            out.append((tree.value[n], [(f, *c) for f, c in sorted(asks.items())]))
            continue
        f, at = tree.feature[n], tree.at[n]
        lo, hi, missing, share = asks.get(f, (-math.inf, math.inf, True, 1.0))
        for child, own in ((tree.left[n], (lo, min(hi, at), missing and tree.missing_left[n])), (tree.right[n], (max(lo, at), hi, missing and not tree.missing_left[n]))):
            part = tree.cover[child] / tree.cover[n] if tree.cover[n] > 0 else 0.5
            todo.append((child, {**asks, f: (*own, share * part)}))
    return out


def tree_values(paths: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Shapley values of one tree for each row and feature of ``x``; NaN is a missing value."""
    out = np.zeros(x.shape)
    for value, asks in paths:
        if not asks or not value:
            continue
        f = np.array([a[0] for a in asks])
        lo, hi, missing, z = (np.array([a[i] for a in asks]) for i in (1, 2, 3, 4))
        own = x[:, f]
        o = np.where(np.isnan(own), missing, (own >= lo) & (own < hi)).astype(float)
        at, weight = np.polynomial.legendre.leggauss(-(-len(f) // 2))
        t, weight = (at + 1) / 2, weight / 2
        each = o[:, :, None] * t + z[:, None] * (1 - t)  # rows x features x points
        ahead, behind = np.ones_like(each), np.ones_like(each)
        np.cumprod(each[:, :-1], axis=1, out=ahead[:, 1:])
        behind[:, :-1] = np.cumprod(each[:, :0:-1], axis=1)[:, ::-1]
        out[:, f] += value * (o - z) * ((ahead * behind) @ weight)
    return out


def expected(paths: list[Leaf]) -> float:
    """The tree's value for a row of which nothing is known."""
    return sum(value * math.prod(a[4] for a in asks) for value, asks in paths)


def exported(model, rows: DataFrame) -> tuple[list[Tree], float]:
    """The trees of a fitted ensemble with covers and their base value: values add up to the log-odds of boosted
    trees (Spark's: the margin), to the probability of class 1 of a forest."""
    if isinstance(model, BoostedTrees):
        return model.trees, model.base
    if not isinstance(model, (GBTClassificationModel, RandomForestClassificationModel)):
        raise TypeError(f"{type(model).__name__} has no trees")
    path = scratch(rows.sparkSession, "trees")
    model.write().save(path)  # the library's own table of nodes
    weights = list(model.treeWeights)
    forest = isinstance(model, RandomForestClassificationModel)
    trees: dict[int, dict[int, object]] = {}
    for r in rows.sparkSession.read.parquet(f"{path}/data").collect():  # as many rows as the model has nodes
        trees.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    return [_spark_tree(nodes, weights[i] / sum(weights) if forest else weights[i], forest) for i, nodes in sorted(trees.items())], 0.0


def _spark_tree(nodes: dict, weight: float, forest: bool) -> Tree:
    tree = Tree()

    def add(i: int) -> int:
        n = nodes[i]
        value = n.impurityStats[1] / sum(n.impurityStats) if forest else n.prediction
        place = tree.add(weight * value, float(n.rawCount))
        if n.leftChild >= 0:
            if n.split.numCategories >= 0:
                raise TypeError("splits by categories have no order")
            # Spark sends values up to the threshold left: those below the next number
            tree.feature[place], tree.at[place] = n.split.featureIndex, math.nextafter(n.split.leftCategoriesOrThreshold[0], math.inf)
            tree.missing_left[place] = False
            tree.left[place], tree.right[place] = add(n.leftChild), add(n.rightChild)
        return place

    add(0)
    return tree


def tree_shapley(model, rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, base, phi: array) for every row of ``rows`` (x: array): base plus the sum of phi is the model's value."""
    trees, base = exported(model, rows)
    paths = [leaves(t) for t in trees]
    base += sum(map(expected, paths))
    shared = rows.sparkSession.sparkContext.broadcast(paths)  # the model: its own size

    @F.pandas_udf("array<double>")
    def phi(x: pd.Series) -> pd.Series:
        m = matrix(x)
        return pd.Series(list(sum((tree_values(p, m) for p in shared.value), np.zeros(m.shape))))

    return rows.select(*keep, F.lit(base).alias("base"), phi(F.col("x").cast("array<double>")).alias("phi"))


def coalitions(width: int, drawn: int = DRAWN, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(sets, weights): all coalitions but the empty and the whole one where they are at most ``drawn``, else the
    smallest and largest sizes as long as they fit whole, and drawn ones of the sizes between, with their complements."""
    kernel = lambda s: (width - 1) / (s * (width - s))  # noqa: E731  of all coalitions of a size together
    sets, weights, sizes = [], [], list(range(1, width))
    for small in range(1, width // 2 + 1):
        own = sorted({small, width - small})
        if len(sets) + sum(math.comb(width, s) for s in own) > drawn:
            break
        for s in own:
            for c in itertools.combinations(range(width), s):
                sets.append(c)
                weights.append(kernel(s) / math.comb(width, s))
            sizes.remove(s)
    if sizes:
        rng = np.random.default_rng(seed)
        share = np.array([kernel(s) for s in sizes])
        pairs = max((drawn - len(sets)) // 2, width)
        for s in rng.choice(sizes, pairs, p=share / share.sum()).tolist():
            c = set(rng.permutation(width)[:s].tolist())
            sets += [tuple(c), tuple(set(range(width)) - c)]
            weights += [share.sum() / (2 * pairs)] * 2
    out = np.zeros((len(sets), width), bool)
    for row, c in zip(out, sets, strict=True):
        row[list(c)] = True
    return out, np.array(weights)


def solve(sets: np.ndarray, weights: np.ndarray, gains: np.ndarray, total: float) -> np.ndarray:
    """The additive values that fit the coalitions' gains best and sum up to ``total``."""
    width = sets.shape[1]
    if width == 1:
        return np.array([total])
    a = sets[:, :-1].astype(float) - sets[:, -1:]
    b = gains - sets[:, -1] * total
    w = np.sqrt(weights)[:, None]
    phi = np.linalg.lstsq(a * w, b * w[:, 0], rcond=None)[0]
    return np.append(phi, total - phi.sum())


def kernel_shapley(score: Callable[[DataFrame], DataFrame], rows: DataFrame, background: DataFrame, key: str, width: int, most: int = BACKGROUND, drawn: int = DRAWN) -> DataFrame:
    """(key, base, phi) for every row of ``rows`` (key, x), for any model: ``score`` adds a column score to rows with x.

    A coalition's value is the mean score where its features come from the row and the others from each of the at most
    ``most`` background rows. Each row is scored (coalitions x background) times, where Spark holds it; the mean is an
    aggregate. ``key`` tells rows apart; exact where all coalitions are taken.
    """
    spark = rows.sparkSession
    sets, weights = coalitions(width, drawn)
    taken = background.select("x").orderBy(F.xxhash64("x"), "x").limit(most).collect()  # at most ``most`` rows
    if not taken:
        raise ValueError("kernel Shapley values need background rows")
    masks = np.concatenate((np.zeros((1, width), bool), sets, np.ones((1, width), bool)))
    some = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(masks)], "c int, mask array<boolean>").repartition(8)
    # coalitions and background are bounded, and each row meets all of both
    each = rows.select(key, F.col("x").cast("array<double>").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("c")).join(F.broadcast(some), "c")
    other = F.array(*[F.array(*[F.lit(float(v)) for v in r.x]) for r in taken])
    each = each.withColumn("other", F.explode(other)).withColumn("x", F.transform("mask", lambda m, i: F.when(m, F.get("own", i)).otherwise(F.get("other", i))))
    value = score(each.select(key, "c", "x")).groupBy(key, "c").agg(F.avg("score").alias("value"))
    packed = value.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("v")).select(key, F.col("v.value").alias("v"))  # as many as there are coalitions

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, len(masks))
            phi = [solve(sets, weights, r[1:-1] - r[0], r[-1] - r[0]).tolist() for r in v]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v[:, 0]), pa.array(phi, pa.list_(pa.float64()))], names=[key, "base", "phi"])

    kind = packed.schema[key].dataType.simpleString()
    return packed.mapInArrow(fitted, f"{key} {kind}, base double, phi array<double>")


def layer_importance(values: DataFrame, layers: int) -> DataFrame:
    """(block, layer, importance): mean absolute Shapley value of each feature, features in blocks of ``layers``."""
    each = values.select(F.posexplode("phi").alias("f", "phi"))
    return each.groupBy(F.floor(F.col("f") / layers).cast("int").alias("block"), (F.col("f") % layers).alias("layer")).agg(F.avg(F.abs("phi")).alias("importance"))


def explained(rows: DataFrame, most: int = MOST) -> DataFrame:
    """The rows that are explained: at most ``most``, by a hash of their values."""
    return rows.orderBy(F.xxhash64("x"), "x").limit(most)
