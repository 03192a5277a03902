"""Detectors with pyspark.ml: feature matrix, grid search, evaluation with fallbacks, ablation, importance."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import layer_slice
from ..sources.staging import written
from . import boosting, network
from .metrics import binary_metrics, labelled, roc_auc

KINDS, SCORINGS = ("xgb", "gbt", "rf", "mlp"), ("f1", "accuracy")


def feature_matrix(rows: DataFrame, vector: str, fallback: str | None = None, label: str = "label", layers: int | None = None, layer_range: tuple[float, float] | None = None) -> DataFrame:
    """``rows`` that are labelled, with x: the vector (or the fallback where it is null), cut to a range of layers."""
    x = F.coalesce(vector, fallback) if fallback else F.col(vector)
    if layer_range:
        x = layer_slice(x, layers, *layer_range)
    return labelled(rows, label).withColumn("x", x).withColumn("features", array_to_vector("x"))


@dataclass(frozen=True)
class Own:
    """A trainer of this package in the shape of an estimator; ``params`` are its options."""

    params: dict
    width: int
    trainer: Callable

    def fit(self, rows: DataFrame):
        return self.trainer(rows, self.width, **self.params)


def build(kind: str, params: dict, width: int):
    """``xgb``: boosted trees with second-order gains; ``gbt``: Spark's own; ``rf``; ``mlp``.

    Defaults: 500 trees of depth 6 at a rate of 0.05 (``xgb`` starts from even odds), 400 trees of depth 10, 128 hidden units and 500 rounds (passes
    under ``adam``, the default solver; ``sgd`` is gradient descent, ``lbfgs`` a quasi-Newton method). A depth of None is
    Spark's deepest, 30; learning_rate_init is the step of ``adam`` and ``sgd``.
    """
    if kind == "xgb":
        return Own({"base_score": 0.5, **params}, width, boosting.fit)
    if kind == "gbt":
        return GBTClassifier(labelCol="label", seed=42, maxIter=params.get("n_estimators", 500), maxDepth=params.get("max_depth", 6), stepSize=params.get("learning_rate", 0.05))
    if kind == "rf":
        return RandomForestClassifier(labelCol="label", seed=42, numTrees=params.get("n_estimators", 400), maxDepth=min(params.get("max_depth", 10) or 30, 30))
    if kind == "mlp":
        hidden, solver = tuple(params.get("hidden_layer_sizes", (128,))), params.get("solver", "adam")
        if solver == "adam":
            return Own({**{k: v for k, v in params.items() if k != "solver"}, "hidden_layer_sizes": hidden}, width, network.fit)
        solver = {"sgd": "gd", "lbfgs": "l-bfgs"}[solver]
        return MultilayerPerceptronClassifier(labelCol="label", seed=42, maxIter=params.get("max_iter", 500), layers=[width, *hidden, 2], solver=solver, stepSize=params.get("learning_rate_init", 0.001))
    raise ValueError(f"unknown classifier {kind!r}; one of {KINDS}")


def grid(params: dict) -> list[dict]:
    """All combinations; keys sorted, the last one fastest; a scalar is a list of one."""
    keys = sorted(params)
    lists = [params[k] if isinstance(params[k], list) else [params[k]] for k in keys]
    return [dict(zip(keys, v, strict=True)) for v in itertools.product(*lists)]


def classes(rows: DataFrame) -> int:
    return rows.select("label").distinct().count()


def predict(model, rows: DataFrame) -> DataFrame:
    if isinstance(model, (boosting.BoostedTrees, network.Network)):
        return model.transform(rows)
    return model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).withColumn("predicted", F.col("prediction").cast("int"))


@contextmanager
def kept(*parts: DataFrame) -> Iterator[list[DataFrame]]:
    """The parts, on disk until the block ends: every fit and every score reads them again, none works them out again.

    Partitions stay as they are, so forests, which draw rows by partition, stay too.
    """
    held = [p.persist(StorageLevel.DISK_ONLY) for p in parts]
    try:
        yield held
    finally:
        for p in held:
            p.unpersist()


def grid_search(kind: str, params: dict, train: DataFrame, val: DataFrame, scoring: str = "f1") -> tuple[object, dict, float]:
    """The first best model on the validation rows, its parameters and its score."""
    with kept(train, val) as (train, val):
        if val.isEmpty() or classes(train) < 2:
            raise ValueError("grid search needs two classes to train on and rows to validate on")
        return _search(kind, params, train, val, scoring)


def _search(kind: str, params: dict, train: DataFrame, val: DataFrame, scoring: str) -> tuple[object, dict, float]:
    if scoring not in SCORINGS:
        raise ValueError(f"unknown scoring {scoring!r}")
    width, best = len(train.first()["x"]), None
    for p in grid(params):
        model = build(kind, p, width).fit(train)
        score = binary_metrics(predict(model, val), "predicted").first()[scoring]
        if best is None or score > best[2]:
            best = model, p, score
    return best


def evaluate(model, rows: DataFrame) -> DataFrame:
    """One row: precision, recall, f1, accuracy, auc; taken at once, from one scoring of the rows."""
    with kept(predict(model, rows).select("label", "predicted", "score")) as (p,):
        found = binary_metrics(p, "predicted").crossJoin(F.broadcast(roc_auc(p, "score").select("auc")))
        return rows.sparkSession.createDataFrame(found.collect(), found.schema)


def train_and_evaluate(kind: str, params: dict, train: DataFrame, val: DataFrame, test: DataFrame, scoring: str = "f1") -> tuple[DataFrame, dict, object]:
    """Search on val, report on test; a val without both classes becomes train, such a test becomes val."""
    train, val, test = (p.select("label", "x", "features") for p in (train, val, test))
    with kept(train) as (train,):
        val, test = _judges(train, written(val, "val"), written(test, "test"))
        model, best, _ = _search(kind, params, train, val, scoring)
        return evaluate(model, test), best, model


def _judges(train: DataFrame, val: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    if classes(train) < 2:
        raise ValueError("the training rows need both classes")
    val = val if classes(val) == 2 else train
    return val, test if classes(test) == 2 else val


def ablation(kind: str, params: dict, rows: DataFrame, splits: DataFrame, key: str, blocks: dict[str, tuple[int, int]]) -> DataFrame:
    """(block, precision, ..., auc): refit on each block of the vector alone, and on all of it.

    The rows meet their splits once; the blocks are cut from what that left.
    """
    out = None
    width = len(rows.first()["x"])
    part = lambda s: rows.join(splits.where(F.col("split") == s), key, "left_semi").select("label", "x")
    with kept(part("train")) as (train,):
        parts = train, *_judges(train, written(part("val"), "val"), written(part("test"), "test"))
        for name, (a, b) in {"all": (0, width), **blocks}.items():
            cut = [p.withColumn("x", F.slice("x", a + 1, b - a)).withColumn("features", array_to_vector("x")) for p in parts]
            with kept(cut[0]):
                got = evaluate(_search(kind, params, *cut[:2], "f1")[0], cut[2])
            got = got.select(F.lit(name).alias("block"), "*")
            out = got if out is None else out.union(got)
    return out


def block_importance(model, rows: DataFrame, layers: int, repeats: int = 1, seed: int = 5, most: int = 500) -> DataFrame:
    """(block, importance): mean absolute change of the score when a feature takes another row's value.

    A model-agnostic stand-in for Shapley values, over at most ``most`` rows drawn by hash (their exact number of
    features x repeats rows is scored); each feature is swapped ``repeats`` times with a row of as many drawn ones.
    """
    width = len(rows.first()["x"])
    drawn = lambda salt, n: rows.select("x").orderBy(F.xxhash64("x", F.lit(salt)), "x").limit(n)
    others = [r.x for r in drawn(seed + 1, 16 * repeats).collect()]
    if not others:
        return rows.sparkSession.createDataFrame([], "block int, importance double")
    pool = F.array(*[F.array(*[F.lit(float(v)) for v in x]) for x in others])
    base = predict(model, drawn(seed, most).withColumn("features", array_to_vector("x"))).select("x", "score")
    each = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("f"), F.lit(repeats).alias("r")).withColumn("r", F.explode(F.sequence(F.lit(1), "r")))
    other = F.get(pool, F.pmod(F.xxhash64("x", "r", F.lit(seed)), F.lit(len(others))).cast("int"))
    each = each.withColumn("other", F.get(other, F.col("f")))
    each = each.withColumn("x", F.transform("x", lambda v, i: F.when(i == F.col("f"), F.col("other")).otherwise(v))).withColumnRenamed("score", "was").drop("features")
    moved = predict(model, each.withColumn("features", array_to_vector("x")))
    return moved.groupBy(F.floor(F.col("f") / layers).cast("int").alias("block")).agg(F.avg(F.abs(F.col("score") - F.col("was"))).alias("importance"))
