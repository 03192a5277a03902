"""Boosting against plain NumPy, Shapley values against all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lumenrisk.operators import boosting as B
from lumenrisk.operators import learn as L
from lumenrisk.operators import shapley as S


def made(seed, n=400, width=5, missing=0.1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.4, n) > 0).astype(int)
    x[rng.random(x.shape) < missing] = np.nan
    return x, y


def rows_of(spark, x, y):
    data = [(i, [None if math.isnan(v) else float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, x array<double>, label int")


def plain_boosting(x, y, cuts, trees, depth, rate, lam, gamma, least):
    """Margins of the rows after each tree, by exhaustive search over features, cuts and sides of the missing."""
    base = math.log(y.mean() / (1 - y.mean()))
    margin = np.full(len(y), base)
    worth = lambda g, h: g * g / (h + lam)

    def grow(own, level, g, h, out):
        best = None
        for f in range(x.shape[1]) if level < depth else ():
            lost = np.isnan(x[own, f])
            occupied = sorted({int(np.searchsorted(cuts[f], v, "right")) for v in x[own, f][~lost]})
            for b in occupied:
                for missing_left in (True, False) if h[own][lost].sum() > 0 else (True,):
                    code = np.searchsorted(cuts[f], np.nan_to_num(x[own, f]), "right")
                    left = np.where(lost, missing_left, code <= b)
                    gl, hl, ga, ha = g[own][left].sum(), h[own][left].sum(), g[own].sum(), h[own].sum()
                    if hl < least or ha - hl < least:
                        continue
                    gain = (worth(gl, hl) + worth(ga - gl, ha - hl) - worth(ga, ha)) / 2 - gamma
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9 or abs(gain - best[0]) <= 1e-9 and best[1:3] == (f, b) and missing_left):
                        best = (gain, f, b, left)
        if best is None:
            out[own] = -rate * g[own].sum() / (h[own].sum() + lam)
            return
        grow(own[best[3]], level + 1, g, h, out)
        grow(own[~best[3]], level + 1, g, h, out)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(len(y))
        grow(np.arange(len(y)), 0, p - y, p * (1 - p), out)
        margin = margin + out
    return margin


@pytest.mark.parametrize("seed,lam,gamma,missing", [(1, 1.0, 0.0, 0.1), (2, 5.0, 0.5, 0.0)])
def test_boosting_against_numpy(spark, seed, lam, gamma, missing):
    x, y = made(seed, missing=missing)
    rows = rows_of(spark, x, y).repartition(3)
    model = B.fit(rows, 5, n_estimators=4, max_depth=3, learning_rate=0.3, reg_lambda=lam, gamma=gamma, bins=16)
    cuts = B.quantile_cuts(rows, 5, 16)
    assert model.margin(x) == pytest.approx(plain_boosting(x, y, cuts, 4, 3, 0.3, lam, gamma, 1.0), abs=1e-6)
    found = {r.id: (r.score, r.predicted) for r in model.transform(rows).collect()}
    want = 1 / (1 + np.exp(-model.margin(x)))
    assert [found[i][0] for i in range(len(x))] == pytest.approx(want.tolist()) and [found[i][1] for i in range(len(x))] == (want > 0.5).astype(int).tolist()
    assert B.fit(rows.repartition(7), 5, n_estimators=4, max_depth=3, learning_rate=0.3, reg_lambda=lam, gamma=gamma, bins=16) == model


def test_margins_are_written_now_and_then(spark, monkeypatch):
    x, y = made(3, 200)
    rows = rows_of(spark, x, y)
    want = B.fit(rows, 5, n_estimators=5, max_depth=2, learning_rate=0.5, bins=8)
    monkeypatch.setattr(B._Margins, "STEP", 2)
    got = B.fit(rows, 5, n_estimators=5, max_depth=2, learning_rate=0.5, bins=8)
    assert got.margin(x) == pytest.approx(want.margin(x))


def test_one_class_and_no_split(spark):
    model = B.fit(rows_of(spark, np.ones((20, 2)), np.array([0, 1] * 10)), 2, n_estimators=2)
    assert model.margin(np.ones((1, 2)))[0] == pytest.approx(0.0, abs=1e-9) and model.trees[0].left == [-1]
    with pytest.raises(ValueError, match="needs rows"):
        B.fit(rows_of(spark, np.ones((0, 2)), np.ones(0)), 2)


def conditional(tree, x, known, n=0):
    """A tree's value where only the features of ``known`` are known."""
    if tree.left[n] < 0:
        return tree.value[n]
    f = tree.feature[n]
    if f in known:
        left = tree.missing_left[n] if math.isnan(x[f]) else x[f] < tree.at[n]
        return conditional(tree, x, known, tree.left[n] if left else tree.right[n])
    return sum(tree.cover[c] / tree.cover[n] * conditional(tree, x, known, c) for c in (tree.left[n], tree.right[n]))


def all_subsets(value, width):
    out = np.zeros(width)
    for f in range(width):
        others = [j for j in range(width) if j != f]
        for k in range(width):
            for c in itertools.combinations(others, k):
                out[f] += math.factorial(k) * math.factorial(width - k - 1) / math.factorial(width) * (value({*c, f}) - value(set(c)))
    return out


@pytest.mark.parametrize("kind", ["xgb", "gbt", "rf"])
def test_tree_shapley_against_all_subsets(spark, kind):
    x, y = made(4, 300, 6, 0.05 if kind == "xgb" else 0.0)
    rows = rows_of(spark, x, y).withColumn("features", array_to_vector(F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)))))
    model = L.build(kind, {"n_estimators": 3, "max_depth": 4}, 6).fit(rows)
    trees, base = S.exported(model, rows)
    few = rows.where("id < 12")
    got = {r.id: r for r in S.tree_shapley(model, few, ("id",)).collect()}
    for i in range(12):
        want = sum(all_subsets(lambda known, t=t: conditional(t, x[i], known), 6) for t in trees)
        assert got[i].phi == pytest.approx(want.tolist(), abs=1e-9)
        assert got[i].base + sum(got[i].phi) == pytest.approx(base + sum(conditional(t, x[i], set(range(6))) for t in trees), abs=1e-9)
    if kind == "rf":
        scores = {r.id: r.score for r in L.predict(model, few).collect()}
        assert all(got[i].base + sum(got[i].phi) == pytest.approx(scores[i], abs=1e-9) for i in range(12))
    if kind == "gbt":
        margin = {r.id: r.rawPrediction[1] for r in model.transform(few).collect()}
        assert all(2 * (got[i].base + sum(got[i].phi)) == pytest.approx(2 * margin[i], abs=1e-9) for i in range(12))
    blocks = {(r.block, r.layer): r.importance for r in S.layer_importance(S.tree_shapley(model, few), 2).collect()}
    assert blocks == pytest.approx({(f // 2, f % 2): float(np.mean([abs(got[i].phi[f]) for i in got])) for f in range(6)})


def test_kernel_shapley_is_exact_over_all_coalitions(spark):
    x, y = made(5, 60, 4, 0.0)
    rows = rows_of(spark, x, y)
    f = lambda r: math.tanh(r[0] * r[1]) + r[2] - 0.5 * r[3] * r[0]
    e = lambda i: F.get("x", F.lit(i))
    score = lambda d: d.withColumn("score", F.tanh(e(0) * e(1)) + e(2) - 0.5 * e(3) * e(0))
    few, back = rows.where("id < 5"), rows.where("id >= 40")
    got = {r.id: r for r in S.kernel_shapley(score, few, back, "id", 4).collect()}
    for i in range(5):
        value = lambda known, i=i: np.mean([f([x[i][j] if j in known else b[j] for j in range(4)]) for b in x[40:]])
        assert got[i].phi == pytest.approx(all_subsets(value, 4).tolist(), abs=1e-9) and got[i].base == pytest.approx(value(set()))


def test_drawn_coalitions_come_near(spark):
    sets, weights = S.coalitions(16, 600)
    assert len(sets) <= 600 and {1, 2, 14, 15} <= set(sets.sum(1).tolist())
    coef = np.arange(16) / 7
    assert S.solve(sets, weights, sets @ coef, coef.sum()) == pytest.approx(coef.tolist())  # additive: exact from any coalitions
    everything, w = S.coalitions(5)
    assert len(everything) == 30 and w.sum() == pytest.approx(sum(4 / (s * (5 - s)) for s in range(1, 5)))
