"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from lumenrisk.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, v string, q string"


def made(seed, n, length=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, length)) + np.repeat(rng.normal(size=(-(-n // 20), length)) * 2, 20, axis=0)[:n]
    return [(i, [float(np.float32(v)) for v in row], 0, "x", "y") for i, row in enumerate(x)]


def plain(rows, k=5, every=50):
    """(query, rank) -> (id, score); the own row is left out by its place."""
    ok = [(i, np.array(v, float)) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (i, q) in enumerate(ok):
        if i is not None and i % every == 0:
            each = [(-float((q * v).sum() / math.sqrt((q * q).sum()) / math.sqrt((v * v).sum())), j is None, j) for n, (j, v) in enumerate(ok) if n != at]
            out.append((i, [(j, -s) for s, _, j in sorted(each)[:k]]))
    return out


def found(df):
    return [r.asDict() for r in df.orderBy("query_id", "rank").collect()]


def test_whole_search_is_exact_when_it_never_stops(spark):
    """With a test that can't stop early, several blocks, slices and parts give brute force's rows, ranks and scores."""
    rows = made(1, 600)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = found(nearest.nearest(df, sure=1 - 1e-15, block=100, most=60, slice_=3))
    want = [(i, n + 1, j, s) for i, own in plain(rows) for n, (j, s) in enumerate(own)]
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [w[:3] for w in want]
    assert [r["score"] for r in got] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_recall_of_the_stopping_test(spark):
    rows = made(2, 3000, 24)
    got = found(nearest.nearest(spark.createDataFrame(rows, SCHEMA), block=500))
    want = {(i, j) for i, own in plain(rows) for j, _ in own}
    assert len(got) == 300 and len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.95 * len(want)


def test_copies_nulls_and_odd_vectors(spark):
    rows = made(3, 120, 8)
    hot = rows[7][1]
    rows += [(1000 + i, hot, 1, "x", "y") for i in range(300)]  # a third and more are one vector
    rows += [(2000, None, 1, "", ""), (2050, [], 1, "", ""), (2100, [0.0] * 8, 1, "", ""), (2150, [None] + [1.0] * 7, 1, "", ""), (2200, [math.inf] + [1.0] * 7, 1, "", ""), (2250, [math.nan] + [1.0] * 7, 1, "", "")]
    rows += [(None, rows[3][1], 1, "", ""), (50, rows[50][1], 1, "", ""), (3000, [2.0 * x for x in rows[50][1]], 1, "", "")]
    got = found(nearest.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), sure=1 - 1e-15))
    want = sorted((i, n + 1, j) for i, own in plain(rows) for n, (j, _) in enumerate(own))
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == want
    assert {r["query_id"] for r in got} >= {1000, 1050, 1100, 0, 50, 100, 3000} and not {2000, 2050, 2100, 2150, 2200, 2250} & {r["query_id"] for r in got}


def test_few_and_no_candidates(spark):
    rows = made(4, 3, 4)
    assert [(r["query_id"], r["rank"]) for r in found(nearest.nearest(spark.createDataFrame(rows, SCHEMA)))] == [(0, 1), (0, 2)]
    assert found(nearest.nearest(spark.createDataFrame(rows[:1], SCHEMA))) == []
    assert found(nearest.nearest(spark.createDataFrame([], SCHEMA))) == []


def test_tree_and_quantile():
    rng = np.random.default_rng(5)
    p = np.round(rng.normal(size=(5000, 4)), 1)
    tree = nearest.KdTree(p, leaf=50)
    of = tree.assign(p)
    assert all((of[m] == i).all() for i, m in enumerate(tree.members)) and sum(map(len, tree.members)) == 5000
    assert nearest.quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3) and nearest.quantile(0.99, 2) == pytest.approx(9.2103, abs=1e-3)
    lo, hi = np.zeros((1, 2)), np.ones((1, 2))
    assert nearest.box_distance(np.array([[0.5, 0.5], [2.0, 3.0]]), lo, hi).tolist() == [[0.0], [5.0]]
