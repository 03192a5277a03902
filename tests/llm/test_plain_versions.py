"""Pieces of operators without SQL against plain recomputations, and inputs of the same rows over and over."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrisk.llm import decontam, lm_scores, quality_rules


def test_isolation_paths_against_recursion():
    """A row's path is its leaf's depth plus the mean path of an unsuccessful search among the leaf's rows."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (60, quality_rules.FEATURES)), 1)
    x[40:50] = x[0]  # rows that no split sets apart
    forest = quality_rules.Forest(x, trees=9, rows=1000)  # each tree sees all rows

    def leaf(root, row):
        at, depth = root, 0
        while forest.feature[at] >= 0:
            at, depth = forest.child[at] + int(row[forest.feature[at]] >= forest.split[at]), depth + 1
        return int(at), depth

    def search(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    for row, score in zip(x, forest.score(x), strict=True):
        paths = []
        for root in forest.roots:
            own, depth = leaf(root, row)
            paths.append(depth + search(sum(leaf(root, other)[0] == own for other in x)))
        assert score == pytest.approx(2.0 ** -(sum(paths) / len(paths) / search(60)), rel=1e-12)


def test_forest_threshold_against_loops():
    rng = np.random.default_rng(4)
    for trial in range(30):
        score, good = np.round(rng.random(200), 2), rng.random(200) < 0.8
        score[~good] += 0.2 * (trial % 3)
        cut = quality_rules.threshold(score, good, 0.9)
        floor = np.quantile(score[good], 0.9)
        gain = {c: sum(s > c for s in score[~good]) / sum(~good) - sum(s > c for s in score[good]) / sum(good) for c in {floor, *score[score >= floor]}}
        assert cut == min(c for c in gain if gain[c] >= max(gain.values()) - 1e-12)


def test_threshold_and_forest_use_all_labelled_rows(spark):
    """The verdict is the plain threshold over all of 9000 labelled rows; any of them can be a row of a tree."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(10, 40))) + "#" * int(rng.integers(0, 9)) for _ in range(9000)]
    quality = (rng.random(9000) < 0.9).astype(int).tolist()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(enumerate(quality)), "doc_id long, quality int")
    got = quality_rules.quality_rules(docs, labels).toPandas().sort_values("doc_id")
    open_, good = ~got.base_failed.to_numpy(), np.array(quality) == 1
    cut = quality_rules.threshold(got.anomaly.to_numpy()[open_], good[open_])
    assert (got.kept == (open_ & (got.anomaly <= cut))).all()
    known = quality_rules.labelled_rows(quality_rules.measured(docs), labels).select("doc_id", "x")
    few, again = quality_rules.fit(known, trees=5, size=20), quality_rules.fit(known.repartition(7), trees=5, size=20)
    assert few.rows == 20 and len(few.roots) == 5 and (few.split == again.split).all()


@pytest.mark.parametrize("items", [30, 4000])
def test_tables_of_one_size(items):
    """Few items of a size are visited by their values, many by the values near to a window's; both find every pair."""
    rng = np.random.default_rng(items)
    prints = rng.integers(0, 1 << 63, items * 2).astype(np.uint64)
    own = np.arange(0, items * 2, 2)
    blocks = decontam.Blocks(own, prints, 18)
    assert blocks.few == (items == 30)
    far = prints[rng.integers(0, items * 2, 600)]
    for _ in range(20):
        far = np.where(rng.random(600) < 0.8, far ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)), far)
    w, i, d = blocks.near(far)
    bits = np.bitwise_count(far[:, None] ^ prints[own])
    a, b = np.nonzero(bits <= 18)
    assert sorted(zip(w.tolist(), i.tolist(), d.tolist(), strict=True)) == sorted(zip(a.tolist(), own[b].tolist(), bits[a, b].tolist(), strict=True))


def test_lm_scores_of_one_row_over_and_over(spark):
    """Rows that repeat id and text fill many chunks, by their content alone, and score as any other."""
    one, other = "a b a b c", "a b c d"
    rows = [(7, one)] * 700 + [(8, other)] * 3 + [(None, None)] * 900 + [(9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, size = lm_scores._dealt(docs.repartition(5), 400)
    assert size == 700 * 9 + 3 * 7 + 1
    again = lm_scores._dealt(docs.orderBy(F.desc("doc_id")).repartition(3), 400)[0]
    count = lambda d: sorted(map(str, d.groupBy("chunk", "doc_id", "text").count().collect()))
    assert count(dealt) == count(again)
    assert dealt.count() == len(rows) and dealt.where("doc_id = 7").select("chunk").distinct().count() > 8
    got = lm_scores.lm_scores(docs, chunk_bytes=400, slot_grams=64).groupBy("doc_id", "n_words", "n_backoff", "log_score").count().collect()
    words = 700 * 5 + 3 * 4 + 1
    a, b, c = 703 + 700, 703 + 700, 703
    first = math.log(a / words)
    want = {
        7: (700, first + math.log(1403 / a) + math.log(700 / b) + math.log(1403 / a) + math.log(703 / b)),
        8: (3, first + math.log(1403 / a) + math.log(703 / b) + math.log(3 / c)),
        9: (1, math.log(1 / words)),
        None: (900, 0.0),
    }
    assert {r["doc_id"]: (r["count"], pytest.approx(r["log_score"])) for r in got} == want
