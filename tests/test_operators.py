import itertools
import json
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lumenrisk.operators import kernels as K
from lumenrisk.operators import learn as L
from lumenrisk.operators import metrics as M
from lumenrisk.operators import relational as R
from lumenrisk.sources import readers
from lumenrisk.streaming.resume import process_new


def test_transport_is_exact():
    rng = np.random.default_rng(0)
    for n in (2, 3, 5):
        # equal weights: the optimum is the best assignment
        cost = rng.random((n, n))
        best = min(sum(cost[i, p[i]] for i in range(n)) / n for p in itertools.permutations(range(n)))
        assert K.transport(np.ones(n), np.ones(n), cost) == pytest.approx(best)
    d = np.array([[0, 1.5], [1.5, 0]])
    assert K.transport([0.7, 0.3], [0.4, 0.6], d) == pytest.approx(0.45)
    direct = np.array([[1.0, 2.0], [2.0, 0]])
    assert K.transport([0.7, 0.3], [0.4, 0.6], direct) == pytest.approx(1.0)


def test_transport_properties():
    rng = np.random.default_rng(1)
    for _ in range(5):
        x, a, b, p = rng.normal(size=(20, 8)), rng.random(20), rng.random(20), rng.random(20)
        low, k = K.layer_risk(x, a, b, p, 16, "decomposed")
        high, _ = K.layer_risk(x, a, b, p, 16, "direct")
        top = lambda d: np.argsort(-d, kind="stable")[:8]
        keep = np.union1d(top(a), top(b))
        s = np.maximum(0, 1 - p[keep])
        assert high == pytest.approx(low + K.probability(a[keep]) @ s + K.probability(b[keep]) @ s) and k == len(keep)
        assert K.layer_risk(x, a, a, p, 16, "decomposed")[0] == pytest.approx(0, abs=1e-9)
        # orthogonal supports without penalties: total variation
        tv = K.transport(a, b, 1 - np.eye(20))
        assert tv == pytest.approx(0.5 * np.abs(a / a.sum() - b / b.sum()).sum())
    with pytest.raises(ValueError):
        K.transport(a, b, np.eye(20), "other")


def test_dispersion():
    assert K.dispersion(np.ones(64)) == 1.0
    grid = np.zeros((8, 8), bool)
    grid[0, 0] = grid[1, 1] = grid[5, 5] = True
    assert len(set(K.components(grid, 8)[grid])) == 2 and len(set(K.components(grid, 4)[grid])) == 3
    rng = np.random.default_rng(0)
    assert all(0 <= K.dispersion(rng.random(64)) <= 1 for _ in range(20))


def test_threshold_and_auc(spark):
    rows = lambda *p: spark.createDataFrame(list(p), "s double, label int")
    best = M.evaluate_threshold(rows((0.0, 0), (1.0, 1)), "s").first()
    assert best.tau == 0 and best.f1 == 1 and best.auc == 1
    flat = M.evaluate_threshold(rows((2.0, 0), (2.0, 1)), "s").first()
    assert (flat.precision, flat.recall, flat.f1, flat.auc) == (0, 0, 0, 0.5)
    rng = random.Random(0)
    data = [(float(rng.randrange(12)), rng.randrange(2)) for _ in range(200)]
    best = M.evaluate_threshold(rows(*data), "s").first()
    lo, hi = min(s for s, _ in data), max(s for s, _ in data)
    f1 = []
    for i in range(200):
        t = lo + i * (hi - lo) / 199
        tp, fp, fn = (sum((s > t) == a and y == b for s, y in data) for a, b in ((True, 1), (True, 0), (False, 1)))
        f1.append(2 * tp / (2 * tp + fp + fn) if tp else 0)
    assert best.i == f1.index(max(f1)) and best.f1 == pytest.approx(max(f1))
    pairs = [(a > b) + 0.5 * (a == b) for a, x in data if x for b, y in data if not y]
    assert best.auc == pytest.approx(sum(pairs) / len(pairs))
    assert M.evaluate_threshold(rows(*data).where("false"), "s").count() == 0


def test_mann_whitney_exact(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 1), (4.0, 0), (5.0, 0), (6.0, 0)], "s double, label int")
    got = M.mann_whitney(rows, "s").first()
    assert got.u == 0 and got.p == pytest.approx(0.1)


def test_pope_and_chair(spark):
    rows = spark.createDataFrame([("yes", "yes"), ("yes", "no"), ("no", "yes"), ("unknown", "no")], "answer string, gt string")
    got = M.pope_accuracy(rows).first().asDict()
    assert (got["accuracy"], got["precision"], got["recall"], got["f1"], got["yes_ratio"], got["tp"], got["fp"], got["fn"], got["tn"]) == (0.25, 0.5, 0.5, 0.5, 0.5, 1, 1, 1, 0)
    assert M.pope_accuracy(rows.where("false")).count() == 0
    none = M.chair_summary(spark.createDataFrame([], "image_id long"), spark.createDataFrame([], "image_id long, hallucinated int")).first()
    assert (none.images, none.chair_s, none.chair_i) == (0, 0.0, 0.0)


@pytest.mark.parametrize("n,ratio,want", [(10, 0.8, (8, 1, 1)), (5, 0.8, (4, 0, 1)), (1, 0.9, (1, 0, 0))])
def test_count_split(spark, n, ratio, want):
    got = {r.split: r["count"] for r in R.count_split(spark.range(n), "id", ratio, rest=("val", "test")).groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == want


def test_detector_fallbacks(spark):
    rows = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(20)] + [(99, [1.0, 1.0], -1)], "id long, v array<double>, label int")
    x = L.feature_matrix(rows, "v")
    assert x.count() == 20
    found, best, _ = L.train_and_evaluate("rf", {"n_estimators": [2, 3]}, x, x.where("label = 1"), x.where("false"))
    assert best == {"n_estimators": 2} and found.first().f1 == 1.0
    with pytest.raises(ValueError):
        L.grid_search("rf", {}, x.where("label = 1"), x)
    with pytest.raises(ValueError):
        L.build("other", {}, 2)
    assert L.grid({"b": [1, 2], "a": 3}) == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]


def test_sources(spark, tmp_path):
    doc = {"images": [{"id": 2, "file_name": "b.jpg"}, {"id": 1, "file_name": "a.jpg"}], "categories": [{"id": 7, "name": "cat"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 7}, {"id": 2, "image_id": 1, "category_id": 8}]}
    (tmp_path / "i.json").write_text(json.dumps(doc))
    (tmp_path / "c.json").write_text(json.dumps({"annotations": [{"id": 1, "image_id": 1, "caption": "z"}, {"id": 2, "image_id": 1, "caption": "a"}]}))
    got = {r.image_id: r for r in readers.coco_samples(spark, str(tmp_path / "i.json"), str(tmp_path / "c.json"), str(tmp_path)).collect()}
    assert got[1].coco_objects == ["cat"] and got[1].captions == ["z", "a"] and got[2].annotations == [] and got[2].captions == []
    (tmp_path / "p.jsonl").write_text('{"text":"Is there a Cat in the image?","image":"x_000000000012.jpg","label":"yes"}\n\n{"text":"huh","image":"1.jpg","label":"no"}\n{"text":"Is there an owl in the image?","image":"3.jpg","label":"no"}\n')
    assert [(r.question_id, r.image_id, r.object_word) for r in readers.pope_questions(spark, str(tmp_path / "p.jsonl")).orderBy("question_id").collect()] == [(0, 12, "cat"), (3, 3, "owl")]
    (tmp_path / "m.json").write_text('{"5": {"generated_text": "hi", "response_token_ids": [1, 2]}}')
    assert readers.json_map(spark, str(tmp_path / "m.json"), "generated_text:string,response_token_ids:array<int>").first().image_id == 5


def test_resume_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "image_id long, text string")
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rows.write.parquet(src)
    go = lambda: process_new(spark, src, rows.schema, out, ck, lambda d: d.withColumn("n", F.length("text"))).awaitTermination()
    go()
    spark.createDataFrame([(2, "b"), (3, "c")], rows.schema).write.mode("append").parquet(src)
    go()
    assert sorted(r.image_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


@pytest.mark.parametrize("broken", ["work", "rows", "ids"])
def test_resume_is_exactly_once(spark, tmp_path, monkeypatch, broken):
    """A batch that breaks off before, between or after its two writes and is tried again gives its rows once."""
    from lumenrisk.streaming import resume

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "image_id long, text string"
    spark.createDataFrame([(1, "a"), (2, "bb")], schema).write.parquet(src)
    work = lambda d: d.where("image_id <> 2").select("image_id", F.length("text").alias("n"))
    go = lambda w=work: resume.process_new(spark, src, schema, out, ck, w).awaitTermination()
    go()
    spark.createDataFrame([(2, "bb"), (3, "ccc"), (4, "dddd")], schema).write.mode("append").parquet(src)
    if broken == "work":
        with pytest.raises(Exception, match="no work"):
            go(lambda d: (_ for _ in ()).throw(RuntimeError("no work")))
    else:
        from pyspark.sql.readwriter import DataFrameWriter

        real = DataFrameWriter.parquet

        def fails(self, path, *a, **b):
            if broken == "rows" and "-done/" in path:
                raise RuntimeError("lost")
            real(self, path, *a, **b)
            if broken == "ids" and "-done/" in path:
                raise RuntimeError("lost")

        with monkeypatch.context() as m:
            m.setattr(DataFrameWriter, "parquet", fails)
            with pytest.raises(Exception, match="lost"):
                go()
        if broken == "rows":
            assert sorted(r.image_id for r in resume.committed(spark, out).collect()) == [1]
    go()
    go()
    assert sorted((r.image_id, r.n) for r in resume.committed(spark, out).collect()) == [(1, 1), (3, 3), (4, 4)]
    assert sorted(r.image_id for r in spark.read.parquet(out).collect()) == [1, 3, 4]


def test_ablation_works_rows_out_once(spark):
    """A row's vector is worked out as often for four blocks as for none, and once for a search; figures are those of fits by hand."""
    worked = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i: int) -> list[float]:
        worked.add(1)
        return [float(i % 2), float(i % 3), float(i % 5), float(i * i % 7)]

    rows = L.feature_matrix(spark.range(60, numPartitions=2).select("id", (F.col("id") % 2).cast("int").alias("label"), vector("id").alias("v")), "v")
    splits = spark.range(60).select("id", F.when(F.col("id") % 10 < 6, "train").when(F.col("id") % 10 < 8, "val").otherwise("test").alias("split"))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    params, blocks = {"n_estimators": 2, "max_depth": 2}, {f"b{i}": (i, i + 1) for i in range(4)}
    assert [r.block for r in L.ablation("rf", params, rows, splits, "id", {}).collect()] == ["all"]
    one, worked.value = worked.value, 0
    got = {r.block: tuple(r)[1:] for r in L.ablation("rf", params, rows, splits, "id", blocks).collect()}
    assert worked.value == one and one <= 4 * 60
    assert got["b0"] == (1.0,) * 5 and list(got) == ["all", *blocks]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    parts = [R.in_split(rows, splits, s, "id").withColumn("x", F.slice("x", 3, 1)).withColumn("features", array_to_vector("x")).localCheckpoint() for s in ("train", "val", "test")]
    assert tuple(L.train_and_evaluate("rf", params, *parts)[0].first()) == pytest.approx(got["b2"])
    worked.value = 0
    L.train_and_evaluate("rf", {**params, "n_estimators": [2, 3]}, *[rows.where(F.col("id") % 10 >= a).where(F.col("id") % 10 < b) for a, b in ((0, 6), (6, 8), (8, 10))])[0].collect()
    assert worked.value <= 60
