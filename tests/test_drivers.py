"""Whole workflows: questions in several sets, captures by a provider, training with all its tables."""

import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from lumenrisk import drivers
from lumenrisk.operators import kernels as K
from lumenrisk.operators import relational as R
from lumenrisk.sources import providers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the providers below go to workers as they are

LAYERS, PATCHES = 4, 6


def question_set(spark, seed, n):
    """Questions whose dispersion and grounding tell wrong answers apart; the last one has no states."""
    rng = np.random.default_rng(seed)
    wrong = [i % 2 for i in range(n)]
    q = spark.createDataFrame([(i, i // 2, f"Is there a cat{i} in the image?", f"cat{i}", "no" if w else "yes") for i, w in enumerate(wrong)], "question_id long, image_id long, question string, object_word string, gt_label string")
    a = spark.createDataFrame([(i, "Yes." if i % 10 < 8 else "no" if i % 10 == 8 else "maybe") for i in range(n)], "question_id long, generated_text string")
    maps = [(i, layer, h, (rng.random(PATCHES) + (0 if w else 5) * np.eye(PATCHES)[1]).tolist()) for i, w in enumerate(wrong) for layer in range(LAYERS) for h in (0, 1)]
    token = lambda w: [1.0, 0.0] if not w else [-1.0, 0.2]
    states = [(i, layer, token(w), (np.array([[1.0, 0.0]] * PATCHES) + rng.random((PATCHES, 2)) / 9).tolist()) for i, w in enumerate(wrong[:-1]) for layer in range(LAYERS)]
    logits = [(i, rng.normal(size=5).tolist()) for i in range(n)]
    return drivers.QuestionSet(
        q, a,
        spark.createDataFrame(maps, "question_id long, layer int, head int, patch_attention array<double>"),
        spark.createDataFrame(states, "question_id long, layer int, token array<double>, patches array<array<double>>"),
        spark.createDataFrame(logits, "question_id long, logits array<double>"),
    )


def test_question_features_against_numpy(spark):
    of = question_set(spark, 3, 6)
    rows = drivers.pope_rows(of.questions, of.answers)
    got = {r.question_id: r for r in drivers.question_features(rows, of, weighted=True).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    heads, states = of.attention.orderBy("layer", "head").collect(), of.states.orderBy("layer").collect()
    for i, r in got.items():
        maps = np.array([x.patch_attention for x in heads if x.question_id == i]).reshape(LAYERS, 2, PATCHES)
        assert r.ads_per_layer == pytest.approx([K.dispersion(m.mean(0)) for m in maps])
        assert r.ads_score == pytest.approx(np.mean(r.ads_per_layer[1:3]))
        assert r.svar_score == pytest.approx(maps.sum(-1).mean(-1)[0:2].sum())
        assert r.attn_per_head_mid == pytest.approx(maps[2].mean(-1).tolist())
        s = [x for x in states if x.question_id == i]
        cos = [np.array(x.patches) @ x.token / (np.linalg.norm(x.token) * np.linalg.norm(x.patches, axis=1)) for x in s]
        assert r.cgc_per_layer == pytest.approx([float(c @ m.mean(0) / m.mean(0).sum()) for c, m in zip(cos, maps, strict=True)])
        p = np.exp(r.token_logits) / np.exp(r.token_logits).sum()
        assert r.token_id == int(np.argmax(p)) and r.token_nll == pytest.approx(-math.log(p.max()))
        assert r.label == (1 if i % 2 else 0) and r.token_str == f"cat{i}" and r.response_token_idx == 0
    assert drivers.question_features(rows, of, done=of.questions).count() == 0


def test_pope_pipeline_over_sets(spark, tmp_path):
    sets = {"random": question_set(spark, 1, 60), "adversarial": question_set(spark, 4, 2)}  # one label in the second
    grids = {"rf": {"n_estimators": 10, "max_depth": 3}}
    out = drivers.pope_pipeline(sets, grids, train=0.6, out=str(tmp_path))
    accuracy = {r.questions: r for r in out["accuracy"].collect()}
    assert accuracy["random"].n_total == 59 and set(accuracy) == set(sets)
    assert accuracy["random"].tp == sum(1 for i in range(59) if i % 2 == 0 and i % 10 < 8)
    assert {(r.questions, r.baseline) for r in out["detection"].collect()} >= {("random", "ads_score"), ("random", "cgc_score")}
    assert {r.questions: r.f1 for r in out["classifiers"].collect()} == {"random": 1.0}
    assert {(r.questions, r.block) for r in out["ablation"].collect()} == {("random", b) for b in ("all", "ads", "cgc")}
    split = {(r.questions, r.image_id) for r in out["splits"].collect()}
    assert len(split) == out["splits"].count() == 30 + 1
    again = drivers.pope_pipeline({"adversarial": sets["adversarial"]}, grids, train=0.6, out=str(tmp_path))
    assert again["features"].count() == 1 and "classifiers" not in again  # nothing is done twice


class Model:
    """Captures that are functions of the token; token 13 fails, and so does a call that holds it."""

    num_layers, num_visual_tokens = 2, 3
    calls = 0

    def capture(self, item, prefix, index, target):
        if target == 13:
            raise RuntimeError("no memory")
        assert len(prefix) == index
        return [{"value": float(target), "states": [float(len(prefix)), float(layer), item["weight"]]} for layer in range(self.num_layers)]


CAPTURED = "value double, states array<double>"


def test_captures_from_a_provider(spark):
    from pyspark.sql import types as T

    span = lambda i, at, t=None: (i, at, t)
    rows = spark.createDataFrame(
        [(1, 0.5, [11, 12, 13], [span(0, 0), span(1, 2), span(2, 1, 77)]), (2, 0.25, [5], [span(0, 0), span(1, 4)]), (3, 0.0, [5], []), (4, 0.0, None, [span(0, 0)])],
        "image_id long, weight double, response_token_ids array<int>, spans array<struct<span_idx:int,response_token_idx:int,target_token_id:long>>",
    )
    kinds = T.StructType.fromDDL(CAPTURED)
    got = sorted(map(tuple, providers.provide_captures(rows, Model, "image_id", kinds).collect()), key=str)
    assert got == sorted([
        (1, 0, 0, 11.0, [0.0, 0.0, 0.5], None), (1, 0, 1, 11.0, [0.0, 1.0, 0.5], None),
        (1, 1, None, None, None, "RuntimeError: no memory"),
        (1, 2, 0, 77.0, [1.0, 0.0, 0.5], None), (1, 2, 1, 77.0, [1.0, 1.0, 0.5], None),
        (2, 0, 0, 5.0, [0.0, 0.0, 0.25], None), (2, 0, 1, 5.0, [0.0, 1.0, 0.25], None),
        (2, 1, None, None, None, "IndexError: token 4 of 1"),
    ], key=str)


class Layers(Model):
    """Captures with the columns of the layer kernel; knows how to take a batch."""

    def capture_batch(self, item, ids, indices, targets):
        rng = np.random.default_rng(targets)
        return [[layer_capture(rng) for _ in range(self.num_layers)] for _ in targets]


def layer_capture(rng):
    two = lambda n: rng.normal(size=(n, 2)).tolist()
    return {
        "positions": [0, 1], "visual_start": 0, "visual_end": 2, "support": two(2), "prompt_last": two(1)[0], "prompt_mean": two(1)[0], "update": two(1)[0], "state": two(1)[0],
        "attention": [0.5, 0.5], "semantic": [0.1, 0.4], "prompt_probabilities": [0.2, 0.3], "target_embedding": two(1)[0],
    }


def test_features_from_a_provider(spark):
    from pyspark.sql import types as T

    kinds = T.StructType.fromDDL("positions array<int>, visual_start int, visual_end int, support array<array<double>>, prompt_last array<double>, prompt_mean array<double>, update array<double>, state array<double>, attention array<double>, semantic array<double>, prompt_probabilities array<double>, target_embedding array<double>")
    labelling = spark.createDataFrame([(1, [(0, 0, "dog", "dog", 1, 1), (1, 1, "cat", "cat", 1, 0), (9, 2, "cow", "cow", 1, 0)])], "image_id long, object_token_spans array<struct<first:int,mention_index:int,word:string,surface:string,n_tokens:int,label:int>>")
    samples = spark.createDataFrame([(1, "x.jpg", [4, 5])], "image_id long, image_path string, response_token_ids array<int>")
    wide, errors = drivers.capture_features(labelling, samples, Layers, kinds)
    assert {(r.span_idx, r.word, r.label, len(r.feature_vector)) for r in wide.collect()} == {(0, "dog", 1, 8), (1, "cat", 0, 8)}
    assert [tuple(r) for r in errors.collect()] == [(1, 2, "IndexError: token 9 of 2")]


def test_train_and_eval_gives_all_tables(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(i % 2), *map(float, rng.random(3))], [float(i % 2)] * 12, rng.random(12).tolist(), float(i % 2), i % 2, float(rng.random())) for i in range(60)]
    rows = spark.createDataFrame(data, "image_id long, feature_vector array<double>, curve array<double>, other array<double>, score double, label int, noise double")
    splits = R.hash_split(rows.select("image_id"), "image_id", [("train", 0.5), ("val", 0.2), ("test", 0.3)])
    out = drivers.train_and_eval(rows, splits, {"rf": {"n_estimators": 20, "max_depth": 3}}, "score", ("curve", "other"), scores=("score", "noise"), blocks=("first", "second"), explain=True)
    assert {r.curve for r in out["bands"].collect()} == {r.curve for r in out["band_tests"].collect()} == {"curve", "other"}
    f1 = {r.baseline: r.f1 for r in out["baselines"].collect()}
    assert f1["score"] == 1.0 and f1["noise"] < 1.0
    ablated = {r.block: r.f1 for r in out["ablation"].collect()}
    assert ablated["all"] == ablated["first"] == 1.0 and ablated["second"] < 1.0
    importance = {(r.block, r.layer): r.importance for r in out["importance"].collect()}
    assert len(importance) == 4 and max(importance, key=importance.get) == ("first", 0)
    lines = [r.line for r in drivers.report(out["baselines"].select("baseline", "f1"), "b").collect()]
    assert "[b]  baseline=score  f1=1.0000" in lines
