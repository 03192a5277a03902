"""Sources, providers, captions, captures and workflows on small tables."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrisk import config, drivers
from lumenrisk.functions import arrays as A
from lumenrisk.functions import positions as P
from lumenrisk.functions import text as X
from lumenrisk.operators import captions as C
from lumenrisk.operators import captures as Z
from lumenrisk.operators import kernels as K
from lumenrisk.operators import learn as L
from lumenrisk.operators import metrics as M
from lumenrisk.operators import relational as R
from lumenrisk.sources import providers, readers


def test_exact_p_against_all_rank_sets():
    for n1, n0 in ((3, 3), (2, 7), (5, 4), (8, 5), (1, 6)):
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n0), n1)]
        for u in range(n1 * n0 + 1):
            want = min(1.0, 2 * sum(x >= max(u, n1 * n0 - u) for x in us) / len(us))
            assert M.exact_p(u, n1, n0) == pytest.approx(want, abs=1e-12)
    assert 0.9 < M.exact_p(4e5 - 3000, 8, 100_000) < 1
    big = 50_000_000
    assert M.exact_p(0, 1, big) == pytest.approx(2 / (big + 1), rel=1e-9)
    assert M.exact_p(1, big, 1) == pytest.approx(4 / (big + 1), rel=1e-9)
    assert M.exact_p(2, 2, big) == pytest.approx(2 * 4 / math.comb(big + 2, 2), rel=1e-9)  # sums 0, 1, 2 (twice)
    assert M.exact_p(3, 8, big) == pytest.approx(2 * 7 / math.comb(big + 8, 8), rel=1e-9)  # 1 + 1 + 2 + 3 partitions
    assert M.exact_p(12345, 1, big) == pytest.approx(2 * 12346 / (big + 1), rel=1e-9)
    assert M.exact_p(4 * big, 8, big) == 1.0
    assert M.two_sided(2.0, 0, 9, 10, 0) == pytest.approx(math.erfc(2 / math.sqrt(2)))
    assert M.two_sided(float("nan"), 0, 3, 4, 10) == 1.0 and math.isnan(M.two_sided(0.0, 0, 0, 4, 0))


def test_confusion_of_one_class(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0)], "label int, p int")
    assert sorted(map(tuple, M.confusion_matrix(rows, "p").collect())) == [(0, 0, 0), (1, 1, 1)]


def test_layer_risk_against_brute_force():
    """Three supports: the optimum over a fine grid of plans, for other weights than one."""
    rng = np.random.default_rng(0)
    for mode in K.COST_MODES:
        x, a, b, p = rng.normal(size=(3, 4)), np.array([0.5, 0.25, 0.25]), np.array([0.25, 0.25, 0.5]), rng.random(3)
        cost = K.cost_matrix(x, 1 - p, 1 - p, mode, 1.0, 0.5, 0.25, 2.0)
        best = min(
            sum(cost[s, t] for s, t in zip((0, 0, 1, 2), perm, strict=True)) / 4  # units of a quarter
            for perm in set(itertools.permutations((0, 1, 2, 2)))
        )
        assert K.layer_risk(x, a, b, p, 64, mode, lambdas=(1.0, 0.5, 0.25, 2.0))[0] == pytest.approx(best)
    with pytest.raises(ValueError):
        K.layer_risk(x, a, b, p, 64, "other")


def test_transport_that_cannot_settle(monkeypatch):
    with pytest.raises(ArithmeticError):
        monkeypatch.setattr(K, "range", lambda n: iter(()), raising=False)
        K.transport([0.2, 0.3, 0.5], [0.5, 0.3, 0.2], np.ones((3, 3)))


def test_caption_mentions_and_spans(spark):
    voc = {"hot dog": "hot dog", "dog": "dog", "cat": "cat"}
    text = "Ümit's hot  dog, a DOG; dog's hot cat"
    assert C.mentions_of(text, voc) == [("hot dog", 7, 15), ("dog", 19, 22), ("cat", 34, 37)]
    rows = spark.createDataFrame([(1, text, ["dog"], 6), (2, None, None, 0), (3, "", ["cat"], 0)], "image_id long, text string, truth array<string>, n int")
    got = [tuple(r)[1:] for r in C.caption_spans(rows, voc, "truth", "image_id").collect()]
    assert got == [(0, "hot dog", "hot  dog", 7, 15, 3, 2, 1), (1, "dog", "DOG", 19, 22, 7, 1, 0), (2, "cat", "cat", 34, 37, 13, 1, 1)]
    limited = C.caption_spans(rows, voc, "truth", "image_id", n_ids="n").collect()
    assert [r.word for r in limited] == ["hot dog"]
    letters = C.caption_spans(rows, voc, "truth", "image_id", encode=list).collect()  # any tokenizer: here each character
    assert [(r.first, r.n_tokens) for r in letters] == [(7, 8), (19, 3), (34, 3)]
    labelled, summary = drivers.label_captions(rows, voc, "truth", "image_id")
    one = {r.image_id: r for r in labelled.collect()}
    assert one[1].hallucinated_words == ["hot dog", "cat"] and one[1].chair_i == pytest.approx(2 / 3) and one[2].object_token_spans == []
    assert summary.first().images == 3 and summary.first().images_with_hallucination == 1


def test_mentions_against_a_plain_walk():
    voc = {"hot dog": "hot dog", "dog": "dog", "dog hot": "pair", "it's": "own"}
    for words in itertools.product(("hot", "Dog", "it's", "é"), repeat=5):
        text, want, i = " ".join(words) + ",", [], 0
        at = [sum(len(w) + 1 for w in words[:k]) for k in range(5)]
        low = [w.lower() for w in words]
        known = [k for k in range(5) if low[k] != "é"]  # no word of the pattern
        while i < len(known):
            k, after = known[i], known[i + 1] if i + 1 < len(known) else None
            two = voc.get(f"{low[k]} {low[after]}") if after is not None else None
            if two or low[k] in voc:
                last = after if two else k
                want.append((two or voc[low[k]], at[k], at[last] + len(words[last])))
            i += 2 if two else 1
        assert C.mentions_of(text, voc) == want, text


def test_token_spans_of_other_scripts(spark):
    rows = spark.createDataFrame([("éb b. B", "b"), ("a\\E+ x a\\E+", "a\\E+"), ("the hot dog", "hot dog")], "text string, word string")
    rows = rows.select(F.monotonically_increasing_id().alias("image_id"), "text", "word", F.lit(0).alias("label"), F.lit(20).alias("n_ids"))
    got = {r.word: (r.start, r["first"], r.n_tokens) for r in X.token_spans(rows).collect()}
    assert got["b"] == (3, 1, 1) and got["hot dog"] == (4, 1, 2)
    assert spark.range(1).select(X.yes_no(F.lit("\n\tno, yes")), X.yes_no(F.lit(" Yes"))).first()[:] == ("no", "yes")


def test_prompts(spark):
    row = spark.range(1).select(X.pope_prompt(F.lit("llava_next_7b"), F.lit("Is it?")), X.pope_prompt(F.lit("none"), F.lit("Is it?"))).first()
    assert row[0] == "[INST] <image>\nIs it?\nAnswer the question using a single word or phrase. [/INST]"
    assert row[1] == "Is it?\nAnswer the question using a single word or phrase."


def test_captures(spark):
    hidden = spark.createDataFrame([(1, 0, p, [float(p), 1.0], [0.5, 0.0], [1.0, float(p)]) for p in range(4)], "sample long, layer int, position int, h_prev array<double>, o_attn array<double>, o_ffn array<double>")
    r = Z.token_and_patches(hidden, 3, 0, 2).first()
    assert r.token == [4.5, 4.0] and r.patches == [[1.5, 1.0], [2.5, 2.0]]
    attention = spark.createDataFrame([(1, 0, h, 3, [0.1, 0.2, 0.3, 0.4 + h]) for h in (0, 1)], "sample long, layer int, head int, query int, weights array<double>")
    rows = Z.attention_rows(attention, F.lit(3), 0, 2).orderBy("head").collect()
    assert rows[1].patch_attention == [0.1, 0.2] and rows[1].text_attention == [0.3]
    plan = spark.createDataFrame([(1, [0, 1], [2, 3], 0, 2)], "sample long, support_positions array<int>, prompt_positions array<int>, visual_start int, visual_end int")
    targets = spark.createDataFrame([(1, 0, 7, 3)], "sample long, span_idx int, target_token_id long, prediction_position int")
    table = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0])], "token_id long, embedding array<double>")
    probs = spark.createDataFrame([(1, 0, 0, p, p / 10) for p in range(4)], "sample long, span_idx int, layer int, position int, probability double")
    known = Z.embedding_for_token(targets, table.where("false"), table, 2)
    c = Z.assemble(hidden, attention, plan, known, probs).first()
    assert c.support == [[0.5, 1.0], [1.5, 1.0]] and c.prompt_mean == [4.0, 3.5] and c.prompt_last == [4.5, 4.0] and c.update == [1.0, 3.0] and c.state == [4.5, 4.0]
    assert c.attention == pytest.approx([0.1, 0.2]) and c.semantic == [0.0, 0.1] and c.prompt_probabilities == [0.2, 0.3]
    with pytest.raises(Exception, match="no embedding of token 7"):
        Z.embedding_for_token(targets, table, table, 3).collect()
    labelling = spark.createDataFrame([(1, [(0, 0, "dog", "dog", 1, 1)])], "image_id long, object_token_spans array<struct<first:int,mention_index:int,word:string,surface:string,n_tokens:int,label:int>>")
    wide = drivers.extract_features(labelling, Z.assemble(hidden, attention, plan, known, probs).withColumnRenamed("sample", "image_id")).first()
    assert wide.word == "dog" and wide.label == 1 and len(wide.feature_vector) == 4 and wide.context_confidence[0] == pytest.approx(0.25 * wide.visual_cosine[0])
    assert drivers.extract_features(labelling, Z.assemble(hidden, attention, plan, known, probs).withColumnRenamed("sample", "image_id"), done=labelling).count() == 0


def test_target_probabilities(spark):
    w = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    rows = spark.createDataFrame([(1, [1.0, 2.0], 2), (2, [0.0, 1.0], 0), (3, [1.0, 1.0], 9)], "key long, state array<double>, target int")
    got = {r.key: r.probability for r in K.target_probabilities(rows, w).collect()}
    assert got[1] == pytest.approx(math.exp(3) / (math.exp(1) + math.exp(2) + math.exp(3))) and got[3] == 0
    assert got[2] == pytest.approx(1 / (1 + 2 * math.e))


def test_sharded_probabilities_equal_the_dense_form(spark):
    rng = np.random.default_rng(1)
    w = rng.normal(size=(50, 6)) * 3
    data = [(i, rng.normal(size=6).tolist(), int(rng.integers(-3, 55))) for i in range(40)]
    rows = spark.createDataFrame(data, "key long, state array<double>, target int").repartition(3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "token long, w array<double>")
    dense = {r.key: r.probability for r in K.target_probabilities(rows, w).collect()}
    for shard, block in ((7, 9), (50, 1000), (1, 40)):
        assert {r.key: r.probability for r in K.sharded_probabilities(rows, table, shard, block).collect()} == pytest.approx(dense)
    assert {r.probability for r in K.target_probabilities(rows, table.where("false")).collect()} == {0.0}
    with pytest.raises(ValueError, match="too large"):
        K.target_probabilities(rows, np.zeros((1 << 20, 16)))


def test_sharded_probabilities_over_many_partitions(spark):
    """Without coalesced partitions, the matrix's shards and the states' blocks meet only if both are dealt alike."""
    w = np.random.default_rng(2).normal(size=(10, 4))
    rows = spark.createDataFrame([(i, [i / 20, 1.0, -i / 10, 0.5], i % 10) for i in range(60)], "key long, state array<double>, target int")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "token long, w array<double>")
    dense = {r.key: r.probability for r in K.target_probabilities(rows, w).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.key: r.probability for r in K.sharded_probabilities(rows, table, 4, 16).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == pytest.approx(dense)


def test_positions(spark):
    got = spark.range(1).select(
        P.text_positions(F.lit(5), F.array(F.lit(1), F.lit(2)), F.lit(4)), P.image_input(F.array(F.lit(9)), -7, F.lit(2), F.array(F.lit(8))),
        A.residual(F.array(F.lit(1.0)), F.array(F.lit(2.0))), P.vision_range(F.array(F.lit(5), F.lit(6)), 1, 2, (5, 261)),
    ).first()
    assert got[0] == [0, 3] and tuple(got[1]) == ([9, -7, -7, 8], 1, 3) and got[2] == [3.0] and tuple(got[3]) == (5, 261)


def test_providers(spark):
    rows = spark.createDataFrame([(i, "" if i % 5 == 0 else f"TEXT {i}") for i in range(40)], "image_id long, text string").repartition(3)
    got = {r.image_id: r for r in drivers.generate(rows, lambda: providers.build("echo", {}), done=rows.where("image_id > 30")).collect()}
    assert len(got) == 31 and all((r.error is None) == (i % 5 > 0) == (r.generated_text == f"text {i}") for i, r in got.items())
    with pytest.raises(ValueError, match="unknown provider"):
        providers.build("none", {})
    splits, labelled, summary = drivers.generate_and_label(rows.withColumn("truth", F.array(F.lit("x"))), lambda: providers.build("echo", {}), {"text": "text"}, "truth")
    assert splits.count() == labelled.count() == 32 and summary.first().hallucinated_mentions == 32


def test_config(tmp_path):
    given = {
        "models": {"a": {"num_layers": 2, "vision_token": "<v>"}}, "feature_extraction": {"other": {"tau": 1}, "ads": {"connectivity": 4}},
        "dataset": {"seed": 1}, "classifiers": {"rf": {"max_depth": [None, 3]}}, "pope": {"splits": ["random"]},
    }
    (tmp_path / "c.json").write_text(json.dumps(given))
    c = config.load(str(tmp_path / "c.json"), transport="other")
    assert c.model("a").num_layers == 2 and c.model("a").num_visual_tokens is None and c.model("a").extras == {"vision_token": "<v>"}
    assert c.dispersion == config.Dispersion(connectivity=4) and c.grounding == config.Grounding() and c.transport.tau == 1.0 and isinstance(c.transport.tau, float)
    assert c.dataset.seed == 1 and c.dataset.train_ratio == 0.9 and c.classifiers == {"rf": {"max_depth": [None, 3]}} and c.questions.splits == ("random",)
    with pytest.raises(config.SettingsError, match="models.b is missing; there are a"):
        c.model("b")
    with pytest.raises(AttributeError):
        c.dataset.seed = 2
    assert config.settings({}).transport == config.Transport()


@pytest.mark.parametrize(
    "given,wrong",
    [
        ({"models": {"a": {}}}, "models.a.num_layers is missing"),
        ({"models": {"a": {"num_layers": "2"}}}, "models.a.num_layers must be int"),
        ({"models": {"a": {"num_layers": True}}}, "models.a.num_layers must be int"),
        ({"feature_extraction": {"more": {}}}, "feature_extraction.more is not known"),
        ({"feature_extraction": {"ads": {"size": 3}}}, "feature_extraction.ads.size is not known"),
        ({"feature_extraction": {"ads": {"connectivity": 5}}}, "feature_extraction.ads: connectivity must be 4 or 8"),
        ({"feature_extraction": {"cgc": {"mid_layer_pct": [0.2]}}}, "mid_layer_pct must be a list of 2"),
        ({"dataset": {"train_ratio": 1}}, "dataset: train_ratio"),
        ({"dataset": []}, None),
        ({"dataset": [1]}, "dataset must be a mapping"),
        ({"extra": 1}, "extra: not known"),
    ],
)
def test_config_errors_name_the_place(given, wrong):
    if wrong is None:
        assert config.settings(given).dataset == config.Dataset()
        return
    with pytest.raises(config.SettingsError, match=wrong.replace("[", r"\[")):
        config.settings(given)


def test_question_files(spark, tmp_path):
    line = {"text": "Is there a cat in the image?", "image": "7.jpg", "label": " No "}
    (tmp_path / "pope_random.json").write_text("\n" + json.dumps(line) + "\n\n" + json.dumps(line))
    got = readers.pope_questions(spark, str(tmp_path), split="random", images_dir="/i").orderBy("question_id").collect()
    assert [(r.question_id, r.image_path, r.gt_label) for r in got] == [(1, "/i/7.jpg", "no"), (3, "/i/7.jpg", "no")]
    with pytest.raises(FileNotFoundError):
        readers.pope_questions(spark, str(tmp_path), split="popular")
    with pytest.raises(FileNotFoundError):
        readers.coco_samples(spark, str(tmp_path / "none.json"), str(tmp_path / "none.json"))


def test_image_files_and_captions(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.jpg").write_bytes(b"x")
    samples = spark.createDataFrame([(1, "a.jpg"), (2, "b.jpg")], "image_id long, file_name string")
    assert [r.image_id for r in readers.existing_files(samples, str(tmp_path / "img")).collect()] == [1]
    (tmp_path / "c.jsonl").write_text('{"image_id": 1, "caption": "x"}\n{"image_id": 1, "caption": " "}\n{"image_id": 9, "caption": "y"}\n')
    assert readers.caption_rows(spark, str(tmp_path / "c.jsonl"), samples).count() == 1
    with pytest.raises(ValueError, match="no caption"):
        readers.caption_rows(spark, str(tmp_path / "c.jsonl"), samples.where("false"))
    (tmp_path / "m.json").write_text('{\n "3": {"n": 4}\n}')
    assert readers.json_map(spark, str(tmp_path / "m.json"), "n:long", whole=True).first()[:] == (3, 4)
    assert R.seeded_sample([1, 2, 3], 5) == [1, 2, 3] and len(R.seeded_sample(list(range(9)), 4)) == 4


def test_saved_models_and_training(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassificationModel

    rng = np.random.default_rng(0)
    data = [(i, [float(i % 2), *map(float, rng.random(3))], [float(i % 2)] * 12, float(i % 2), i % 2) for i in range(60)]
    rows = spark.createDataFrame(data, "image_id long, feature_vector array<double>, curve array<double>, score double, label int")
    splits = R.hash_split(rows.select("image_id"), "image_id", [("train", 0.5), ("val", 0.2), ("test", 0.3)])
    out = drivers.train_and_eval(rows, splits, {"rf": {"n_estimators": 30, "max_depth": 4}, "xgb": {"n_estimators": 2, "max_depth": 2}}, "score", "curve")
    assert out["detection"].first().f1 == 1 and {r.classifier: r.f1 for r in out["classifiers"].collect()} == {"rf": 1.0, "xgb": 1.0}
    assert {r.band for r in out["band_tests"].collect()} >= {"1-10", "10-15"}
    assert drivers.report(out["detection"], "test").first().line.startswith("[test]  test_images=")
    x = L.feature_matrix(rows.withColumn("none", F.lit(None).cast("array<double>")), "none", "feature_vector")
    assert x.first().x == data[0][1]
    model = L.build("rf", {"n_estimators": 20, "max_depth": 3}, 4).fit(x)
    readers.save_model(model, str(tmp_path / "m"))
    assert readers.load_model(RandomForestClassificationModel, str(tmp_path / "m")).getNumTrees == 20
    got = {r.block: r.importance for r in L.block_importance(model, x, 1, repeats=2).collect()}
    assert len(got) == 4 and got[0] > max(got[1], got[2], got[3])
