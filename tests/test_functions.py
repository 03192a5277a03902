import math

import pytest
from pyspark.sql import functions as F

from lumenrisk.functions import arrays as A
from lumenrisk.functions import positions as P
from lumenrisk.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*v):
    return F.array(*[F.lit(x) for x in v])


@pytest.mark.parametrize("text,want", [("Yes, there is", "yes"), ("No.", "no"), ("", "unknown"), ("Maybe", "unknown"), ("I don't know", "no"), ("Eyes open", "yes"), ("There is no … yes", "yes")])
def test_yes_no(spark, text, want):
    assert one(spark, X.yes_no(F.lit(text))) == want


@pytest.mark.parametrize("answer,truth,only,want", [("yes", "no", True, 1), ("yes", "yes", True, 0), ("no", "yes", True, -1), ("no", "yes", False, 1), ("unknown", "no", False, -1)])
def test_pope_label(spark, answer, truth, only, want):
    assert one(spark, X.pope_label(F.lit(answer), F.lit(truth), only)) == want


def test_names_and_words(spark):
    assert one(spark, X.image_id(F.lit("COCO_val2014_000000000042.jpg"))) == 42
    assert one(spark, X.image_id(F.lit("img7_v2.jpg"))) == 7
    assert one(spark, X.object_word(F.lit("Is there a Dining Table in the image?"))) == "dining table"
    assert one(spark, X.object_word(F.lit("What is it?"))) is None
    assert one(spark, X.object_position(F.lit("a cat, the catalogue"), F.lit("cat"))) == 1
    assert one(spark, X.object_position(F.lit("concatenate"), F.lit("cat"))) == 1


@pytest.mark.parametrize("reply,want", [('```json["Meat"]```', ["meat"]), ("oops", []), ('{"a":1}', [])])
def test_reply(spark, reply, want):
    assert one(spark, X.reply_labels(F.lit(reply))) == want


def test_spans_and_mentions(spark):
    rows = spark.createDataFrame([(1, "A dog and a Dog house", "dog", 1, 3), (1, "A dog and a Dog house", "house", 0, 3)], "image_id long, text string, word string, label int, n_ids int")
    got = {r.word: (r.start, r.first, r.n_tokens) for r in X.token_spans(rows).collect()}
    assert got == {"dog": (2, 1, 1)}
    docs = spark.createDataFrame([(1, "a dining table near the table"), (2, "")], "doc_id long, text string")
    got = X.mentions(docs, {"dining table": "table", "table": "table", "dining": "room"}).orderBy("mention_index").collect()
    assert [(r.mention_index, r.word, r.object) for r in got] == [(0, "dining table", "table"), (1, "table", "table")]
    spans = F.array(F.struct(F.lit(1).alias("first"), F.lit(2).alias("last")), F.struct(F.lit(2).alias("first"), F.lit(9).alias("last")))
    assert [tuple(s) for s in one(spark, X.adapter_mentions(F.lit("a red car"), spans))] == [(2, 9, "red car")]


def test_arrays(spark):
    nan, inf = float("nan"), float("inf")
    assert one(spark, A.renormalize(arr(nan, inf, -1.0, 2.0))) == [0, 0, 0, 1]
    assert one(spark, A.renormalize(arr(0.0, 0.0))) == [0.5, 0.5]
    assert one(spark, A.topk_union(arr(0.5, 0.3, 0.2), arr(0.1, 0.2, 0.7), 2)) == [0, 2]
    assert one(spark, A.baseline_excess(arr(1.0, 1.0, 1.0, 5.0), 2, 3, 2.0)) == 4.0
    assert one(spark, A.baseline_excess(F.array().cast("array<double>"))) == 0.0
    assert one(spark, A.layer_slice(F.array(*[F.lit(float(i)) for i in range(8)]), 4, 0.25, 0.75)) == [1, 2, 5, 6]
    assert sum(one(spark, A.softmax(arr(1.0, 2.0, 3.0)))) == pytest.approx(1)
    assert [tuple(one(spark, A.find_hw(F.lit(n)))) for n in (576, 256, 12, 7)] == [(24, 24), (16, 16), (3, 4), (1, 7)]
    assert [one(spark, A.share_count(F.lit(n), 0.1)) for n in (576, 64, 25)] == [58, 6, 2]
    assert one(spark, A.cgc_score(arr(3.0))) == 3.0
    s = one(spark, A.token_stats(arr(0.0, 0.0)))
    assert s.predicted == 0 and s.log_prob == pytest.approx(math.log(0.5)) and s.entropy == pytest.approx(1)


def test_positions(spark):
    ids, s, e = arr(1, -200, 5, 6), F.lit(1), F.lit(577)
    prompt = P.prompt_positions(ids, 4, -200, s, e)
    assert one(spark, prompt) == [0, 577, 578]
    assert one(spark, P.prediction_position(F.lit(0), F.lit(4), prompt, F.lit(1), 576)) == 578
    assert one(spark, P.prediction_position(F.lit(2), F.lit(4), prompt, F.lit(1), 576)) == 580
    assert one(spark, P.support_positions("visual_prompt", F.lit(1), F.lit(3), arr(0, 3))) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        P.support_positions("other", s, e, prompt)
    assert tuple(one(spark, P.vision_range(arr(9, 1, 2, 8), 9, 8, (5, 261)))) == (1, 3)
    assert tuple(one(spark, P.vision_range(arr(1, 2), 9, 8, (5, 261)))) == (5, 261)
