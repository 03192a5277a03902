"""The workflows end to end, each a function of tables that returns tables; resume and splits are joins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import arrays as A
from .functions import text as X
from .operators import captions as C
from .operators import kernels as K
from .operators import learn as L
from .operators import metrics as M
from .operators import relational as R
from .operators import shapley as S
from .sources.providers import CaptureProvider, Provider, provide, provide_captures
from .sources.readers import append_rows, exists
from .sources.staging import scratch

GENERATED = T.StructType([T.StructField("generated_text", T.StringType())])


def generate(samples: DataFrame, factory: Callable[[], Provider], done: DataFrame | None = None, key: str = "image_id") -> DataFrame:
    """(key, generated_text, error) of the samples that are not done yet."""
    return provide(R.pending(samples, done, key) if done is not None else samples, factory, key, GENERATED)


def label_captions(images: DataFrame, vocabulary: dict[str, str], truth: str, key: str = "image_id", encode: C.Encode | None = None) -> tuple[DataFrame, DataFrame]:
    """(labelling, summary): each image's spans with labels, and one row over all images. images: key, text, ``truth``."""
    spans = C.caption_spans(images, vocabulary, truth, key, encode)
    return C.labelling(images, spans, truth, key), M.chair_summary(images, spans.withColumn("hallucinated", F.col("label")), key)


def generate_and_label(samples: DataFrame, factory: Callable[[], Provider], vocabulary: dict[str, str], truth: str, key: str = "image_id", train: float = 0.9, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(splits, labelling, summary): images with a caption are split by hash rank, and labelled by the objects of ``truth``."""
    made = generate(samples, factory, key=key).where("error IS NULL").select(key, F.col("generated_text").alias("__made"))
    images = samples.select(key, truth).join(made, key).withColumnRenamed("__made", "text")
    return R.count_split(images.select(key), key, train, seed), *label_captions(images, vocabulary, truth, key)


def extract_features(labelling: DataFrame, captures: DataFrame, key: str = "image_id", done: DataFrame | None = None, **options) -> DataFrame:
    """Wide feature rows: (key, span_idx, word, label, score, feature_vector, curves) of every labelled span with captures.

    Spans and captures meet by (key, span_idx), so a missing capture costs its own span only. ``options`` go to the
    layer kernel (tau, top_k, mode, solver, lambdas, visual_k).
    """
    rows = R.pending(labelling, done, key) if done is not None else labelling
    spans = rows.select(key, F.posexplode("object_token_spans").alias("span_idx", "span")).select(key, "span_idx", "span.word", "span.label", F.col("span.first").alias("response_token_idx"))
    unit = F.struct(key, "span_idx")
    layers = K.layer_stats(captures.join(spans.select(key, "span_idx"), [key, "span_idx"], "left_semi").withColumn("__span", unit), **options)
    made = K.span_features(layers, "__span").withColumns({key: F.col(f"__span.{key}"), "span_idx": F.col("__span.span_idx")}).drop("__span")
    return spans.join(made, [key, "span_idx"])


def capture_features(labelling: DataFrame, samples: DataFrame, factory: Callable[[], CaptureProvider], captured: T.StructType, key: str = "image_id", done: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(features, errors): ``extract_features`` over captures that a provider makes for the labelled spans.

    samples: key, the provider's item, response_token_ids. ``captured``: the columns that the layer kernel reads. A span
    that fails is a row of errors (key, span_idx, error) and costs no other.
    """
    rows = R.pending(labelling, done, key) if done is not None else labelling
    span = lambda s, i: F.struct(i.cast("int").alias("span_idx"), s["first"].alias("response_token_idx"), F.lit(None).cast("long").alias("target_token_id"))
    items = samples.join(rows.select(key, F.transform("object_token_spans", span).alias("spans")), key)
    path = scratch(labelling.sparkSession, "captures")
    provide_captures(items, factory, key, captured).write.parquet(path)  # features and errors, one run of the model
    made = labelling.sparkSession.read.parquet(path)
    return extract_features(rows, made.where("error IS NULL").drop("error"), key, **options), made.where("error IS NOT NULL").select(key, "span_idx", "error")


def pope_rows(questions: DataFrame, answers: DataFrame, yes_only: bool = True, model: str = "_default") -> DataFrame:
    """Questions with the model's prompt, its parsed answer and the row's label. answers: question_id, generated_text."""
    rows = questions.join(answers.select("question_id", "generated_text"), "question_id")
    rows = rows.withColumns({"prompt": X.pope_prompt(F.lit(model), F.col("question")), "model_answer": X.yes_no(F.col("generated_text"))})
    return rows.withColumn("label", X.pope_label(F.col("model_answer"), F.col("gt_label"), yes_only))


@dataclass(frozen=True)
class QuestionSet:
    """One set of yes/no questions with what a model gave for them, each by question_id.

    answers: generated_text; attention: (layer, head, patch_attention) of the prompt's last position; states: (layer,
    token, patches) of the object's first token and the image; logits: the last position's. A question whose object was
    not found in the prompt has no states.
    """

    questions: DataFrame
    answers: DataFrame
    attention: DataFrame
    states: DataFrame
    logits: DataFrame


def question_features(rows: DataFrame, of: QuestionSet, ads: dict | None = None, cgc: dict | None = None, weighted: bool = False, done: DataFrame | None = None) -> DataFrame:
    """Wide rows of the questions of ``rows`` (``pope_rows``) that have captures and are not done yet: dispersion and
    grounding by layer and as scores, the predicted token's figures, and the attention's masses.

    ``ads``, ``cgc``: options of ``dispersion_scores`` and ``cgc_layer``; ``weighted`` weighs patches by the heads' mean
    attention. Every part is grouped by question_id, so the joins move no part again.
    """
    key = "question_id"
    rows = R.pending(rows, done, key) if done is not None else rows
    mine = lambda t: t.join(rows.select(key), key, "left_semi")
    attention = mine(of.attention)
    maps = attention.withColumnRenamed("patch_attention", "attention")
    spread = K.dispersion_scores(maps, key, **(ads or {})).select(key, F.col("score").alias("ads_score"), F.col("per_layer").alias("ads_per_layer"))
    states = mine(of.states)
    if weighted:
        states = states.join(K.top_heads(maps, [key, "layer"]), [key, "layer"])
    grounding = A.cgc_layer(F.col("token"), F.col("patches"), weights=F.col("attention") if weighted else None, **(cgc or {}))
    ground = states.select(key, "layer", grounding.alias("cgc")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("layer", "cgc"))).alias("s"))
    ground = ground.select(key, F.col("s.cgc").alias("cgc_per_layer")).select("*", A.cgc_score(F.col("cgc_per_layer")).alias("cgc_score"))
    token = mine(of.logits).select(key, "logits", A.token_stats(F.col("logits")).alias("t"))
    token = token.select(key, F.col("logits").alias("token_logits"), F.col("t.predicted").alias("token_id"), F.col("t.log_prob").alias("token_log_prob"), F.col("t.entropy").alias("token_entropy"), F.col("t.nll").alias("token_nll"))
    out = rows.select("*", F.col("object_word").alias("token_str"), F.lit(0).alias("response_token_idx"))
    for part in (spread, ground, token, masses(attention, key)):
        out = out.join(part, key)
    return out


def pope_pipeline(sets: dict[str, QuestionSet], grids: dict[str, dict], train: float = 0.8, seed: int = 42, yes_only: bool = True, model: str = "_default", out: str | None = None, explain: bool = False, **options) -> dict[str, DataFrame]:
    """Each set of questions (random, popular, adversarial) from answers to detectors; every table names its set.

    features: the wide rows, kept under ``out``/set (else in the shared scratch folder), where another run goes on;
    accuracy of the answers; splits of the images, kept likewise (images that a later run adds are in none); detection: threshold detectors on both scores over the labelled test
    rows; and, for sets whose training rows have both labels: classifiers, ablation and, with ``explain``, importance.
    """
    tables: dict[str, list[DataFrame]] = {}
    for name, of in sets.items():
        spark = of.questions.sparkSession
        path = f"{out}/{name}/features" if out else scratch(spark, f"features-{name}")
        rows = pope_rows(of.questions, of.answers, yes_only, model)
        done = spark.read.parquet(path).select("question_id") if exists(spark, path) else None
        append_rows(question_features(rows, of, done=done, **options), path)
        wide = spark.read.parquet(path)
        splits = _kept(R.count_split(wide.select("image_id").distinct(), "image_id", train, seed, ("val", "test")), f"{out}/{name}/splits" if out else scratch(spark, f"splits-{name}"))
        found = {"features": wide, "accuracy": M.pope_accuracy(wide, "model_answer", "gt_label"), "splits": splits}
        found["detection"] = baselines(M.labelled(R.in_split(wide, splits, "test")), ("ads_score", "cgc_score"))
        x = L.feature_matrix(wide.withColumn("feature_vector", A.feature_vector(F.col("ads_per_layer"), F.col("cgc_per_layer"))), "feature_vector")
        parts = {s: R.in_split(x, splits, s) for s in ("train", "val", "test")}
        if L.classes(parts["train"]) == 2:
            found |= classifiers(x, splits, parts, grids, ("ads", "cgc"), "image_id", explain)
        for table, rows in found.items():
            tables.setdefault(table, []).append(rows.select(F.lit(name).alias("questions"), "*"))
    return {t: reduce(DataFrame.unionByName, rows) for t, rows in tables.items()}


def _kept(rows: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, written from ``rows`` if there is none: every fit reads it, none works it out again."""
    if not exists(rows.sparkSession, f"{path}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def baselines(rows: DataFrame, scores: tuple[str, ...]) -> DataFrame:
    """(baseline, figures of the threshold detector) of each score column; none for a score without values."""
    each = [M.evaluate_threshold(rows, s).select(F.lit(s).alias("baseline"), "*") for s in scores]
    return reduce(DataFrame.union, each)


def classifiers(x: DataFrame, splits: DataFrame, parts: dict[str, DataFrame], grids: dict[str, dict], blocks: tuple[str, ...], key: str, explain: bool = False) -> dict[str, DataFrame]:
    """(classifier, parameters, figures) of each kind of ``grids``; the ablation of the equal ``blocks`` of the vector
    with the first kind's best parameters; with ``explain`` its Shapley values by block and layer."""
    trained, first = [], None
    for kind, params in grids.items():
        figures, best, model = L.train_and_evaluate(kind, params, parts["train"], parts["val"], parts["test"])
        trained.append(figures.select(F.lit(kind).alias("classifier"), F.lit(str(sorted(best.items()))).alias("parameters"), "*"))
        first = first or (kind, best, model)
    kind, best, model = first
    width = len(x.first()["x"])
    layers = width // len(blocks)
    out = {"classifiers": reduce(DataFrame.union, trained), "ablation": L.ablation(kind, best, x, splits, key, {b: (i * layers, (i + 1) * layers) for i, b in enumerate(blocks)})}
    if explain:
        rows = S.explained(parts["test"])
        if kind == "mlp":
            score = lambda r: L.predict(model, r.withColumn("features", array_to_vector("x")))
            rows = rows.withColumn("__row", F.monotonically_increasing_id())
            path = scratch(x.sparkSession, "explained")
            rows.select("__row", "x").write.parquet(path)  # the number must not change between two reads
            values = S.kernel_shapley(score, x.sparkSession.read.parquet(path), parts["train"], "__row", width)
        else:
            values = S.tree_shapley(model, rows)
        names = F.array(*map(F.lit, blocks))
        out["importance"] = S.layer_importance(values, layers).select(F.get(names, F.col("block")).alias("block"), "layer", "importance")
    return out


def evaluate_detection_only(rows: DataFrame, splits: DataFrame, score: str, key: str = "image_id") -> DataFrame:
    """One row over the test split: images, labelled tokens, hallucinated ones, and the threshold detector's figures."""
    test = M.labelled(R.in_split(rows, splits, "test", key))
    sums = test.agg(F.count_distinct(key).alias("test_images"), F.count("*").alias("test_object_tokens"), F.count_if(F.col("label") == 1).alias("test_hallucinated_tokens"))
    return sums.crossJoin(F.broadcast(M.evaluate_threshold(test, score)))  # one row each


def train_and_eval(rows: DataFrame, splits: DataFrame, grids: dict[str, dict], score: str, curve: str | tuple[str, ...], key: str = "image_id", scores: tuple[str, ...] = (), blocks: tuple[str, ...] = ("all",), explain: bool = False) -> dict[str, DataFrame]:
    """detection by the score; bands and band_tests of each curve; classifiers of ``grids``; the ablation of ``blocks``,
    equal parts of the vector; with ``explain`` the importance by block and layer; baselines: the threshold detector on
    each of the other ``scores`` over the test rows.

    rows: key, label, ``score``, the curves, feature_vector, the other scores.
    """
    x = L.feature_matrix(rows, "feature_vector")
    parts = {s: R.in_split(x, splits, s, key) for s in ("train", "val", "test")}
    curves = (curve,) if isinstance(curve, str) else curve
    named = lambda f: reduce(DataFrame.union, [f(rows, c).select(F.lit(c).alias("curve"), "*") for c in curves])
    out = {"detection": evaluate_detection_only(rows, splits, score, key), "bands": named(M.layer_bands), "band_tests": named(M.band_tests)}
    out |= classifiers(x, splits, parts, grids, blocks, key, explain)
    return out | ({"baselines": baselines(parts["test"], scores)} if scores else {})


def report(metrics: DataFrame, name: str) -> DataFrame:
    """(line): a metrics table as text, one line a row, for logs and text files."""
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.when(F.lit(t in ("double", "float")), F.format_string("%.4f", F.col(c).cast("double"))).otherwise(F.col(c).cast("string")), F.lit("none"))) for c, t in metrics.dtypes]
    return metrics.select(F.concat_ws("  ", F.lit(f"[{name}]"), *cells).alias("line"))


def masses(attention: DataFrame, key: str) -> DataFrame:
    """(key, alpha_img_per_layer, svar_score, attn_per_head_mid) from rows (key, layer, head, patch_attention)."""
    each = attention.withColumn("m", A.total(A.doubles(F.col("patch_attention"))))
    by = each.groupBy(key, "layer").agg(F.avg("m").alias("mass"), F.array_sort(F.collect_list(F.struct("head", (F.col("m") / F.size("patch_attention")).alias("mean")))).alias("heads"))
    s = by.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("layer", "mass", "heads"))).alias("s"))
    mid = F.get("s", F.floor(F.size("s") / 2).cast("int"))
    return s.select(key, F.col("s.mass").alias("alpha_img_per_layer"), A.svar_score(F.col("s.mass")).alias("svar_score"), F.transform(mid["heads"], lambda h: h["mean"]).alias("attn_per_head_mid"))
