"""Detector metrics as aggregates: confusion, threshold sweep, ROC-AUC, Mann-Whitney, bands, CHAIR."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import band_means

BANDS = [(0, 10), (10, 15), (15, 20), (20, 25), (25, 33)]
THRESHOLDS = 200


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def scores_of(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)}


def labelled(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.where(F.col(label).isin(0, 1))


def confusion(rows: DataFrame, predicted: str, label: str = "label") -> DataFrame:
    """One row: tp, fp, fn, tn."""
    p, y = F.col(predicted) == 1, F.col(label) == 1
    return rows.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))


def binary_metrics(rows: DataFrame, predicted: str, label: str = "label") -> DataFrame:
    c = confusion(rows, predicted, label)
    return c.select(*[v.alias(k) for k, v in scores_of(*map(F.col, ("tp", "fp", "fn", "tn"))).items()])


def confusion_matrix(rows: DataFrame, predicted: str, label: str = "label") -> DataFrame:
    """(label, pred_0, pred_1) for both labels, whether rows have them or not."""
    c = confusion(rows, predicted, label)
    row = lambda y, a, b: F.struct(F.lit(y).alias("label"), F.col(a).alias("pred_0"), F.col(b).alias("pred_1"))
    return c.select(F.inline(F.array(row(0, "tn", "fp"), row(1, "fn", "tp"))))


def classification_report(rows: DataFrame, predicted: str, label: str = "label") -> DataFrame:
    """(class, precision, recall, f1, support) of both classes, their mean and their mean weighted by support."""
    c = confusion(rows, predicted, label)
    one = lambda k, tp, fp, fn: F.struct(F.lit(k).alias("class"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    each = c.select(F.inline(F.array(one("0", tn, fn, fp), one("1", tp, fp, fn))))
    names = ("precision", "recall", "f1")
    macro = each.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = each.agg(*[ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support")
    return each.union(macro).union(weighted)


def running(rows: DataFrame, order: str, sums: list[str], by: Sequence[str] = (), buckets: int = 256) -> DataFrame:
    """``rows`` (one for each ``order`` value of a group) with before_<sum>: the sum over the group's smaller values.

    Values are cut into ranges at approximate quantiles; windows run inside a range and over the ranges' totals,
    so no task sees all values. ``by``: columns of few groups (the cuts and totals, ``buckets`` a group, are broadcast).
    """
    cuts = rows.groupBy(*by).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("__cuts"))
    cut = rows.join(F.broadcast(cuts), list(by)) if by else rows.crossJoin(F.broadcast(cuts))  # one row
    cut = cut.withColumn("__b", F.size(F.filter(F.array_distinct("__cuts"), lambda c: c < F.col(order)))).drop("__cuts")
    over = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "__b").agg(*[F.sum(s).alias(s) for s in sums])
    totals = totals.select(*by, "__b", *[F.coalesce(F.sum(s).over(over), F.lit(0)).alias(f"__t_{s}") for s in sums])
    inside = Window.partitionBy(*by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(totals), [*by, "__b"])  # at most ``buckets`` rows a group
    return out.withColumns({f"before_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"__t_{s}") for s in sums}).drop("__b", *[f"__t_{s}" for s in sums])


def _by_score(rows: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    y = F.col(label)
    return labelled(rows, label).where(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))


def roc_auc(rows: DataFrame, score: str, label: str = "label") -> DataFrame:
    """One row (auc, n_pos, n_neg), ties by midranks; NaN where a class is missing."""
    d = running(_by_score(rows, score, label), "s", ["neg"])
    agg = d.agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("u"), F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"))
    both = F.col("n_pos") * F.col("n_neg")
    return agg.select(F.when(both > 0, F.col("u") / both).otherwise(F.lit(float("nan"))).alias("auc"), "n_pos", "n_neg")


def mann_whitney(rows: DataFrame, score: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """(``by``, u, z, p) for class 1 against class 0: two-sided, with tie and continuity correction; one row without ``by``.

    For a smaller class of 8 rows at most, without ties, p is exact, whatever the size of the other class. NaN without
    one of the classes.
    """
    d = running(_by_score(rows, score, label, by), "s", ["neg"], by)
    t = F.col("pos") + F.col("neg")
    a = d.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)), F.lit(0.0)).alias("u"),
        F.coalesce(F.sum("pos"), F.lit(0)).cast("double").alias("n1"), F.coalesce(F.sum("neg"), F.lit(0)).cast("double").alias("n0"), F.sum(t.cast("double") * t * t - t).alias("ties"),
    )
    n, mu = F.col("n1") + F.col("n0"), F.col("n1") * F.col("n0") / 2
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - mu) - 0.5, F.lit(0.0)), sd)

    @F.pandas_udf("double")
    def p_value(zs: pd.Series, u: pd.Series, n1: pd.Series, n0: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([two_sided(*x) for x in zip(zs, u, n1, n0, ties, strict=True)])

    return a.select(*by, "u", z.alias("z"), p_value(z, "u", "n1", "n0", "ties").alias("p"))


def two_sided(z: float, u: float, n1: float, n0: float, ties: float) -> float:
    if min(n1, n0) <= 0:
        return float("nan")
    if min(n1, n0) <= 8 and not ties:
        return exact_p(u, int(n1), int(n0))
    return math.erfc(z / math.sqrt(2)) if z == z else 1.0  # all values equal: no evidence


@lru_cache(16)
def _numerator(k: int) -> tuple[int, list[int]]:
    """(L, A) with 1 / ((1 - q)(1 - q)(1 - q^2) ... (1 - q^k)) = A(q) / (1 - q^L)^(k + 1), L the least common multiple."""
    period = math.lcm(*range(1, k + 1))
    a = [1] + [0] * ((k + 1) * period)
    for step in (1, *range(1, k + 1)):  # times (1 - q^L) / (1 - q^step) = 1 + q^step + ... + q^(L - step)
        for i in range(step, len(a)):
            a[i] += a[i - step]
        for i in range(len(a) - 1, period - 1, -1):
            a[i] -= a[i - period]
    return period, a


def _partitions(m: int, k: int) -> int:
    """How many partitions of numbers up to ``m`` have ``k`` parts at most: a polynomial in m on each of L residues."""
    period, a = _numerator(k)
    return sum(a[j] * math.comb((m - j) // period + k, k) for j in range(m % period, min(m, len(a) - 1) + 1, period) if a[j])


def exact_p(u: float, n1: int, n0: int) -> float:
    """Two-sided p without ties: twice the share of the C(n1 + n0, k) rank sets with a statistic as far out as u.

    The sets with statistic s are counted by the Gaussian binomial (1 - q^(n+1)) ... (1 - q^(n+k)) / (1 - q) ... (1 - q^k).
    The 2^k signed terms of the product shift the partitions with k parts, which are counted in closed form in whole
    numbers; so time and memory don't depend on n.
    """
    k, n = min(n1, n0), max(n1, n0)
    least = int(min(u, n1 * n0 - u))
    terms = {0: 1}
    for i in range(1, k + 1):
        for shift, sign in list(terms.items()):
            terms[shift + n + i] = terms.get(shift + n + i, 0) - sign
    found = sum(sign * _partitions(least - shift, k) for shift, sign in terms.items() if shift <= least)
    return min(1.0, float(Fraction(2 * found, math.comb(n + k, k))))


def threshold_sweep(rows: DataFrame, score: str, label: str = "label", n: int = THRESHOLDS) -> DataFrame:
    """(i, tau, tp, fp, fn, tn) for n thresholds over the scores' range; predicted positive is score > tau.

    Each score is put in the bucket of the thresholds below it (by comparison with the threshold, not only by
    division), so one aggregate of at most n + 1 rows gives all counts as running sums.
    """
    d = labelled(rows, label).where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).alias("y"))
    span = d.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    tau = lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / F.lit(float(n - 1))
    guess = F.when(F.col("hi") > F.col("lo"), F.ceil((F.col("s") - F.col("lo")) * (n - 1) / (F.col("hi") - F.col("lo")))).otherwise(0)
    g = d.crossJoin(F.broadcast(span)).withColumn("g", F.least(F.greatest(guess.cast("int"), F.lit(0)), F.lit(n - 1)))  # one row
    k = F.when(tau(F.col("g")) < F.col("s"), F.col("g") + 1).when((F.col("g") > 0) & (tau(F.col("g") - 1) >= F.col("s")), F.col("g") - 1).otherwise(F.col("g"))
    hist = g.groupBy(k.alias("k")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    grid = rows.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("k"))
    all_k = grid.join(hist, "k", "left").na.fill(0, ["pos", "neg"])
    above = Window.orderBy(F.desc("k"))
    every = Window.partitionBy()
    c = all_k.select((F.col("k") - 1).alias("i"), F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("q"))
    c = c.where("i >= 0").crossJoin(F.broadcast(span)).where("lo is not null")
    return c.select("i", tau(F.col("i")).alias("tau"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("q") - F.col("fp")).alias("tn"))


def evaluate_threshold(rows: DataFrame, score: str, label: str = "label", n: int = THRESHOLDS) -> DataFrame:
    """One row: the first threshold of the best F1 with its precision, recall, F1 and accuracy, and the AUC."""
    sweep = threshold_sweep(rows, score, label, n)
    m = scores_of(*map(F.col, ("tp", "fp", "fn", "tn")))
    best = sweep.select("i", "tau", *[v.alias(k) for k, v in m.items()]).agg(F.max_by(F.struct("i", "tau", *m), F.struct("f1", -F.col("i"))).alias("b"))
    return best.select("b.*").where("i is not null").crossJoin(F.broadcast(roc_auc(rows, score, label).select("auc")))


def pope_accuracy(rows: DataFrame, answer: str = "answer", truth: str = "gt") -> DataFrame:
    """Confusion and rates of yes/no answers; unknown answers count in n_total only. No row for no rows."""
    a, t = F.col(answer), F.col(truth)
    n = lambda c: F.count_if(c)
    c = rows.agg(F.count("*").alias("n_total"), n((a == "yes") & (t == "yes")).alias("tp"), n((a == "yes") & (t == "no")).alias("fp"), n((a == "no") & (t == "yes")).alias("fn"), n((a == "no") & (t == "no")).alias("tn"))
    tp, fp, fn, tn, total = map(F.col, ("tp", "fp", "fn", "tn", "n_total"))
    return c.where("n_total > 0").select(ratio(tp + tn, total).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + fp, total).alias("yes_ratio"), "n_total", (tp + tn).alias("n_correct"), "tp", "fp", "fn", "tn")


def layer_bands(rows: DataFrame, curve: str, label: str = "label", bands: list[tuple[int, int]] = BANDS) -> DataFrame:
    """(band, label, n, mean, std): per-class mean and population deviation of each row's band mean."""
    each = labelled(rows, label).select(F.col(label).alias("label"), F.inline(band_means(F.col(curve), bands)))
    return each.where("value is not null").groupBy("band", "label").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def band_tests(rows: DataFrame, curve: str, label: str = "label", bands: list[tuple[int, int]] = BANDS) -> DataFrame:
    """(band, u, z, p): Mann-Whitney of the classes in each band, ranked by band in one pass; NaN for a band without values."""
    each = labelled(rows, label).select(F.col(label).alias("label"), F.inline(band_means(F.col(curve), bands))).select("label", "band", F.col("value").alias("v"))
    found = mann_whitney(each.where("v is not null"), "v", by=["band"])
    names = rows.sparkSession.createDataFrame([(f"{max(a, 1)}-{b}",) for a, b in bands], "band string")
    return names.join(F.broadcast(found), "band", "left").select("band", F.coalesce("u", F.lit(0.0)).alias("u"), "z", F.coalesce("p", F.lit(float("nan"))).alias("p"))


def chair_summary(images: DataFrame, mentions: DataFrame, key: str = "image_id", flag: str = "hallucinated") -> DataFrame:
    """One row over all images: mentions, hallucinated ones, images with one, and their shares (0 where empty)."""
    by = mentions.groupBy(key).agg(F.count("*").alias("m"), F.count_if(F.col(flag) == 1).alias("h"))
    a = images.select(key).join(by, key, "left").agg(F.count("*").alias("images"), F.coalesce(F.sum("m"), F.lit(0)).alias("object_mentions"), F.coalesce(F.sum("h"), F.lit(0)).alias("hallucinated_mentions"), F.count_if(F.col("h") > 0).alias("images_with_hallucination"))
    return a.select("*", ratio(F.col("images_with_hallucination"), F.col("images")).alias("chair_s"), ratio(F.col("hallucinated_mentions"), F.col("object_mentions")).alias("chair_i"))
