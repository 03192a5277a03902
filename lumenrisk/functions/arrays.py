"""Array expressions (no UDF): vectors, distributions, top-k, layer slices. A null array gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside another function's lambda it would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    """Mean; NaN for an empty array."""
    return F.when(F.size(v) > 0, total(v) / F.size(v)).otherwise(F.lit(float("nan")))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column, floor: float) -> Column:
    return F.greatest(F.sqrt(dot(v, v)), F.lit(floor))


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    """Cosine similarity with each norm held at ``floor`` at least."""
    return dot(a, b) / (norm(a, floor) * norm(b, floor))


def normalise(v: Column, floor: float = 1e-12) -> Column:
    return let(norm(v, floor), lambda n: F.transform(v, lambda x: x / n))


def softmax(v: Column) -> Column:
    e = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(e, lambda y: let(total(y), lambda t: F.transform(y, lambda x: x / t)))


def temperature_softmax(v: Column, tau: float = 0.07) -> Column:
    t = max(tau, 1e-6)
    return softmax(F.transform(v, lambda x: x / F.lit(t)))


def clean(v: Column, other: float = 0.0) -> Column:
    """NaN and infinities become ``other``, negatives 0."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.transform(v, lambda x: F.when(bad(x), F.lit(other)).otherwise(F.greatest(x, F.lit(0.0))))


def renormalize(v: Column) -> Column:
    """A distribution from any weights; uniform where there is hardly any mass."""
    even = lambda c: F.transform(c, lambda x: F.lit(1.0) / F.size(c))
    return let(clean(v), lambda c: let(total(c), lambda t: F.when(t <= 1e-12, even(c)).otherwise(F.transform(c, lambda x: x / t))))


def top_indices(v: Column, k: Column | int) -> Column:
    """0-based indices of the k largest values, largest first, ties by index."""
    order = F.array_sort(F.transform(v, lambda x, i: F.struct((-x).alias("k"), i.alias("i"))))
    return F.transform(F.slice(order, F.lit(1), _int(k)), lambda s: s["i"])


def top_values(v: Column, k: Column | int) -> Column:
    return F.slice(F.sort_array(v, asc=False), F.lit(1), _int(k))


def _int(k: Column | int) -> Column:
    return k if isinstance(k, Column) else F.lit(k)


def share_count(n: Column, pct: float) -> Column:
    """max(1, min(round(n * pct), n)), halves to the even number."""
    return F.greatest(F.lit(1), F.least(F.rint(n * F.lit(pct)).cast("int"), n))


def topk_union(source: Column, target: Column, k: int) -> Column:
    """Sorted union of the top k/2 indices (one at least) of two distributions."""
    half = max(1, k // 2)
    return F.array_sort(F.array_union(top_indices(source, half), top_indices(target, half)))


def take(v: Column, indices: Column) -> Column:
    return F.transform(indices, lambda i: F.get(v, i))


def semantic_penalty(p: Column) -> Column:
    return F.transform(p, lambda x: F.greatest(F.lit(0.0), 1.0 - x))


def baseline_excess(risk: Column, baseline_layers: int = 10, start_layer: int = 15, alpha: float = 2.0) -> Column:
    """Sum of what later layers exceed mean + alpha * population deviation of the first layers; 0 if empty."""
    first = F.slice(risk, F.lit(1), F.greatest(F.lit(1), F.least(F.lit(baseline_layers), F.size(risk))))
    over = lambda cut: F.transform(risk, lambda x, i: F.when(i + 1 >= start_layer, F.greatest(F.lit(0.0), x - cut)).otherwise(0.0))
    deviation = lambda f, mu: F.sqrt(mean(F.transform(f, lambda x: (x - mu) * (x - mu))))
    cut = let(first, lambda f: let(mean(f), lambda mu: mu + alpha * deviation(f, mu)))
    return F.when(F.size(risk) == 0, F.lit(0.0)).otherwise(let(cut, lambda c: total(over(c))))


def layer_slice(v: Column, layers: int, low: float, high: float) -> Column:
    """[int(L*low), int(L*high)) of every L-block; of the whole vector where L does not divide it."""
    start, end = int(layers * low), int(layers * high)
    blocks = F.flatten(F.transform(F.sequence(F.lit(0), (F.size(v) / layers).cast("int") - 1), lambda b: F.slice(v, b * layers + start + 1, F.lit(end - start))))
    whole = F.slice(v, (F.size(v) * low).cast("int") + 1, (F.size(v) * high).cast("int") - (F.size(v) * low).cast("int"))
    return F.when((F.size(v) % layers == 0) & (F.size(v) >= layers), blocks).otherwise(whole)


def middle(v: Column, low: float = 0.25, high: float = 0.75) -> Column:
    """Layers [int(L*low), int(L*high))."""
    start = F.floor(F.size(v) * F.lit(low)).cast("int")
    return F.slice(v, start + 1, F.floor(F.size(v) * F.lit(high)).cast("int") - start)


def cgc_score(layers: Column) -> Column:
    """Mean over the middle layers; over all of them if there is no middle one."""
    mid = middle(layers)
    return F.when(F.size(mid) > 0, mean(mid)).otherwise(mean(layers))


def svar_score(mass: Column) -> Column:
    return total(middle(mass, 0.15, 0.55))


def cgc_layer(token: Column, patches: Column, k: int = 5, pct: float = 0.0, weights: Column | None = None) -> Column:
    """Token-to-patch grounding of a layer: weighted mean cosine, or that of the top k (or top share) patches."""
    cos = let(norm(token, 1e-12), lambda t: F.transform(patches, lambda p: dot(token, p) / (t * norm(p, 1e-12))))
    if weights is not None:
        return dot(cos, weights) / (total(weights) + F.lit(1e-12))
    n = share_count(F.size(patches), pct) if pct > 0 else F.least(F.lit(k), F.size(patches))
    return mean(top_values(cos, n))


def atarget_visual(states: Column, positions: Column, target_dist: Column, embedding: Column, start: Column | int, end: Column | int, k: int = 32) -> Column:
    """Mean cosine of the target embedding with the k likeliest supports inside the visual range; 0 without any."""
    inside = F.filter(F.transform(positions, lambda p, i: F.when((p >= start) & (p < end), F.struct((-F.get(target_dist, i)).alias("w"), i.alias("i")))), lambda s: s.isNotNull())
    best = F.slice(F.array_sort(inside), F.lit(1), F.lit(k))
    cos = F.transform(best, lambda s: cosine(embedding, F.get(states, s["i"])))
    return F.when(F.size(best) == 0, F.lit(0.0)).otherwise(mean(cos))


def token_stats(logits: Column) -> Column:
    """(predicted, log_prob, entropy, nll) of the most likely token; entropy over log V."""
    predicted = argmax(logits)
    entropy = lambda p: -total(F.transform(F.filter(p, lambda x: x > 1e-12), lambda x: x * F.log(x))) / F.log(F.size(logits).cast("double"))

    def stats(p: Column) -> Column:
        lp = F.log(F.greatest(F.array_max(p), F.lit(1e-12)))
        return F.struct(predicted.alias("predicted"), lp.alias("log_prob"), entropy(p).alias("entropy"), (-lp).alias("nll"))

    return let(softmax(doubles(logits)), stats)


def find_hw(n: Column) -> Column:
    """(h, w): the largest divisor h up to sqrt(n), and n / h."""
    h = F.array_max(F.filter(F.sequence(F.lit(1), F.floor(F.sqrt(n)).cast("int")), lambda d: n % d == 0))
    return F.struct(h.alias("h"), (n / h).cast("int").alias("w"))


def feature_vector(*blocks: Column) -> Column:
    return F.concat(*blocks)


def residual(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def argmax(v: Column) -> Column:
    """0-based index of the first largest value."""
    return F.array_position(v, F.array_max(v)).cast("int") - 1


def band_means(v: Column, bands: list[tuple[int, int]]) -> Column:
    """Struct of (band, mean) for the bands that hold a layer; ends are cut to the number of layers. Names count from 1."""
    parts = []
    for a, b in bands:
        cut = F.slice(v, F.lit(a + 1), F.greatest(F.least(F.lit(b), F.size(v)) - a, F.lit(0)))
        parts.append(F.struct(F.lit(f"{max(a, 1)}-{b}").alias("band"), F.when(F.size(cut) > 0, mean(cut)).alias("value")))
    return F.array(*parts)


