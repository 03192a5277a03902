"""Numeric kernels in Arrow batches: exact optimal transport, per-layer transport risk, attention dispersion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from .simplex import network_simplex

SOLVERS, COST_MODES = ("linprog", "emd"), ("direct", "decomposed")


def probability(x: np.ndarray) -> np.ndarray:
    x = np.maximum(np.nan_to_num(np.asarray(x, float), nan=0.0, posinf=0.0, neginf=0.0), 0.0)
    s = x.sum()
    return x / s if s > 1e-12 else np.full(len(x), 1 / max(len(x), 1))


def transport(source: np.ndarray, target: np.ndarray, cost: np.ndarray, solver: str = "linprog") -> float:
    """Exact discrete optimal transport: ``linprog`` by successive shortest paths with potentials, ``emd`` by the network
    simplex. Both have the same optimum. Where staying is free, equal distributions
    cost nothing and two points have a closed form. A flow that can't be completed is an error, never a partial cost.
    """
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver!r}")
    supply, demand = probability(source), probability(target)
    c = np.maximum(np.nan_to_num(np.asarray(cost, float), nan=1e6, posinf=1e6, neginf=1e6), 0.0)
    n, m, eps = len(supply), len(demand), 1e-13
    if n == m and not c.diagonal().any():
        if (supply == demand).all():
            return 0.0
        if n == 2:
            return float(max(supply[0] - demand[0], 0) * c[0, 1] + max(demand[0] - supply[0], 0) * c[1, 0])
    if solver == "emd":
        return network_simplex(supply, demand, c) if n and m else 0.0
    flow, u, v = np.zeros((n, m)), np.zeros(n), np.zeros(m)
    for _ in range(50 * (n + m)):
        if supply.max(initial=0) <= eps or demand.max(initial=0) <= eps:
            return float((flow * c).sum())
        ds, dt = np.where(supply > eps, 0.0, np.inf), np.full(m, np.inf)
        via_t, via_s = np.full(m, -1), np.full(n, -1)
        seen_s, seen_t = np.zeros(n, bool), np.zeros(m, bool)
        reduced = np.maximum(c + u[:, None] - v, 0.0)
        while True:
            a, b = np.where(seen_s, np.inf, ds), np.where(seen_t, np.inf, dt)
            i, j = int(a.argmin()), int(b.argmin())
            if a[i] <= b[j]:
                if a[i] == np.inf:
                    raise ArithmeticError("no path is left although mass is")
                seen_s[i] = True
                near = a[i] + reduced[i]
                better = ~seen_t & (near < dt)
                dt[better], via_t[better] = near[better], i
            else:
                seen_t[j] = True
                if demand[j] > eps:
                    break
                back = (flow[:, j] > eps) & ~seen_s & (b[j] < ds)  # reduced cost of used arcs is 0
                ds[back], via_s[back] = b[j], j
        d = dt[j]
        u, v = u + np.minimum(ds, d), v + np.minimum(dt, d)
        path, t = [], j
        while True:
            s = int(via_t[t])
            path.append((s, t, 1))
            if via_s[s] < 0:
                break
            t = int(via_s[s])
            path.append((s, t, -1))
        move = min([supply[s], demand[j], *[flow[x, y] for x, y, sign in path if sign < 0]])
        for x, y, sign in path:
            flow[x, y] += sign * move
        supply[s] -= move
        demand[j] -= move
    raise ArithmeticError("the transport did not settle")


def cost_matrix(states: np.ndarray, s: np.ndarray, t: np.ndarray, mode: str, ld: float = 1, ls: float = 1, lt: float = 1, lint: float = 1) -> np.ndarray:
    if mode not in COST_MODES:
        raise ValueError(f"unknown cost mode {mode!r}")
    x = states / np.maximum(np.linalg.norm(states, axis=1, keepdims=True), 1e-12)
    dist = np.maximum(0.0, 1 - x @ x.T)
    cost = ld * dist + lint * dist * (s[:, None] + t[None, :])
    return cost + ls * s[:, None] + lt * t[None, :] if mode == "direct" else cost


def layer_risk(states: np.ndarray, source: np.ndarray, target: np.ndarray, semantic: np.ndarray, top_k: int = 64, mode: str = "direct", solver: str = "linprog", lambdas: tuple[float, float, float, float] = (1, 1, 1, 1)) -> tuple[float, int]:
    """Transport risk of a layer over the union of both distributions' top supports, and that union's size.

    lambdas: weights of distance, source penalty, target penalty and interaction. The separable penalties of the
    direct mode are fixed by the marginals, so they are added to the transport of the rest.
    """
    if mode not in COST_MODES:
        raise ValueError(f"unknown cost mode {mode!r}")
    half = max(1, top_k // 2)
    top = lambda d: np.argsort(-d, kind="stable")[:half]
    keep = np.union1d(top(source), top(target))
    penalty = np.maximum(0.0, 1 - semantic[keep])
    a, b = probability(source[keep]), probability(target[keep])
    ld, ls, lt, lint = lambdas
    risk = transport(a, b, cost_matrix(states[keep], penalty, penalty, "decomposed", ld, ls, lt, lint), solver)
    return risk + (float(ls * a @ penalty + lt * b @ penalty) if mode == "direct" else 0.0), len(keep)


def _matrices(column: pa.Array) -> list[np.ndarray]:
    """Each row's array of arrays as a matrix, out of the column's flat values."""
    inner = column.flatten()
    values = inner.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    wide = np.concatenate(([0], np.cumsum(inner.value_lengths().to_numpy(zero_copy_only=False))))
    return [values[wide[b - n] : wide[b]].reshape(n, -1) for b, n in zip(ends, np.diff(np.append(0, ends)), strict=True)]


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return np.split(column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(column) else []


def transport_risk(rows: DataFrame, top_k: int = 64, mode: str = "direct", solver: str = "linprog", lambdas: tuple[float, float, float, float] = (1, 1, 1, 1)) -> DataFrame:
    """``rows`` (support array<array<double>>, source_dist, target_dist, semantic) with risk and selected_support_size."""
    if mode not in COST_MODES or solver not in SOLVERS:
        raise ValueError("unknown cost mode or solver")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = zip(_matrices(b.column("support")), *[_vectors(b.column(n)) for n in ("source_dist", "target_dist", "semantic")], strict=True)
            got = [layer_risk(x, s, t, p, top_k, mode, solver, lambdas) for x, s, t, p in each]
            more = [pa.array([r for r, _ in got], pa.float64()), pa.array([k for _, k in got], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "risk", "selected_support_size"])

    schema = T.StructType([*rows.schema, T.StructField("risk", T.DoubleType()), T.StructField("selected_support_size", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def layer_inputs(captures: DataFrame, tau: float = 0.07) -> DataFrame:
    """Captures in long form, one row a layer, with source and target distributions over the supports."""
    update = F.transform("support", lambda s: A.cosine(F.col("update"), s))
    weights = F.zip_with(A.renormalize(F.col("attention")), F.col("semantic"), lambda a, p: a * p)
    return captures.withColumns({"source_dist": A.temperature_softmax(update, tau), "target_dist": A.renormalize(weights)})


def layer_stats(captures: DataFrame, tau: float = 0.07, top_k: int = 64, mode: str = "direct", solver: str = "linprog", lambdas: tuple[float, float, float, float] = (1, 1, 1, 1), visual_k: int = 32) -> DataFrame:
    """One row a layer: risk, cosines of the predicting state with the prompt's last and mean state, visual cosine,
    context confidence, support sizes.

    captures: update (the feed-forward output at the predicting position), state (the layer's output there), support
    (states), positions, attention, semantic, prompt_last, prompt_mean, prompt_probabilities (of the target by prompt
    position), target_embedding, visual_start, visual_end.
    """
    rows = transport_risk(layer_inputs(captures, tau), top_k, mode, solver, lambdas)
    visual = A.atarget_visual(F.col("support"), F.col("positions"), F.col("target_dist"), F.col("target_embedding"), F.col("visual_start"), F.col("visual_end"), visual_k)
    rows = rows.withColumns({
        "prompt_last_cosine": A.cosine(F.col("state"), F.col("prompt_last")), "prompt_mean_cosine": A.cosine(F.col("state"), F.col("prompt_mean")),
        "prompt_confidence": A.mean(A.top_values(F.col("prompt_probabilities"), 3)), "visual_cosine": visual, "support_size": F.size("support"),
    })
    return rows.withColumn("context_confidence", F.col("prompt_confidence") * F.col("visual_cosine"))


def span_features(layers: DataFrame, key: str, baseline_layers: int = 10, start_layer: int = 15, alpha: float = 2.0) -> DataFrame:
    """By span: the per-layer curves in layer order, the excess score and the feature vector of four blocks: risk,
    cosine with the prompt's last state, with its mean, context confidence."""
    blocks = ("risk", "prompt_last_cosine", "prompt_mean_cosine", "context_confidence")
    packed = layers.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("layer", *blocks, "visual_cosine"))).alias("s"))
    curves = packed.select(key, *[F.col(f"s.{n}").alias(n) for n in (*blocks, "visual_cosine")])
    vector = A.feature_vector(*[F.col(n) for n in blocks])
    return curves.select("*", A.baseline_excess(F.col("risk"), baseline_layers, start_layer, alpha).alias("score"), vector.alias("feature_vector"))


def components(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Connected components of a grid by label propagation; 0 outside, else the smallest flat index + 1."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    steps = [(0, 1), (1, 0)] + [(1, 1), (1, -1)] * (connectivity == 8)
    while True:
        new = np.where(label > 0, label, h * w + 1)
        for dy, dx in [*steps, *[(-a, -b) for a, b in steps]]:
            moved = np.full((h + 2, w + 2), h * w + 1)
            moved[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx] = np.where(label > 0, label, h * w + 1)
            new = np.minimum(new, moved[1:-1, 1:-1])
        new = np.where(mask, new, 0)
        if (new == label).all():
            return label
        label = new


def dispersion(attention: np.ndarray, pct: float = 0.1, connectivity: int = 8, min_area: int = 3) -> float:
    """(1 - mass in connected foreground blobs) x entropy of the background over log of the number of patches."""
    a = np.asarray(attention, float)
    n = len(a)
    a = a - a.min()
    if a.sum() <= 0:
        return 1.0
    p = a / a.sum()
    keep = max(1, round(n * pct))
    fore = np.zeros(n, bool)
    fore[np.argsort(-p, kind="stable")[:keep]] = True
    back = p[~fore]
    entropy = 0.0
    if len(back) >= 2 and back.sum() > 0:
        q = np.maximum(back / back.sum(), 1e-12)
        entropy = float(-(q * np.log(q)).sum() / np.log(n))
    h = max(d for d in range(1, int(n**0.5) + 1) if n % d == 0)
    label = components(fore.reshape(h, n // h), connectivity).ravel()
    ids, area = np.unique(label[label > 0], return_counts=True)
    mass = p[np.isin(label, ids[area >= min_area])].sum()
    return float((1 - mass) * entropy)


def ads_layer(attention: Column, pct: float = 0.1, connectivity: int = 8, min_area: int = 3) -> Column:
    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([dispersion(a, pct, connectivity, min_area) for a in batch])

    return run(attention)


def dispersion_scores(rows: DataFrame, key: str, pct: float = 0.1, connectivity: int = 8, min_area: int = 3, k_heads: int = 0, per_head_min: bool = False) -> DataFrame:
    """(key, per_layer, score) from attention rows (key, layer, head, attention): the dispersion of each layer's map,
    and its mean over the middle layers (NaN where there are none). ``per_head_min`` takes the strongest head alone."""
    maps = top_heads(rows, [key, "layer"], 1 if per_head_min else k_heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [dispersion(a, pct, connectivity, min_area) for a in _vectors(b.column("attention"))]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("layer"), pa.array(got, pa.float64())], names=[key, "layer", "ads"])

    schema = T.StructType([maps.schema[key], maps.schema["layer"], T.StructField("ads", T.DoubleType())])
    each = maps.select(key, "layer", "attention").mapInArrow(run, schema)
    packed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("layer", "ads"))).alias("s"))
    return packed.select(key, F.col("s.ads").alias("per_layer")).select("*", A.mean(A.middle(F.col("per_layer"))).alias("score"))


def top_heads(rows: DataFrame, keys: list[str], k: int = 0) -> DataFrame:
    """Mean attention map over the heads of a layer, or over the k heads with most mass (ties by head)."""
    mass = rows.withColumn("mass", A.total(A.doubles(F.col("attention"))))
    packed = mass.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("mass")).alias("m"), "head", "attention"))).alias("h"))
    heads = F.slice("h", 1, k) if k > 0 else F.col("h")
    one = F.transform(F.get(heads, F.lit(0))["attention"], lambda x, i: A.mean(F.transform(heads, lambda s: F.get(s["attention"], i).cast("double"))))
    return packed.select(*keys, one.alias("attention"))


#: Bytes of an output matrix that are broadcast at most; a larger one comes as a table.
BROADCAST_BYTES = 64 << 20


def target_probabilities(states: DataFrame, weights: np.ndarray | DataFrame, batch: int = 64) -> DataFrame:
    """(key, probability of ``target``) from hidden states and an output matrix (vocabulary x width).

    A table (token, w) is used in shards; an array is broadcast, if it is small enough. Ids out of range get 0.
    """
    if isinstance(weights, DataFrame):
        return sharded_probabilities(states, weights)
    weights = np.asarray(weights, float)
    if weights.nbytes > BROADCAST_BYTES:
        raise ValueError(f"a matrix of {weights.nbytes >> 20} MB is too large to broadcast; give it as a table (token, w)")
    shared = states.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                logits = np.stack(part["state"]).astype(float) @ w.T
                top = logits.max(1, keepdims=True)
                lse = (top + np.log(np.exp(logits - top).sum(1, keepdims=True)))[:, 0]
                t = part["target"].to_numpy()
                ok = (t >= 0) & (t < len(w))
                p = np.where(ok, np.exp(np.minimum(0.0, logits[np.arange(len(part)), np.where(ok, t, 0)] - lse)), 0.0)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "probability": p})

    return states.select("key", "state", "target").mapInPandas(run, "key long, probability double")


def sharded_probabilities(states: DataFrame, weights: DataFrame, shard: int = 4096, block: int = 1024) -> DataFrame:
    """(key, probability) as above, with the matrix as a table (token long, w array) in shards of ``shard`` tokens.

    A shard meets a block of states as two matrices in one task, which gives each state the largest logit, the sum of
    exp(logit - largest) and the target's logit, if it is in the shard; an aggregate merges these by state. No task or
    driver holds the matrix. States without any token get 0; ``key`` tells states apart.
    """
    blocks = max(-(-states.count() // block), 1)
    of = F.floor(F.col("token") / shard).cast("long")
    known = [r[0] for r in weights.select(of).distinct().collect()]  # vocabulary / shard numbers
    # cogroups are dealt by the keys' hashes: both sides' keys have the same types
    left = states.select("key", F.col("state").cast("array<double>").alias("state"), F.col("target").cast("long").alias("target"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.array(*[F.lit(k) for k in sorted(known)]).cast("array<bigint>")).alias("shard"))
    right = weights.select(F.col("token").cast("long").alias("token"), F.col("w").cast("array<double>").alias("w"), of.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("met"))
    kind = states.schema["key"].dataType.simpleString()

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        x, w = (np.array(t.column(c).to_pylist(), float) for t, c in ((a, "state"), (b, "w")))
        if not len(x) or not len(w):
            return pa.table({"key": a.column("key").slice(0, 0), "top": pa.array([], pa.float64()), "rest": pa.array([], pa.float64()), "logit": pa.array([], pa.float64())})
        logits = x @ w.T
        top = logits.max(1)
        place = {t: i for i, t in enumerate(b.column("token").to_pylist())}
        at = [place.get(t) for t in a.column("target").to_pylist()]
        return pa.table({"key": a.column("key"), "top": top, "rest": np.exp(logits - top[:, None]).sum(1), "logit": pa.array([None if j is None else float(logits[i, j]) for i, j in enumerate(at)], pa.float64())})

    parts = left.groupBy("block", "shard").cogroup(right.groupBy("met", "own")).applyInArrow(meet, f"key {kind}, top double, rest double, logit double")
    merged = parts.groupBy("key").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "rest")).alias("parts"), F.max("logit").alias("logit"))
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["rest"] * F.exp(p["top"] - F.col("top")))
    found = merged.select("key", F.when(F.col("logit").isNotNull(), F.exp(F.least(F.lit(0.0), F.col("logit") - F.col("top") - F.log(total)))).alias("p"))
    return states.select("key").join(found, "key", "left").select("key", F.coalesce("p", F.lit(0.0)).alias("probability"))
