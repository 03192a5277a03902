"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + w.x + 1/2 sum_f [(V_f.x)^2 - (V_f^2).(x^2)]): all pairwise interactions through rank-k
factors, in time linear in x by the sum-of-squares identity. It is fitted on a bounded sample of labelled rows
and applied to every document where Spark holds it.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import collected, field, labelled, per_document
from .quality_rules import FEATURES as STATS
from .quality_rules import statistics

WORDS, EXTRA = 2048, 2
#: Labelled rows that the machine is fitted on, at most.
SAMPLE, RANK, EPOCHS, BATCH = 8000, 8, 30, 256


def features(text: str, n_chars: float | None) -> np.ndarray:
    """Hashed words (log counts, unit length), structure statistics, and the metadata length against the true one."""
    h = np.fromiter(map(zlib.crc32, text.encode("utf-8", "surrogatepass").split()), np.int64, -1) & (WORDS - 1)
    x = np.log1p(np.bincount(h, minlength=WORDS))
    x /= max(float(np.linalg.norm(x)), 1e-9)
    _, s = statistics(text)
    meta = [math.log1p(max(n_chars or 0, 0)), math.log1p(len(text))]
    return np.concatenate((x, s, meta)).astype(np.float32)


@dataclass
class Machine:
    mean: np.ndarray
    scale: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def standard(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, WORDS:] = np.clip((x[:, WORDS:] - self.mean) / self.scale, -4, 4)
        return x

    def margin(self, x: np.ndarray) -> np.ndarray:
        """x: standardised rows. Each is summed by itself, over its own non-zero features in float64, so that no other
        row of a batch has a part in it."""
        out = np.zeros(len(x))
        for i, row in enumerate(x):
            at = np.flatnonzero(row)
            own, v = row[at].astype(float), self.v[at].astype(float)
            xv = own[:, None] * v
            out[i] = self.w0 + (own * self.w[at]).sum() + 0.5 * ((xv.sum(0) ** 2).sum() - (xv**2).sum())
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """math.exp, as numpy's vector loop may round the last rows of a batch another way."""
        return np.array([1 / (1 + math.exp(-min(max(z, -30.0), 30.0))) for z in self.margin(self.standard(x))])


def fit_machine(x: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = 3, l2: float = 1e-4) -> Machine:
    """Adam on the logistic loss. Without rows of both labels the score is the labels' mean."""
    d = WORDS + STATS + EXTRA
    rng = np.random.default_rng(seed)
    tail = x[:, WORDS:] if len(x) else np.zeros((1, STATS + EXTRA), np.float32)
    rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    m = Machine(tail.mean(0), np.maximum(tail.std(0), 1e-3), math.log(rate / (1 - rate)), np.zeros(d, np.float32), rng.normal(0, 0.02, (d, rank)).astype(np.float32))
    if len(set(y.tolist())) < 2:
        m.v[:] = 0
        return m
    x = m.standard(x)
    state = [np.zeros_like(p) for p in (m.w, m.w, m.v, m.v)]
    step, w0m, w0v = 0, 0.0, 0.0
    for epoch in range(epochs):
        rate = 0.02 * 0.9**epoch
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            b, t = x[order[at : at + BATCH]], y[order[at : at + BATCH]]
            xv = b @ m.v
            z = m.w0 + b @ m.w + 0.5 * ((xv**2).sum(1) - (b**2 @ m.v**2).sum(1))
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) / len(b)).astype(np.float32)
            gw = b.T @ g + l2 * m.w
            gv = b.T @ (g[:, None] * xv) - m.v * ((b**2).T @ g)[:, None] + l2 * m.v
            step += 1
            for p, gr, i in ((m.w, gw, 0), (m.v, gv, 2)):
                state[i] = 0.9 * state[i] + 0.1 * gr
                state[i + 1] = 0.999 * state[i + 1] + 0.001 * gr * gr
                p -= rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.999**step)) + 1e-8)
            g0 = float(g.sum())
            w0m, w0v = 0.9 * w0m + 0.1 * g0, 0.999 * w0v + 0.001 * g0 * g0
            m.w0 -= rate * (w0m / (1 - 0.9**step)) / (math.sqrt(w0v / (1 - 0.999**step)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, out: int = 0, sample: int = SAMPLE) -> Machine:
    """The machine from at most ``sample`` labelled rows outside the fold ``out``; features are made on the executors.

    Only the non-zero features travel: places and values, about a tenth of the whole rows.
    """
    rows = labelled(docs, labels, "quality", sample, folds, out, more=tuple(c for c in ("n_chars",) if c in docs.columns))

    def pack(texts: list[str], lengths: list[float]) -> dict:
        each = [features(t, n) for t, n in zip(texts, lengths, strict=True)]
        at = [np.flatnonzero(x) for x in each]
        return {"at": [i.astype(np.uint16).tobytes() for i in at], "x": [x[i].tobytes() for x, i in zip(each, at, strict=True)]}

    got = collected(per_document(rows, pack, [field("at", T.BinaryType()), field("x", T.BinaryType())], keep=("doc_id", "label"), extra=[_metadata(rows)]), sample)
    x = np.zeros((len(got), WORDS + STATS + EXTRA), np.float32)
    for row, r in zip(x, got, strict=True):
        row[np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.x, np.float32)
    return fit_machine(x, np.array([r.label for r in got], np.float32))


def _metadata(docs: DataFrame) -> Column:
    """The length that the metadata state; that of the text where they don't."""
    own = F.coalesce(F.length("text"), F.lit(0)).cast("double")
    return F.coalesce(F.col("n_chars").cast("double"), own) if "n_chars" in docs.columns else own


def score(docs: DataFrame, machine: Machine, keep: tuple = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` and the score (0 to 1) as ``name`` for every row; null texts count as empty, repeated rows repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def kernel(texts: list[str], lengths: list[float]) -> dict:
        return {name: shared.value.score(np.stack([features(t, n) for t, n in zip(texts, lengths, strict=True)]))}

    return per_document(docs, kernel, [field(name, T.DoubleType())], keep=keep, extra=[_metadata(docs)])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, out: int = 0, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``; predicted is 1 at ``threshold`` or more.

    Null and empty texts have the features of no words and get a score like any other; repeated rows repeat, and as
    labelled rows count once; very long texts are read whole; an empty table gives an empty result; other columns
    don't take part, whatever their names (n_chars is the stated length, that of the text where it is missing or null).
    Reruns, layouts and numbers of partitions give the same scores to the last bit.
    """
    found = score(docs, fit(docs, labels, folds, out, sample))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns, whatever their names.

    Rows with null or empty texts, repeats and an empty table are treated as in ``classify``.
    """
    columns = docs.columns
    return score(docs, fit(docs, labels, sample=sample), tuple(columns), "__quality").where(F.col("__quality") >= threshold).select(*columns)
