"""Quality rules: fixed rule statistics, and an isolation forest on them for what no single rule catches.

The forest grows random splits, each tree on a subsample of its own that is drawn from all labelled rows; a row's mean
path length over the trees says how easily it is set apart. The verdict's threshold is read off all labelled rows: the
score that separates their labels best among those that keep nearly all good ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import running
from .common import field, per_document, staged

SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = 11
#: Trees, rows of a tree, good rows that the threshold keeps.
TREES, ROWS, KEEP = 128, 256, 0.995


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    wins = list(zip(*[words[i:] for i in range(window)], strict=False))
    if len(set(wins)) == len(wins):
        return 0
    count, total, until = Counter(wins), 0, 0
    for i, w in enumerate(wins):
        if count[w] > 1:
            total += i + window - max(i, until)
            until = i + window
    return total


def statistics(text: str) -> tuple[tuple[int, ...], np.ndarray]:
    """The rule counts of a text, and the forest's features (shares, so that length alone is one of them)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in text.split("\n") if x.encode("utf-8", "surrogatepass").split()] if "\n" in text else [text] * (n > 0)
    dup = len(lines) - len(set(lines))
    rep = repeated_words(words)
    letters = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    marks = len(raw) - len(raw.translate(None, b"!?"))
    bars = words.count(b"|")
    c, w = max(chars, 1), max(n, 1)
    features = np.array([math.log1p(n), chars / w, symbols / c, dup / max(len(lines), 1), rep / w, letters / c, digits / c, marks / c, bars / w, len(set(words)) / w, math.log1p(len(lines)) / (1 + math.log1p(n))])
    return (n, chars, symbols, dup, rep), features


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Fewer than 10 words, or over a fifth of them in repeated windows."""
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n leaves."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Isolation forest as flat arrays: feature (-1: leaf), split, child (right is left + 1), path length at a leaf."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self._open(min(rows, len(x)))
        for _ in range(trees if len(x) else 0):
            self._grow(x[rng.choice(len(x), self.rows, replace=False)], rng)
        self._close()

    @classmethod
    def of(cls, rows: int, grown: list[tuple[list, list, list, list]]) -> Forest:
        """The forest of trees of ``rows`` rows each, each as its own flat lists."""
        out = cls.__new__(cls)
        out._open(rows)
        for feature, split, child, path in grown:
            at = len(out.feature)
            out.roots.append(at)
            out.feature += feature
            out.split += split
            out.child += [c + at for c in child]
            out.path += path
        out._close()
        return out

    @classmethod
    def tree(cls, x: np.ndarray, seed: int) -> tuple[list, list, list, list]:
        """The flat lists of one tree that is grown on all of ``x``."""
        out = cls.__new__(cls)
        out._open(len(x))
        out._grow(x, np.random.default_rng(seed))
        return out.feature, out.split, out.child, out.path

    def _open(self, rows: int) -> None:
        self.rows, self.deepest = rows, math.ceil(math.log2(max(rows, 2)))
        self.feature, self.split, self.child, self.path, self.roots = [], [], [], [], []

    def _close(self) -> None:
        self.feature, self.split, self.child, self.path = (np.array(a) for a in (self.feature, self.split, self.child, self.path))

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> None:
        self.roots.append(self._node())
        todo = [(self.roots[-1], x, 0)]
        while todo:
            at, part, depth = todo.pop()
            lo, hi = part.min(0), part.max(0)
            open_ = np.flatnonzero(hi > lo)
            if depth >= self.deepest or len(part) < 2 or not len(open_):
                self.path[at] = depth + float(mean_path(len(part)))
                continue
            f = int(rng.choice(open_))
            self.feature[at], self.split[at], self.child[at] = f, float(rng.uniform(lo[f], hi[f])), self._node()
            self._node()
            left = part[:, f] < self.split[at]
            todo += [(self.child[at], part[left], depth + 1), (self.child[at] + 1, part[~left], depth + 1)]

    def _node(self) -> int:
        self.feature.append(-1)
        self.split.append(0.0)
        self.child.append(0)
        self.path.append(0.0)
        return len(self.feature) - 1

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 is anomalous."""
        if not len(self.roots) or not len(x):
            return np.zeros(len(x))
        total, row = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.deepest):
                f = self.feature[at]
                step = self.child[at] + (x[row, np.maximum(f, 0)] >= self.split[at])
                at = np.where(f < 0, at, step)
            total += self.path[at]
        return 2.0 ** -(total / len(self.roots) / max(float(mean_path(self.rows)), 1.0))


def threshold(score: np.ndarray, good: np.ndarray, keep: float = KEEP) -> float:
    """The highest useful cut: of the scores that keep a share ``keep`` of the good rows, the best separating one."""
    if not good.any():
        return 2.0
    floor = np.quantile(score[good], keep)
    cuts = np.unique(np.append(score[score >= floor], floor))
    gain = [(score[~good] > c).mean() - (score[good] > c).mean() if (~good).any() else 0.0 for c in cuts]
    best = cuts[int(np.argmax(gain))] if (~good).any() else cuts[-1]
    return float(best)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, the rule counts, base_failed, x) for every row of ``docs``; x: the forest's features."""

    def kernel(texts: list[str]) -> dict:
        s = [statistics(t) for t in texts]
        counts = np.array([c for c, _ in s], np.int64).reshape(-1, 5)
        return {n: counts[:, i] for i, n in enumerate(COUNTS)} | {"base_failed": base_failed(counts), "x": [f.tolist() for _, f in s]}

    fields = [field(n, T.LongType()) for n in COUNTS] + [field("base_failed", T.BooleanType()), field("x", T.ArrayType(T.DoubleType()))]
    return per_document(docs, kernel, fields)


def labelled_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The different ones of ``rows`` that have a label, with it: repeated labels of an id are averaged and rounded up;
    null ids and labels are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    return rows.distinct().join(known, "doc_id")


def fit(known: DataFrame, trees: int = TREES, size: int = ROWS, seed: int = 1) -> Forest:
    """The forest on all rows of ``known`` (doc_id, x): each tree draws its ``size`` rows from them all, by the least of
    its own hashes of the rows, and grows in a task of its own; only trees reach the driver."""
    total = known.count()
    # some more than size are expected below the limit; nine deviations lie between
    limit = min((size + 9 * math.sqrt(size)) / max(total, 1), 1.0)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().astype(np.uint64)
            for t in range(trees):
                z = h + np.uint64((t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                key = (z >> np.uint64(11)).astype(float) / (1 << 53)
                own = pa.array(np.flatnonzero(key < limit))
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t), pa.int32()), pa.array(key[own]), b.column(1).take(own)], names=["tree", "key", "x"])

    def grow(part: pa.Table) -> pa.Table:
        rows = sorted(zip(part.column("key").to_pylist(), part.column("x").to_pylist(), strict=True))[:size]
        t = part.column("tree")[0].as_py()
        return pa.table({n: pa.array([v], k) for n, v, k in zip(("tree", "feature", "split", "child", "path"), (t, *Forest.tree(np.array([x for _, x in rows]), seed * trees + t)), (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64())), strict=True)})

    drawn = known.select(F.xxhash64(F.col("doc_id").cast("string"), "x").alias("h"), "x").mapInArrow(draw, "tree int, key double, x array<double>")
    grown = drawn.groupBy("tree").applyInArrow(grow, "tree int, feature array<int>, split array<double>, child array<int>, path array<double>").collect()  # ``trees`` rows
    return Forest.of(min(size, total), [(r.feature, r.split, r.child, r.path) for r in sorted(grown, key=lambda r: r.tree)])


def cut(known: DataFrame, keep: float = KEEP) -> float:
    """``threshold`` of all rows of ``known`` (anomaly, label), from running counts over the scores in order."""
    at = known.groupBy("anomaly").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") != 1).alias("poor"))
    at = staged(running(at, "anomaly", ["good", "poor"]), "quality-scores")
    n = at.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("poor"), F.lit(0)).alias("poor")).first()
    if not n.good:
        return 2.0
    rank = (n.good - 1) * keep
    upto = F.col("before_good") + F.col("good")
    ends = at.agg(*[F.min(F.when(upto > r, F.col("anomaly"))).alias(k) for k, r in (("lo", math.floor(rank)), ("hi", math.ceil(rank)))]).first()
    part = rank - math.floor(rank)  # as numpy's quantile rounds
    floor = ends.lo + (ends.hi - ends.lo) * part if part < 0.5 else ends.hi - (ends.hi - ends.lo) * (1 - part)
    if not n.poor:
        return max(floor, at.agg(F.max("anomaly")).first()[0])
    gain = (n.poor - F.col("before_poor") - F.col("poor")) / n.poor - (n.good - F.col("before_good") - F.col("good")) / n.good
    best = at.where(F.col("anomaly") >= floor).agg(
        F.max_by(F.struct("anomaly", gain.alias("gain")), F.struct(gain.alias("gain"), -F.col("anomaly"))).alias("best"),
        F.sum(F.when(F.col("anomaly") > floor, F.col("poor")).otherwise(0)).alias("poor"), F.sum(F.when(F.col("anomaly") > floor, F.col("good")).otherwise(0)).alias("good"),
    ).first()
    return floor if best.best is None or best.poor / n.poor - best.good / n.good >= best.best.gain else best.best.anomaly


def scored(rows: DataFrame, forest: Forest) -> DataFrame:
    """``rows`` with the forest's score, ``anomaly``."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(x))], names=[*b.schema.names, "anomaly"])

    return rows.mapInArrow(score, T.StructType([*rows.schema, field("anomaly", T.DoubleType())]))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on all labelled rows, then judge every row of ``docs``: (doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, anomaly).

    Null, blank, repeated and very long texts are judged like any other (those without words fail the base rule), an
    empty table gives an empty result, other columns of ``docs`` don't take part, whatever their names. A labelled row
    that repeats counts once; labels with null ids or null quality are left out; of equal scores all lie on the same
    side of the threshold. Without labelled rows the forest is empty and keeps all that pass the base rule.
    """
    rows = staged(measured(docs), "quality-statistics")
    forest = fit(labelled_rows(rows.select("doc_id", "base_failed", "x"), labels))
    judged = staged(scored(rows, forest), "quality-anomalies")
    limit = cut(labelled_rows(judged.where("NOT base_failed").select("doc_id", "x", "anomaly"), labels))
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("anomaly") <= limit)).alias("kept"), "anomaly")
