"""Language ID by rank-order profiles: out-of-place distance between a text's and each language's n-grams.

Texts are reduced to lower-case letters with one space for anything between; n-grams of one to three symbols
without an inner space are ranked by count. A language's profile is its most frequent n-grams over a bounded
sample of labelled texts; a text's most frequent n-grams are compared with every profile.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, field, fold, per_document

#: Labelled texts for the profiles, at most; n-grams of a profile, and of a text.
SAMPLE, PROFILE, RANKS = 8000, 400, 300


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-case letters, each run of others as one 0, a 0 at both ends; empty without letters."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letter_table()[cp], cp, 0)
    if not c.any():
        return np.empty(0, np.uint32)
    c = np.concatenate(([0], c, [0]))
    return c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))].astype(np.uint32)


def grams(c: np.ndarray, base: int) -> np.ndarray:
    """Keys of the n-grams of symbols c (0: space): one number in base ``base`` with as many digits as symbols."""
    c = c.astype(np.int64 if base**3 > 2**31 - 1 else np.int32)
    one = c[c > 0] * (base * base)
    pair = c[:-1] * (base * base) + (c[1:] + 1) * base
    three = c[:-2] * (base * base) + (c[1:-1] + 1) * base + c[2:] + 1
    return np.concatenate((one, pair, three[c[1:-1] > 0]))


def ranked(keys: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent keys, ties by the smaller key."""
    s = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    n = np.diff(np.append(at, len(s)))
    order = np.argsort(-n, kind="stable")[:most]
    return s[at[order]]


@dataclass
class Profiles:
    langs: list[str]
    alphabet: np.ndarray  # code points, sorted; symbol i + 2 stands for the i-th, 1 for any other letter
    keys: np.ndarray  # sorted n-gram keys of all profiles
    rank: np.ndarray  # languages x keys: rank, or ``most`` where the profile lacks the key
    most: int

    def symbols(self, c: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, c), len(self.alphabet) - 1)
        return np.where(c == 0, 0, np.where(self.alphabet[at] == c, at + 2, 1))

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language and 1 - distance / largest distance; ties go to the first by code point."""
        c = letters(text)
        if not len(c) or not self.langs:
            return "und", 0.0
        mine = ranked(grams(self.symbols(c), len(self.alphabet) + 3), RANKS)
        at = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
        there = np.where(self.keys[at] == mine, self.rank[:, at], self.most)
        far = np.where(there < self.most, np.abs(there - np.arange(len(mine))), self.most).sum(1)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.most * len(mine)))


def fit(docs: DataFrame, folds: int = 4, out: int = 2, sample: int = SAMPLE, most: int = PROFILE) -> Profiles:
    """Profiles of the texts of at most ``sample`` ids with a lang outside the fold ``out``, counted on Spark.

    Rows whose lang is null are left out even where another row of their id has one; of n-grams that are equally
    frequent the smaller code points come first.
    """
    learn = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != out)).select("doc_id", "text", F.col("lang").alias("__lang"))
    rows = learn.join(F.broadcast(bounded_sample(learn.select("doc_id").distinct(), "doc_id", sample)), "doc_id")
    big = 0x110003

    def kernel(texts: list[str]) -> dict:
        out = []
        for t in texts:
            c = letters(t)
            k, n = np.unique(grams(c, big), return_counts=True) if len(c) else (np.empty(0, np.int64), np.empty(0, np.int64))
            out.append([{"k": a, "n": b} for a, b in zip(k.tolist(), n.tolist(), strict=True)])
        return {"g": out}

    pair = T.ArrayType(T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())]))
    counts = per_document(rows, kernel, [field("g", pair)], keep=("__lang",)).select("__lang", F.inline("g")).groupBy("__lang", "k").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy(F.desc("n"), "k")) - 1
    top = counts.select("__lang", "k", rank.alias("r")).where(F.col("r") < most).orderBy("__lang", "r").collect()
    langs = sorted({r["__lang"] for r in top}, key=lambda x: x.encode())
    # keys of code points become keys of the alphabet's symbols
    split = [(r.k // (big * big), r.k // big % big - 1, r.k % big - 1) for r in top]
    alphabet = np.array(sorted({x for s in split for x in s if x > 0}) or [97], np.uint32)
    base, at = len(alphabet) + 3, {int(c): i + 2 for i, c in enumerate(alphabet)} | {0: 0, -1: -1}
    key = [at[a] * base * base + (at[b] + 1) * base + at[c] + 1 for a, b, c in split]
    keys = np.array(sorted(set(key)), np.int64)
    ranks = np.full((len(langs), len(keys)), most, np.int64)
    for r, k in zip(top, key, strict=True):
        ranks[langs.index(r["__lang"]), np.searchsorted(keys, k)] = r.r
    return Profiles(langs, alphabet, keys, ranks, most)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) for every row: ``und`` with score 0 for null texts and texts without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def kernel(texts: list[str]) -> dict:
        got = [shared.value.predict(t) for t in texts]
        return {"lang_pred": [x for x, _ in got], "score": [s for _, s in got]}

    return per_document(docs, kernel, [field("lang_pred", T.StringType()), field("score", T.DoubleType())])


def identify(docs: DataFrame, folds: int = 4, out: int = 2, sample: int = SAMPLE) -> DataFrame:
    """Fit profiles on the labelled rows outside the held-out fold, then predict every row of ``docs``.

    Columns as of ``predict``. Repeated rows repeat, and count as often when they are learned from; very long texts
    are read whole; an empty table gives an empty result, and without any lang all predictions are ``und``; other
    columns don't take part, whatever their names.
    """
    return predict(docs, fit(docs, folds, out, sample))
