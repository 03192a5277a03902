"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Each voter is a named source of its own (``VOTERS``): a fixed list of insults, lists mined from labelled rows in
three grades of strength, counts of hits, insults addressed to a reader, patterns of shouting; it votes toxic, clean
or not at all. The label model gives every voter's accuracy under both classes by expectation maximisation, and down-weights voters
that still agree within a class, by their estimated correlations. The classifier is trained on its posteriors.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import collected, field, labelled, per_document
from .decontam import mix64

#: Abusive words that any list would have.
LEXICON = frozenset("clown disgusting dumb garbage idiot loser moron pathetic scum stupid trash ugly vermin worthless".split())
#: Labelled rows, mined terms, grades that they are split into by strength, a term's lift.
SAMPLE, TERMS, GRADES, LIFT = 16000, 600, 3, 40.0
#: What each vote stands for, in the order of ``votes_of``.
VOTERS = ("insult", "two insults", "strong term", "medium term", "weak term", "two terms", "addressed insult", "few shouts", "exclamations", "no term", "no shout")
#: Toxic documents that a term needs: so many, and a share of all, so that rare words don't enter by chance.
LEAST, LEAST_SHARE = 4, 1 / 160
#: Values of a MinHash signature, values of a band, share of equal values from which a text is a copy of another.
SIGNATURE, BAND, COPY = 64, 4, 0.8
_SEEDS = mix64(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STRIP = ".,;:!?\"'()[]{}*#$%&|<>-"
_SHOUT = re.compile(r"[A-Z]{3,}!+")
_ADDRESSED = re.compile(r"(?i)\b(?:you|your|du|ihr|tu|vous|eres|usted)\W+(?:\w+\W+){0,3}(?:" + "|".join(sorted(LEXICON)) + r")\b")


def terms_of(text: str) -> set[str]:
    """Lower-case words without marks around them."""
    out = {w.strip(_STRIP) for w in set(text.lower().split())}
    out.discard("")
    return out


def signature(terms: set[str]) -> bytes:
    """MinHash of all terms; empty for texts without a long word, which are too short to tell copies."""
    if not any(len(t) > 7 for t in terms):
        return b""
    h = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in terms], np.uint64)
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        least = np.minimum(least, mix64(h[at : at + 1024, None] ^ _SEEDS).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).tobytes()


def copies(signatures: list[bytes]) -> list[int]:
    """Places whose text is a copy or near copy, over the whole text, of one that stands before and stays."""
    buckets: dict[tuple, list[int]] = {}
    known = np.zeros((len(signatures), SIGNATURE), np.uint32)
    out = []
    for i, s in enumerate(signatures):
        if not s:
            continue
        known[i] = np.frombuffer(s, np.uint32)
        keys = [(k, s[4 * k : 4 * (k + BAND)]) for k in range(0, SIGNATURE, BAND)]
        near = sorted({j for k in keys for j in buckets.get(k, ())})
        if near and (known[near] == known[i]).mean(axis=1).max() >= COPY:
            out.append(i)
            continue
        for k in keys:
            buckets.setdefault(k, []).append(i)
    return out


def grades(terms: list[str]) -> list[frozenset[str]]:
    """Mined terms, strongest first, in ``GRADES`` lists of like size."""
    return [frozenset(terms[len(terms) * g // GRADES : len(terms) * (g + 1) // GRADES]) for g in range(GRADES)]


def votes_of(text: str, graded: list[frozenset[str]]) -> list[int]:
    """One vote of each of ``VOTERS``: 1 toxic, -1 clean, 0 none."""
    s = terms_of(text)
    insults, mined = len(s & LEXICON), [len(s & g) for g in graded]
    shouts = len(_SHOUT.findall(text))
    hits = insults + sum(mined)
    told = insults > 0 and _ADDRESSED.search(text) is not None
    toxic = [insults > 0, insults > 1, *[n > 0 for n in mined], sum(mined) > 1, told, 0 < shouts < 5, "!!!" in text]
    return [*map(int, toxic), -int(hits == 0), -int(shouts == 0 and bool(s))]


@dataclass
class LabelModel:
    """log P(vote | class) for votes -1, 0, 1 of each voter, their weights after correlations, and the prior."""

    table: np.ndarray  # voters x 2 classes x 3 votes
    weight: np.ndarray
    correlation: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes + 1
        each = np.stack([self.table[np.arange(v.shape[1]), c, v] for c in (0, 1)], axis=2)
        odds = math.log(self.prior / (1 - self.prior)) + ((each[:, :, 1] - each[:, :, 0]) * self.weight).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> LabelModel:
    """EM from the votes' majority; in each round the correlations within classes set the voters' weights.

    Voters that agree because both know the class have no correlation within it and keep their full weight.
    """
    n, m = votes.shape
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    p = np.where((votes == 1).sum(1) > (votes == -1).sum(1) - (votes == -1).all(0).sum(), 0.98, 0.02)
    model = LabelModel(np.zeros((m, 2, 3)), np.ones(m), np.eye(m), prior)
    for _ in range(rounds if n else 0):
        table, within = np.zeros((m, 2, 3)), np.zeros((m, m))
        for c, w in ((0, 1 - p), (1, p)):
            counts = np.stack([((votes == v) * w[:, None]).sum(0) for v in (-1, 0, 1)], axis=1)
            table[:, c] = np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True))
            left = votes - (votes * w[:, None]).sum(0) / max(w.sum(), 1e-9)
            within += (left * w[:, None]).T @ left / n
        sd = np.sqrt(np.diag(within)) + 0.05
        corr = within / np.outer(sd, sd)
        np.fill_diagonal(corr, 1.0)
        weight = 1 / np.where(np.abs(corr) > 0.2, np.abs(corr), 0).sum(1)
        model = LabelModel(table, weight, corr, prior)
        new = model.posterior(votes)
        if np.abs(new - p).max() < 1e-4:
            break
        p = new
    return model


@dataclass
class Classifier:
    index: dict[str, int]
    fixed: int
    w: np.ndarray
    b: float

    def features(self, text: str) -> np.ndarray:
        """Which terms occur, how many, and how large a share of the words that is."""
        x = np.zeros(len(self.index) + 3, np.float32)
        s = terms_of(text)
        for t in s & self.index.keys():
            x[self.index[t]] = 1
        hits = sum(1 for t in s if t in LEXICON)
        x[-3], x[-2], x[-1] = min(hits, 3), math.log1p(float(x[:-3].sum())), hits > 0
        return x

    def score(self, text: str) -> float:
        """Of one text by itself, as an exactly rounded sum, so that no other row of a batch has a part in it."""
        x = self.features(text)
        at = np.flatnonzero(x)
        z = math.fsum([*(x[at].astype(float) * self.w[at]).tolist(), self.b])
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def fit_linear(x: np.ndarray, p: np.ndarray, rounds: int = 300, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent."""
    d = x.shape[1]
    w, b = np.zeros(d + 1), 0.0
    a = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1).astype(float)
    step = 4 / max(float(np.square(a).sum(1).mean()) * 4, 1e-9)
    y, t = w.copy(), 1.0
    for _ in range(rounds if len(x) else 0):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ y, -30, 30))) - p) / len(a)
        g[:-1] += l2 * y[:-1]
        new = y - step * g
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, w, t = new + (t - 1) / t2 * (new - w), new, t2
    b = float(w[-1])
    return w[:-1], b


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, out: int = 1, sample: int = SAMPLE) -> tuple[Classifier, LabelModel | None]:
    """Terms, label model and classifier from at most ``sample`` labelled rows outside the fold ``out``.

    The labels mine the lexicon and set the prior; what the classifier learns from are the label model's posteriors.
    """
    rows = labelled(docs, labels, "toxic", sample, folds, out)
    ids = rows.schema["doc_id"].dataType

    def signed(texts: list[str]) -> dict:
        return {"key": [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts], "signature": [signature(terms_of(t)) for t in texts]}

    def kernel(texts: list[str]) -> dict:
        return {"terms": [sorted(terms_of(t)) for t in texts], "key": [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]}

    # a text with many copies counts once, else all its words would look toxic; of copies the smallest doc_id stays.
    # At most ``sample`` ids have a signature of 256 bytes, so they are safe to collect
    key = field("key", T.LongType())
    seen = collected(per_document(rows, signed, [key, field("signature", T.BinaryType())], keep=("doc_id", "label")), sample)
    gone = []
    for label in (0, 1):
        own = [r for r in seen if r.label == label]
        gone += [(own[i].doc_id, own[i].key) for i in copies([bytes(r.signature) for r in own])]
    gone = docs.sparkSession.createDataFrame(gone, T.StructType([T.StructField("doc_id", ids), key]))
    sets = per_document(rows, kernel, [field("terms", T.ArrayType(T.StringType())), key], keep=("doc_id", "label"))
    sets = sets.dropDuplicates(["doc_id", "key"]).join(F.broadcast(gone), ["doc_id", "key"], "left_anti")
    # sums by term are made on Spark; only terms of toxic rows come to the driver, and those are few
    counts = sets.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    n = sets.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    p, q = (F.col("toxic") + 0.5) / (n.toxic + 1), (F.col("clean") + 0.5) / (n.n - n.toxic + 1)
    gain = p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))
    best = counts.where((F.col("toxic") >= max(LEAST, n.toxic * LEAST_SHARE)) & (p / q >= LIFT)).orderBy(gain.desc(), "term").limit(TERMS).select("term").collect()
    terms = [r.term for r in best]
    blank = Classifier({t: i for i, t in enumerate(terms)}, len(LEXICON), np.zeros(len(terms) + 3), 0.0)
    graded = grades(terms)

    def shown(texts: list[str]) -> dict:
        return {"x": [blank.features(t).tobytes() for t in texts], "votes": [votes_of(t, graded) for t in texts]}

    got = collected(per_document(rows, shown, [field("x", T.BinaryType()), field("votes", T.ArrayType(T.IntegerType()))], keep=("doc_id", "label")), sample)
    if not got:
        return Classifier(blank.index, blank.fixed, blank.w, -3.0), None
    x = np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(len(got), -1)
    votes = np.array([r.votes for r in got])
    model = label_model(votes, sum(r.label for r in got) / len(got))
    w, b = fit_linear(x, model.posterior(votes))
    return Classifier(blank.index, blank.fixed, w, b), model


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, score) for every row; null and empty texts have no term and get the score of none; repeats repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def kernel(texts: list[str]) -> dict:
        return {"score": [shared.value.score(t) for t in texts]}

    return per_document(docs, kernel, [field("score", T.DoubleType())])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``; predicted is 1 at ``threshold`` or more.

    Null and empty texts have no term and get the score of none; repeated rows repeat, and as labelled rows count
    once; very long texts are read whole; an empty table gives an empty result; other columns don't take part,
    whatever their names. Terms of equal strength are ordered by code point. Reruns, layouts and numbers of
    partitions give the same scores.
    """
    found = score(docs, fit(docs, labels, folds, out, sample)[0])
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
