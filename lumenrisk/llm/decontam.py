"""Benchmark decontamination by SimHash windows of each item's size.

The documents' word shingles are first matched with the items' shingles: a window without any can't be similar,
so nothing is lost by opening windows only there. In such places every window of an item's size gets a SimHash
(running sums over the shingles' bits). The items' fingerprints stand in four tables a size, by 16 bits each; fingerprints
within the radius differ in at most a quarter of it in some block, so looking up all values that near to a window's
blocks returns every item within the radius. An exact weighted-shingle similarity decides. A document shorter than an
item is one window, and the similarity alone decides.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_PATTERN, field, lower_ascii, per_document, staged

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 18
#: Characters of benchmark items that one index holds, about; larger benchmarks are searched in blocks of items.
INDEX_CHARS = 4_000_000
_BITMAP = 20
#: Blocks of a fingerprint, their bits, and windows that are looked up at once.
BLOCKS, BLOCK_BITS, WINDOWS = 4, 16, 256


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(x: np.ndarray, k: int) -> np.ndarray:
    n = len(x) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = s * np.uint64(0x100000001B3) + x[j : j + n]
    return mix64(s)


def fingerprints(h: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every run of ``width`` shingle hashes."""
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
    run = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    return np.packbits(2 * (run[width:] - run[:-width]) > width, axis=1, bitorder="little")


def words_of(text: str) -> list[bytes]:
    """Lower-case (A-Z) words."""
    return text.encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Index:
    """Items of one block as they are broadcast: texts, and of their shingles those that several items have."""

    ids: list
    texts: list[str]
    shared: dict[str, int]  # shingle, in how many items of the whole benchmark
    items: int  # items of the whole benchmark
    k: int = SHINGLE


class Blocks:
    """The items of one size in four tables, by 16 bits of their fingerprints each.

    In some table a fingerprint within the radius differs in at most a quarter of it. A look-up visits either all values
    that near to a window's, or all values that the items have, whichever are fewer.
    """

    def __init__(self, items: np.ndarray, prints: np.ndarray, radius: int) -> None:
        self.items, self.prints, self.radius = items, prints[items], radius
        masks = np.arange(1 << BLOCK_BITS, dtype=np.int64)
        self.masks = masks[np.bitwise_count(masks) <= radius // BLOCKS]
        self.few = len(items) < len(self.masks)
        self.values = self._blocks(self.prints)
        if not self.few:  # the items in the order of a block's value, and where each value begins
            self.order = np.argsort(self.values, axis=1, kind="stable")
            self.start = np.stack([np.searchsorted(v[o], np.arange((1 << BLOCK_BITS) + 1)) for v, o in zip(self.values, self.order, strict=True)]).astype(np.int32)

    @staticmethod
    def _blocks(prints: np.ndarray) -> np.ndarray:
        return np.stack([(prints >> np.uint64(BLOCK_BITS * b)).astype(np.int64) & ((1 << BLOCK_BITS) - 1) for b in range(BLOCKS)])

    def _pairs(self, b: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in ``items``) whose values of block ``b`` are near."""
        if self.few:
            return np.nonzero(np.bitwise_count(value[:, None] ^ self.values[b]) <= self.radius // BLOCKS)
        look = value[:, None] ^ self.masks
        n = self.start[b][look + 1] - self.start[b][look]
        w, m = np.nonzero(n)
        n = n[w, m].astype(np.int64)
        place = np.repeat(self.start[b][look[w, m]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(w, n), self.order[b][place]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``prints``, item, differing bits) of all pairs within the radius."""
        found = []
        for at in range(0, len(prints), WINDOWS):
            part = prints[at : at + WINDOWS]
            pairs = [w * len(self.items) + i for w, i in (self._pairs(b, v) for b, v in enumerate(self._blocks(part)))]
            w, i = np.divmod(np.unique(np.concatenate(pairs)), len(self.items))
            d = np.bitwise_count(part[w] ^ self.prints[i]).astype(np.int64)
            ok = d <= self.radius
            found.append(np.stack([w[ok] + at, self.items[i[ok]], d[ok]]))
        w, i, d = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        return w, i, d


class Search:
    """Finds an index's items in documents; its tables are made in the worker.

    A shingle weighs log(1 + items / items with it), a shingle that the item lacks as much as one of a single item;
    so an item's similarity to a text is the same whatever block it is in.
    """

    def __init__(self, index: Index, similarity: float, radius: int) -> None:
        self.ids, self.radius, self.k = index.ids, radius, index.k
        self.least = similarity - 1e-9  # sums of weights are rounded; a similarity of just that much counts
        self.rare = math.log1p(index.items)
        hashed = [word_hashes(words_of(t)) for t in index.texts]
        self.size = np.array([len(x) for x in hashed])
        self.step = np.minimum(self.k, self.size)
        each = [shingle_hashes(x, int(s)) for x, s in zip(hashed, self.step, strict=True)]
        shared = {int(shingle_hashes(x, len(x))[0]): math.log1p(index.items / n) for s, n in index.shared.items() if len(x := word_hashes(s.encode("utf-8", "surrogatepass").split()))}
        self.own = [np.unique(h, return_counts=True) for h in each]
        self.weight = [np.array([shared.get(int(v), self.rare) for v in h]) for h, _ in self.own]
        self.mass = [float(w @ n) for w, (_, n) in zip(self.weight, self.own, strict=True)]
        self.prints = np.array([fingerprints(h, len(h)).view(np.uint64)[0, 0] for h in each], np.uint64)
        self.known, self.maps = {}, {}
        for s in set(self.step.tolist()):
            items = np.flatnonzero(self.step == s)
            h, item = np.concatenate([self.own[i][0] for i in items]), np.repeat(items, [len(self.own[i][0]) for i in items])
            order = np.argsort(h, kind="stable")
            self.known[s] = h[order], item[order]
            self.maps[s] = np.zeros(1 << _BITMAP, bool)
            self.maps[s][h >> np.uint64(64 - _BITMAP)] = True
        self.tables = {int(n): Blocks(np.flatnonzero(self.size == n), self.prints, radius) for n in set(self.size.tolist())}

    def near(self, prints: np.ndarray, size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``prints``, item, differing bits) of all pairs within the radius, with items of one size or of all."""
        w, i, d = (np.concatenate(c) for c in zip(*[t.near(prints) for n, t in self.tables.items() if size in (None, n)], strict=True))
        return w, i, d

    def similarity(self, item: int, h: np.ndarray) -> float:
        """Weighted Jaccard of the item's shingles and ``h``, with repeats; shingles of few items weigh more."""
        (own, n), weight = self.own[item], self.weight[item]
        b, m = np.unique(h, return_counts=True)
        at = np.minimum(np.searchsorted(own, b), len(own) - 1)
        hit = own[at] == b
        both = float(weight[at[hit]] @ np.minimum(n[at[hit]], m[hit]))
        other = float(weight[at[hit]] @ m[hit]) + self.rare * float(m[~hit].sum())
        return both / (self.mass[item] + other - both)

    def places(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """By item, the words at which one of its shingles begins."""
        found: dict[int, np.ndarray] = {}
        for s, (known, item) in self.known.items():
            h = shingle_hashes(x, s)
            at = np.flatnonzero(self.maps[s][h >> np.uint64(64 - _BITMAP)])
            a, b = np.searchsorted(known, h[at]), np.searchsorted(known, h[at], "right")
            at, a, n = at[b > a], a[b > a], (b - a)[b > a]
            if not len(at):
                continue
            entry = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            where, which = np.repeat(at, n), item[entry]
            order = np.argsort(which, kind="stable")
            which, where = which[order], where[order]
            cut = np.flatnonzero(np.diff(which)) + 1
            for w, p in zip(np.split(which, cut), np.split(where, cut), strict=True):
                found[int(w[0])] = np.unique(p)
        return found

    def matches(self, text: str) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, Hamming distance, similarity) of the best window for each item found."""
        x = word_hashes(words_of(text))
        places = self.places(x)
        best: dict[int, tuple] = {}
        by_size: dict[int, list[int]] = {}
        for item in places:
            by_size.setdefault(int(self.size[item]), []).append(item)
        for size, items in by_size.items():
            h = shingle_hashes(x, min(self.k, size))
            if size > len(x):
                own = fingerprints(h, len(h)).view(np.uint64)[0, 0]
                for item in items:
                    s = self.similarity(item, h)
                    if s >= self.least:
                        best[item] = (-s, 0), len(x), int(np.bitwise_count(own ^ self.prints[item]))
                continue
            width = size - min(self.k, size) + 1
            at = np.unique(np.concatenate([places[i] for i in items]))
            # windows that hold one of these shingles, as runs of window starts
            runs = _runs(np.maximum(at - width + 1, 0), np.minimum(at, len(x) - size))
            for starts, prints in self._windows(h, runs, width):
                w, i, d = self.near(prints, size)
                for start, item, bits in zip(starts[w].tolist(), i.tolist(), d.tolist(), strict=True):
                    s = self.similarity(item, h[start : start + width])
                    if s >= self.least and (item not in best or (-s, start) < best[item][0]):
                        best[item] = (-s, start), size, bits
        return sorted((i, k[1], n, bits, -k[0]) for i, (k, n, bits) in best.items())

    @staticmethod
    def _windows(h: np.ndarray, runs: list[tuple[int, int]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Window starts and their fingerprints, at most 64 x ``WINDOWS`` at once."""
        many = 64 * WINDOWS
        for a, b in runs:
            for lo in range(a, b + 1, many):
                hi = min(lo + many, b + 1)
                yield np.arange(lo, hi), fingerprints(h[lo : hi + width - 1], width).view(np.uint64)[:, 0]


def _runs(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if b < a:
            continue
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _shingles(items: DataFrame, k: int) -> DataFrame:
    """(item_id, text, shingle): the distinct shingles of each item; an item of fewer words is one."""
    w = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD_PATTERN), F.lit(0))
    n = F.greatest(F.size("w") - k + 1, F.lit(1))
    every = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " "))
    return items.select("*", w.alias("w")).where(F.size("w") > 0).select("item_id", "text", F.explode(F.array_distinct(every)).alias("shingle"))


def indexes(benchmark: DataFrame, k: int, index_chars: int) -> Iterator[Index]:
    """One index after the other; each holds about ``index_chars`` characters of items, whatever the benchmark's size.

    How many items have a shingle is counted over the whole benchmark on Spark; an index gets the counts of its own.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).dropna().where(F.col("text").rlike(WORD_PATTERN)).distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.chars // index_chars))
    dealt = items.withColumn("__block", F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(blocks)))
    every = _shingles(dealt.select("item_id", "text"), k)
    shared = staged(every.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "benchmark-shingles")
    for block in range(blocks):
        own = dealt.where(F.col("__block") == block).select("item_id", "text")
        rows = sorted(own.collect(), key=lambda r: (str(r.item_id), r.text))
        counts = shared.join(_shingles(own, k).select("shingle"), "shingle", "left_semi").collect()  # no more than the block's own shingles
        if rows:
            yield Index([r.item_id for r in rows], [r.text for r in rows], {r.shingle: r.n for r in counts}, size.n, k)


#: The search that a worker made last, by the name of its broadcast; tasks of one worker share it.
_ready: dict[str, Search] = {}


def _searched(docs: DataFrame, index: Index, similarity: float, radius: int, keep: list, id_type: T.DataType) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(index), uuid.uuid4().hex

    def kernel(texts: list[str]) -> dict:
        if name not in _ready:
            _ready.clear()
            _ready[name] = Search(shared.value, similarity, radius)
        s = _ready[name]
        return {"__found": [[{"item_id": s.ids[i], "start_word": a, "n_words": n, "hamming": d, "similarity": sim} for i, a, n, d, sim in s.matches(t)] for t in texts]}

    return per_document(docs, kernel, [field("__found", _matches(id_type))], keep=keep)


def _matches(id_type: T.DataType) -> T.ArrayType:
    kinds = {"item_id": id_type, "start_word": T.LongType(), "n_words": T.LongType(), "hamming": T.LongType(), "similarity": T.DoubleType()}
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in kinds.items()]))


def _checked(radius: int) -> None:
    if not 0 <= radius < BLOCKS * 5:
        raise ValueError("the tables guarantee radii up to 19")


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, index_chars: int = INDEX_CHARS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): the best window of each item in each document.

    radius is at most 19; a document shorter than the item is compared whole, without regard to the radius, and
    n_words is its length. Items shorter than a shingle are one shingle. item_id can have any type. Null and empty
    texts and items match nothing, as do items without id; an empty table gives an empty result; of ties the first
    window counts; repeated documents repeat their rows, repeated items count once; very long texts are read whole;
    other columns don't take part, whatever their names.
    """
    _checked(radius)
    id_type, found = benchmark.schema["item_id"].dataType, []
    for index in indexes(benchmark, shingle, index_chars):
        if found:  # of several blocks, each one's matches are kept and its index goes before the next one comes
            found[-1] = staged(found[-1], "leaks")
        found.append(_searched(docs, index, similarity, radius, ["doc_id"], id_type).select("doc_id", F.inline("__found")))
    out = docs.where("false").select("doc_id", F.inline(F.lit(None).cast(_matches(id_type))))
    for part in found:
        out = out.unionByName(part) if len(found) > 1 else part
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, index_chars: int = INDEX_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns, whatever their names.

    Null, empty, repeated and very long texts and empty tables are treated as in ``leaks``: what holds no item stays.
    """
    _checked(radius)
    columns, id_type = docs.columns, benchmark.schema["item_id"].dataType
    for index in indexes(benchmark, shingle, index_chars):
        docs = _searched(docs, index, similarity, radius, columns, id_type).where(F.size("__found") == 0).select(*columns)
    return docs
