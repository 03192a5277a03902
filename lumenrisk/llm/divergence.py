"""Source divergence audit over a token-start pointer sort.

Within a task, the texts of an Arrow batch are one buffer of bytes; pointers to the starts of its words are sorted by
multikey quicksort on the bytes they point to, and each run of equal words gives the word's document frequency and its
counts by source. Spark adds the runs up over the batches. Nothing is sampled; all arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import staged

#: Documents of its language that hold a kept term; scale of the probabilities; terms that are listed for a source.
LEAST, SCALE, TOP = 30, 1_000_000_000, 50
#: Bytes of text that are sorted at once, or one text if it is longer; pointers that plain sorting takes over from.
SHARD, SMALL = 1 << 23, 1 << 15

_BYTES = np.arange(256)
_IS_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = np.where(_IS_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
#: Term characters: A-Z, a-z and all of UTF-8 beyond ASCII.
_IN_TERM = _IS_UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


def word_pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of each word; no word goes across the end of a document."""
    inside = _IN_TERM[data]
    fresh = np.zeros(len(data) + 1, bool)  # where a document starts
    fresh[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.concatenate((inside[1:], [False]))
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return start, end - start, np.searchsorted(offsets, start, "right") - 1


#: Keeps the first so many of eight bytes.
_MASK = np.array([((1 << 8 * n) - 1) << 8 * (8 - n) for n in range(9)], np.uint64)


#: The last of eight bytes; a word goes on if it isn't 0.
_MORE = np.uint64(255)


def _keys(eights: np.ndarray, start: np.ndarray, length: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes at ``depth`` of each word as one number that sorts like them; bytes beyond the word are 0."""
    return eights[start + depth].astype(np.uint64) & _MASK[np.clip(length - depth, 0, 8)]


def multikey_quicksort(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the pointers, whether a run of equal words starts there).

    Slices are split in three around a pivot's eight bytes; the middle part goes on with the next eight. What falls
    below ``SMALL`` pointers is ordered by the same eight bytes, all such slices at once. Pointers that are equal keep
    their order. No word has a byte 0, so a key that ends in 0 ends the word.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) + 1, ">u8", padded.data, strides=(1,))  # the eight bytes from each place on
    order, first = np.arange(len(start)), np.zeros(len(start), bool)
    slices, depth = np.array([[0, len(start)]] if len(start) else []).reshape(-1, 2).astype(np.int64), 0
    while len(slices):
        todo, small, later = [tuple(s) for s in slices[slices[:, 1] - slices[:, 0] > SMALL].tolist()], [], []
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= SMALL:
                small.append((lo, hi))
                continue
            own = order[lo:hi]
            key = _keys(eights, start[own], length[own], depth)
            pivot = np.sort(key[[0, (hi - lo) // 2, hi - lo - 1]])[1]
            parts = [own[key < pivot], own[key == pivot], own[key > pivot]]
            order[lo:hi] = np.concatenate(parts)
            n, m = lo + len(parts[0]), hi - len(parts[2])
            first[n] = True
            todo += [x for x in ((lo, n), (m, hi)) if x[0] < x[1]]
            if pivot & _MORE:
                later.append((n, m))
        small = np.concatenate((slices[slices[:, 1] - slices[:, 0] <= SMALL], np.array(small, np.int64).reshape(-1, 2)))
        size = small[:, 1] - small[:, 0]
        of = np.repeat(np.arange(len(small)), size)
        at = np.arange(len(of)) + (small[:, 0] - (np.cumsum(size) - size))[of]
        own = order[at]
        key = _keys(eights, start[own], length[own], depth)
        by = np.lexsort((key, of))
        order[at], key = own[by], key[by]
        edge = np.flatnonzero(np.concatenate((np.ones(min(len(at), 1), bool), (of[1:] != of[:-1]) | (key[1:] != key[:-1]))))
        first[at[edge]] = True
        size = np.diff(np.append(edge, len(at)))
        more = (size > 1) & (key[edge] & _MORE > 0)
        slices = np.concatenate((np.stack((at[edge[more]], at[edge[more]] + size[more]), axis=1), np.array(later, np.int64).reshape(-1, 2)))
        depth += 8
    return order, first


def shard_counts(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, groups, counts, documents): of each word in each group of documents, from the runs of sorted pointers."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = _LOWER[np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]] if body is not None else np.zeros(0, np.uint8)
    start, length, doc = word_pointers(data, offsets - offsets[0])
    order, first = multikey_quicksort(data, start, length)
    if not len(order):
        return pa.array([], pa.binary()), *(np.zeros(0, np.int64) for _ in range(3))
    doc = doc[order]
    fresh = first | np.concatenate(([True], doc[1:] != doc[:-1]))  # equal pointers stand in the documents' order
    wide = int(group.max()) + 1
    cell = (np.cumsum(first) - 1) * wide + group[doc]
    runs = int(first.sum())
    if runs * wide <= 16 * len(order) + (1 << 20):
        n = np.bincount(cell, minlength=runs * wide)
        cells = np.flatnonzero(n)
        n, docs = n[cells], np.bincount(cell, fresh, runs * wide)[cells].astype(np.int64)
    else:
        cells, back = np.unique(cell, return_inverse=True)
        n, docs = np.bincount(back), np.bincount(back, fresh).astype(np.int64)
    head = order[first]
    # the distinct words as one buffer of bytes
    size = length[head]
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    raw = data[np.arange(ends[-1]) + np.repeat(start[head] - ends[:-1], size)]
    words = pa.Array.from_buffers(pa.binary(), runs, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    return words.take(pa.array(cells // wide)), cells % wide, n, docs


_COUNTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("docs", T.LongType())])
_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, added up over all batches."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            body = whole.column(0).cast(pa.large_string())
            sizes = np.diff(np.frombuffer(body.buffers()[1], np.int64, len(body) + 1, body.offset * 8))
            cut = np.flatnonzero(np.diff(np.cumsum(sizes) // SHARD, prepend=0)).tolist()
            for lo, hi in zip([0, *cut], [*cut, len(body)], strict=True):
                if lo == hi:
                    continue
                pairs = pa.RecordBatch.from_arrays([whole.column(i).slice(lo, hi - lo) for i in (1, 2)], ["lang", "source"]).to_pylist()
                known: dict[tuple, int] = {}
                group = np.array([known.setdefault((p["lang"], p["source"]), len(known)) for p in pairs])
                words, of, n, d = shard_counts(body.slice(lo, hi - lo), group)
                names = list(known)
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in names], pa.string()).take(at), pa.array([k[1] for k in names], pa.string()).take(at), words.cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], schema=_ARROW)

    found = docs.select(text("text"), text("lang"), text("source")).mapInArrow(count, _COUNTED)
    return found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 5) / (total + 5 v)) in whole numbers."""
    top = (n.cast("decimal(20,0)") + 5) * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + 5 * v).cast("decimal(20,0)")
    return F.call_function("div", top, below) + 1


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank), as the contract of the audit states it.

    Null texts, languages and sources count as ''. A language keeps the terms of at least ``least`` of its documents.
    Part ``pair`` has a row for each other source of the language; part ``term`` the ``top`` terms that a source uses
    more than its language does. Groups without a word take part; without kept terms all values of ``pair`` are 0.
    Ties are ordered by item in UTF-8. Repeated rows count each; very long texts are read whole; an empty table gives
    an empty result; other columns don't take part.
    """
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    counts = staged(term_counts(docs), "terms")
    # a row for each kept term, with its counts by source: no longer than the language has sources
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", F.col("n").alias("c"))).alias("by")).where(F.col("docs") >= least)
    kept = staged(kept.select("lang", "term", "n", "by"), "kept")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v"))
    used = kept.select("lang", "term", "n", F.inline("by"))
    totals = used.groupBy("lang", "source").agg(F.sum("c").alias("total"))
    known = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "v"])
    known = staged(known, "sources")
    return _terms(used, known, top).unionByName(_pairs(kept, known))


def _terms(used: DataFrame, known: DataFrame, top: int) -> DataFrame:
    rows = used.join(known, ["lang", "source"])
    rows = rows.select("lang", "source", F.col("term").alias("item"), (_p(F.col("c"), F.col("total"), F.col("v")) - _p(F.col("n"), F.col("lang_total"), F.col("v"))).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pairs(kept: DataFrame, known: DataFrame) -> DataFrame:
    """Distances of the sources of a language: partial sums of a task for each pair, added up on Spark."""
    # one row a language: its sources in order with what their probabilities need
    rates = known.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("sources"), F.first("v").alias("v"))
    rows = kept.select("lang", "by").join(rates, "lang")
    base = F.transform("sources", lambda s: _p(F.lit(0), s.total, F.col("v")))
    p = F.transform("by", lambda b: F.struct((F.array_position(F.transform("sources", lambda s: s.source), b.source) - 1).cast("int").alias("at"), _p(b.c, F.element_at(F.transform(F.filter("sources", lambda s: s.source == b.source), lambda s: s.total), 1), F.col("v")).alias("p")))
    rows = rows.select("lang", base.alias("base"), p.alias("p"))
    schema = "lang string, a int, b int, value long"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            names = whole.column(0).to_pylist()
            for lang in sorted(set(names)):
                own = whole.filter(pa.array([n == lang for n in names]))
                base, given = own.column(1), own.column(2)
                dense = base.flatten().to_numpy().reshape(len(own), -1).copy()
                inner = given.flatten()
                row = np.repeat(np.arange(len(own)), np.diff(given.offsets.to_numpy()))
                dense[row, inner.field("at").to_numpy()] = inner.field("p").to_numpy()
                total = sums.setdefault(lang, np.zeros((dense.shape[1], dense.shape[1]), np.int64))
                for i in range(dense.shape[1]):
                    total[i] += np.abs(dense - dense[:, i : i + 1]).sum(0)
        for lang, total in sums.items():
            a, b = np.nonzero(~np.eye(len(total), dtype=bool))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b])], names=["lang", "a", "b", "value"])

    sums = rows.mapInArrow(add, schema).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    places = rates.select("lang", F.posexplode(F.transform("sources", lambda s: s.source)).alias("a", "source"))
    others = places.join(places.select("lang", F.col("a").alias("b"), F.col("source").alias("item")), "lang").where("a <> b")
    found = others.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
