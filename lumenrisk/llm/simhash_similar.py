"""Near-duplicate groups by word shingle similarity, found through wide SimHash fingerprints in binary tries.

A similarity of 0.8 moves about 15 % of a fingerprint's bits, too many for one trie with a guaranteed radius. So
the fingerprint is cut into 16 sections of three bytes or more; each section is a trie of its own, walked with a
budget of a bit less than it has bytes. A pair of similarity 0.8 stays in the budget of a section with probability
0.26 to 0.29, of at least one section with 0.99 or more (0.9: more than 0.9999). A pair of leaves goes on if the whole
fingerprints agree well enough, and the exact Jaccard similarity of the distinct shingles decides each link.

Sections grow with the number of texts (``section_bytes``): a text meets others by chance in n V / 2^bits leaves of a
section, where V counts the paths in the budget. Another byte lowers that some fourteenfold at the same recall, so
a text's comparisons stay bounded as n grows, and the walk linear but for its 16 rows a byte.

A section is walked in one rotation for each byte: paths that differ in fewer bits than there are bytes agree on one
byte, so that byte is the key by which Spark deals the leaves. A node with too many leaves is taken a byte further
down in Spark, as pairs of its children.

The walk gives a spanning forest of the near pairs, whose components are groups of near fingerprints. The shingle sets
of a group that fits in one task are dealt there once, shared shingles are counted for all its pairs, and what goes on
is a spanning forest of the true links. In a larger group the edges of the forest are checked first, which joins most
of it at little cost; if that leaves it in several parts, it is compared as a whole too, dealt in pairs of blocks.

Fingerprints of few shingles are coarse. Texts of at most 13 distinct shingles are therefore also linked exactly: sets
of a similarity of 0.8 become equal when at most two shingles of each are left out, so they meet at a common subset.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, join_known, per_document, staged, unstaged
from .decontam import mix64, shingle_hashes
from .simhash_dedup import components, forest, frequent, one_of_each, walk

SHINGLE, SIMILARITY = 5, 0.8
#: Sections, their bytes at least and at most, and the comparisons by chance that a text may have in a section.
SECTIONS, NARROW, WIDE, CHANCE = 16, 3, 6, 64
BYTES = SECTIONS * NARROW
#: Leaves under one node that a single task takes; larger ones are split along the trie.
MAX_LEAVES = 2_000_000
#: Rows that a walk holds before it works on the complete trie nodes among them.
HELD_ROWS = 1 << 17
#: Document pairs compared at once.
BLOCK = 1 << 18
#: Leaves beyond which a node is compared by pivots.
SMALL_NODE = 64
#: Links of a hub that are checked together.
HUB_LINKS = 256
#: Distinct shingles up to which texts are also linked through common subsets; standard deviations that bits may lie apart.
FEW, SPREAD = 13, 3.5
#: Texts and bytes of shingles in a block of a group, and texts from which a shingle is counted by matrix product.
BLOCK_NODES, BLOCK_BYTES, DENSE = 1024, 16 << 20, 32
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_STEP = 0x9E3779B97F4A7C15
_SEEDS = np.array([(i * _STEP) & (1 << 64) - 1 for i in range(1, SECTIONS * WIDE // 8 + 1)], np.uint64)


def section_bytes(texts: int) -> int:
    """Bytes of a section, so that a text meets at most ``CHANCE`` of ``texts`` others by chance in each."""
    for size in range(NARROW, WIDE):
        if texts * sum(math.comb(8 * size, i) for i in range(size)) <= CHANCE << 8 * size:
            return size
    return WIDE


def _expected_bits(similarity: float, spread: float, bits: int = 8 * BYTES) -> int:
    """Bits in which fingerprints of sets of a Jaccard similarity differ, plus ``spread`` standard deviations."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + spread * np.sqrt(bits * p * (1 - p)))


def shingle_set(text: str, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """A hash of the word sequence and the sorted hashes of its distinct shingles; fewer words are one shingle."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    x = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    return xxhash.xxh64_intdigest(b" ".join(w)), np.unique(shingle_hashes(x, min(shingle, len(w)))) if w else np.empty(0, np.uint64)


def wide_fingerprint(h: np.ndarray, width: int = BYTES) -> bytes:
    """SimHash of a set of hashes in ``width`` bytes: a bit is 1 if set in over half of them."""
    at, counts = np.arange(width) * 256, np.zeros(width * 256, np.int64)
    for i in range(0, len(h), 1 << 14):
        many = mix64(h[i : i + (1 << 14), None] + _SEEDS[: width // 8]).view(np.uint8)
        counts += np.bincount((many + at).ravel(), minlength=width * 256)
    return np.packbits(2 * (counts.reshape(width, 256) @ _BYTE_BITS) > len(h), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, shingle: int, width: int = BYTES) -> DataFrame:
    """(doc_id, node, fp, few): node names the word sequence; few holds the shingles where those are few."""

    def kernel(texts: list[str]) -> dict:
        node, sets = zip(*[shingle_set(t, shingle) for t in texts], strict=True) if texts else ((), ())
        few = [h.tobytes() if 0 < len(h) <= FEW else None for h in sets]
        return {"node": np.array(node, np.uint64).view(np.int64), "fp": [wide_fingerprint(h, width) for h in sets], "few": few}

    return per_document(docs, kernel, [field("node", T.LongType()), field("fp", T.BinaryType()), field("few", T.BinaryType())])


def subsets(h: np.ndarray, similarity: float) -> Iterator[tuple[int, int, int]]:
    """(key, shingles left out, shingles left) of a set and its subsets that can be common to a similar set."""
    n = len(h)
    whole = mix64(h)
    total = int(whole.sum(dtype=np.uint64))
    yield total, 0, n
    for left_out in (1, 2):
        left = n - left_out
        if left < similarity * n:
            return
        for gone in combinations(range(n), left_out):
            yield (total - int(whole[list(gone)].sum(dtype=np.uint64))) & (1 << 64) - 1, left_out, left


def few_links(distinct: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): all links between texts of few shingles, as stars around common subsets.

    Two sets that leave out i and j shingles of a common subset of c are similar if c >= similarity * (c + i + j).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                rows = [(k, node, i, c) for node, few in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for k, i, c in subsets(np.frombuffer(few, np.uint64), similarity)]
                key = np.array([r[0] for r in rows], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]], names=["key", "node", "gone", "left"])

    rows = distinct.where("few IS NOT NULL").select("node", "few").mapInArrow(run, "key long, node long, gone long, left long")
    linked = lambda other: F.col("left") >= similarity * (F.col("left") + F.col("gone") + other)
    hubs = [F.min(F.when(F.col("gone") == i, F.col("node"))).alias(f"hub{i}") for i in (0, 1)]
    by = rows.groupBy("key", "left").agg(F.count("*").alias("n"), *hubs).where("n > 1").drop("n")
    ends = [F.when(linked(i), F.col(f"hub{i}")) for i in (0, 1)]
    pairs = rows.join(by, ["key", "left"]).select("node", F.explode(F.array_compact(F.array(*ends))).alias("hub")).where("node <> hub")
    return pairs.select(F.least("node", "hub").alias("src"), F.greatest("node", "hub").alias("dst")).distinct()


def strongest(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of a spanning forest of least distance: in rounds, each group takes its nearest link to another one."""
    order = np.lexsort((y, x, d))
    x, y, d = x[order], y[order], d[order]
    names, flat = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b, root, taken = flat[: len(x)], flat[len(x) :], np.arange(len(names)), np.zeros(len(x), bool)
    live = np.arange(len(x))
    while True:
        live = live[root[a[live]] != root[b[live]]]
        if not len(live):
            return x[taken], y[taken], d[taken]
        ends = np.stack([root[a[live]], root[b[live]]], axis=1).ravel()
        nearest = np.unique(live[np.unique(ends, return_index=True)[1] // 2])
        taken[nearest] = True
        child, parent = forest(root[a[nearest]], root[b[nearest]])
        new = np.arange(len(names))
        new[child] = parent
        root = new[root]


def _crossed(a0: np.ndarray, na: np.ndarray, b0: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every place of the ranges a with every one of b, in blocks."""
    size = na * nb
    ends = np.cumsum(size)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, BLOCK):
        k = np.arange(lo, min(lo + BLOCK, int(ends[-1])))
        r = np.searchsorted(ends, k, "right")
        k = k - (ends[r] - size[r])
        yield a0[r] + k // nb[r], b0[r] + k % nb[r]


class Walker:
    """Links of one chunk of trie nodes: document pairs whose paths stay in the budget and whose fingerprints are near."""

    def __init__(self, fp: np.ndarray, far: int, clear: int, size: int = NARROW) -> None:
        self.wide, self.far, self.clear, self.size = fp.view(np.uint64), far, clear, size
        self.found: list[np.ndarray] = []
        self.root = np.arange(len(fp))
        self.count = 0

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.wide[a] ^ self.wide[b]).sum(axis=1, dtype=np.int64)

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = self.distance(a, b)
        near = d <= self.far
        self.found.append(np.stack([a[near], b[near], d[near]]))
        self.count += int(near.sum())
        if self.count > 1 << 21:
            self.shrink()
        return d

    def shrink(self) -> None:
        self.found = [np.stack(strongest(*np.concatenate(self.found, axis=1)))]
        self.count = self.found[0].shape[1]

    def inside(self, lo: int, hi: int) -> None:
        """All pairs of a large node. What is clearly linked with a pivot is joined through it and needs no turn itself."""
        everyone, waiting = np.arange(lo, hi), np.ones(hi - lo, bool)
        for i in range(hi - lo):
            if waiting[i]:
                d = self.compare(np.full(hi - lo - 1, lo + i), np.delete(everyone, i))
                near = np.delete(everyone, i)[d <= self.clear]
                waiting[near - lo] = False

    def join_clear(self) -> None:
        """Root of each document by the clear links so far."""
        x, y, d = np.concatenate(self.found, axis=1) if self.found else np.empty((3, 0), np.int64)
        child, parent = forest(x[d <= self.clear], y[d <= self.clear])
        self.root = np.arange(len(self.wide))
        self.root[child] = parent

    def blocks(self, a0: np.ndarray, na: np.ndarray, b0: np.ndarray, nb: np.ndarray) -> None:
        """Compare every document of the ranges a with every one of b."""
        for a, b in _crossed(a0, na, b0, nb):
            ok = a < b
            self.compare(a[ok], b[ok])

    def leaves(self, group: np.ndarray, tail: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """First row and size of each leaf, whether it is one of two children, and the pairs of leaves in the budget.

        group: number of each row's trie node or pair of its children lo and hi; tail: the section's bits below the node, sorted.
        """
        below, budget = 8 * (self.size - 1), self.size - 1
        both = (group.astype(np.int64) << below) | tail
        at = np.concatenate(([0], np.flatnonzero(np.diff(both)) + 1))
        n = np.diff(np.append(at, len(both)))
        tops = np.concatenate(([0], np.flatnonzero(np.diff(group[at])) + 1))
        stops = np.append(tops[1:], len(at))
        two = lo[at] != hi[at]
        leaf = tail[at].astype(np.uint64) << np.uint64(64 - below)
        one, pair = ~two[tops], two[tops]
        x, y = walk(leaf, np.stack([tops, stops, tops, stops], axis=1)[one], np.zeros(one.sum(), np.int64), 0, budget)
        if pair.any():
            low = np.concatenate(([0], np.cumsum(tail[at] >> below - 8 == lo[at])))
            mids = tops + low[stops] - low[tops]
            apart = np.bitwise_count(lo[at][tops] ^ hi[at][tops]).astype(np.int64)
            sides = np.stack([tops, mids, mids, stops], axis=1)
            pair &= (tops < mids) & (mids < stops)
            more = walk(leaf, sides[pair], apart[pair], 8, budget)
            x, y = np.concatenate([x, more[0]]), np.concatenate([y, more[1]])
        return at, n, two, x, y

    def links(self, group: np.ndarray, tail: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the near pairs."""
        at, n, two, x, y = self.leaves(group, tail, lo, hi)
        # between two children: small leaves of one side have met in the child's own group
        small, large = ~two & (n <= SMALL_NODE), n > SMALL_NODE
        self.blocks(at[small], n[small], at[small], n[small])
        for a, m in zip(at[large].tolist(), n[large].tolist(), strict=True):
            self.inside(a, a + m)
        large = n[x] * n[y] > SMALL_NODE**2
        self.blocks(at[x[~large]], n[x[~large]], at[y[~large]], n[y[~large]])
        x, y = x[large], y[large]
        if len(x):
            self.blocks(at[x], np.ones(len(x), np.int64), at[y], np.ones(len(y), np.int64))
            self.join_clear()
            whole = np.minimum.reduceat(self.root, at) == np.maximum.reduceat(self.root, at)
            open_ = ~(whole[x] & whole[y] & (self.root[at[x]] == self.root[at[y]]))
            x, y = x[open_], y[open_]
            swap = at[x] > at[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            self.blocks(at[x], n[x], at[y], n[y])
        if self.found:
            self.shrink()
            return self.found[0][0], self.found[0][1]
        return np.empty(0, np.int64), np.empty(0, np.int64)


def _walk_sections(far: int, clear: int, size: int):
    """Arrow kernel over rows (byte, head, lo, hi, node, fp) sorted by the first four; lo and hi are the children of a
    split node, -1 where a node is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(byte: np.ndarray, head: np.ndarray, lo: np.ndarray, hi: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            rows, first, tail = np.arange(len(byte)), byte - byte % size, np.zeros(len(byte), np.int64)
            for i in range(1, size):
                tail = tail << 8 | fp[rows, first + (byte + i) % size]
            keys = np.stack([byte, head, lo, hi], axis=1)
            group = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))))
            order = np.lexsort((node, tail, group))
            x, y = Walker(np.ascontiguousarray(fp[order]), far, clear, size).links(group[order], tail[order], lo[order], hi[order])
            a, b = node[order][x], node[order][y]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

        held: list[tuple] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            fp = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(-1, SECTIONS * size)
            byte, lo, hi, node = (b.column(c).to_numpy().astype(np.int64) for c in ("byte", "lo", "hi", "node"))
            held.append((byte, fp[np.arange(len(byte)), byte].astype(np.int64), lo, hi, node, fp))
            n += b.num_rows
            if n < HELD_ROWS:
                continue
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = np.flatnonzero(np.any([c != c[-1] for c in whole[:4]], axis=0))
            cut = last[-1] + 1 if len(last) else 0  # the last node may go on
            if cut:
                yield work(*[c[:cut] for c in whole])
            held, n = [tuple(c[cut:] for c in whole)], n - cut
        if n:
            yield work(*[np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def candidates(distinct: DataFrame, similarity: float, max_leaves: int = MAX_LEAVES, size: int = NARROW) -> DataFrame:
    """(src, dst): for every group of near fingerprints a spanning forest of its nearest pairs, by section."""
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = distinct.select(F.explode(F.sequence(F.lit(0), F.lit(SECTIONS * size - 1))).alias("byte"), "node", "fp")
    rows = rows.select("byte", F.expr("substring(fp, byte + 1, 1)").alias("head"), "node", "fp")
    whole = F.lit(-1)
    big = staged(rows.groupBy("byte", "head").count().where(F.col("count") > max_leaves).select("byte", "head", F.lit(True).alias("split")), "wide-nodes")
    if big.isEmpty():
        rows = rows.select("*", whole.alias("lo"), whole.alias("hi"))
    else:
        below = F.expr(f"cast(conv(hex(substring(fp, byte - byte % {size} + (byte + 1) % {size} + 1, 1)), 16, 10) as int)")
        masks = F.array(*[F.lit(m) for m in range(256) if m.bit_count() < size])
        # at most 96 x 256 nodes: their list is safe to broadcast
        rows = rows.join(F.broadcast(big), ["byte", "head"], "left").withColumn("below", below)
        rows = rows.withColumn("mask", F.explode(F.when(F.col("split"), masks).otherwise(F.array(F.lit(0)))))
        other = F.col("below").bitwiseXOR(F.col("mask"))
        pick = lambda c: F.when(F.col("split"), c).otherwise(whole)
        rows = rows.select("byte", "head", "node", "fp", pick(F.least("below", other)).alias("lo"), pick(F.greatest("below", other)).alias("hi"))
    keys = ["byte", "head", "lo", "hi"]
    dealt = rows.repartition(n, *keys).sortWithinPartitions(*keys).select("byte", "lo", "hi", "node", "fp")
    bits = 8 * SECTIONS * size
    far, clear = _expected_bits(similarity, SPREAD, bits), _expected_bits((1 + similarity) / 2, 0, bits)
    return dealt.mapInArrow(_walk_sections(far, clear, size), "src long, dst long").distinct()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share: common shingles by a product of 0-1 matrices, others by their pairs."""
    m = len(sets)
    both = np.zeros((m, m), np.float32)
    owner = np.repeat(np.arange(m), [len(h) for h in sets])
    h = np.concatenate(sets)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    n = np.diff(np.append(at, len(h)))
    few = (n > 1) & (n <= DENSE)
    for a, b in _crossed(at[few], n[few], at[few], n[few]):
        np.add.at(both, (owner[a], owner[b]), 1)
    many = np.flatnonzero(n > DENSE)
    for i in range(0, len(many), 4096):
        column = many[i : i + 4096]
        has = np.zeros((m, len(column)), np.float32)
        rows = np.concatenate([owner[at[c] : at[c] + n[c]] for c in column])
        has[rows, np.repeat(np.arange(len(column)), n[column])] = 1
        both += has @ has.T
    return both


def _across(similarity: float):
    """Arrow kernel over rows (comp, lo, hi, node, part, shingles) sorted by the first three, which name a pair of
    blocks: a spanning forest of all links between different parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            node, part = (np.array([r[i] for r in rows], np.int64) for i in (3, 4))
            if len(set(part.tolist())) < 2:
                return
            sets = [np.frombuffer(r[5], np.uint64) for r in rows]
            size = np.array([len(h) for h in sets], np.float32)
            both = shared_counts(sets)
            # as float32 counts are whole numbers up to 2 ** 24; the test itself is in double
            x, y = np.nonzero(np.triu(both >= 0.99 * similarity * (size[:, None] + size - both), 1) & (part[:, None] != part))
            b = both[x, y].astype(float)
            ok = b >= similarity * (size[x].astype(float) + size[y] - b)
            a, b = forest(node[x[ok]], node[y[ok]])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])

        held: list[tuple] = []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield from work(held)
                    held = []
                held.append(row)
        if held:
            yield from work(held)

    return run


def compared(rows: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): a spanning forest of all links between the parts of each block pair (comp, lo, hi) of ``rows``."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ["comp", "lo", "hi"]
    dealt = rows.select(*keys, "node", "part", "shingles").repartition(n, *keys).sortWithinPartitions(*keys, "node")
    return dealt.mapInArrow(_across(similarity), "src long, dst long")


def links_across(sets: DataFrame, big: DataFrame, linked: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): links between the parts of each group in ``big`` that ``linked`` leaves in several parts.

    Such a group is cut into blocks by a hash, and each two of them are compared, so no task holds more than two blocks.
    """
    rows = sets.select("node", "comp").join(big, "comp").join(linked, "node", "left")
    rows = staged(rows.select("node", "comp", "blocks", F.coalesce("root", "node").alias("part")), "near-parts")
    open_ = rows.groupBy("comp").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("comp")
    rows = rows.join(open_, "comp").join(sets.select("node", "shingles"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("comp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "part", "shingles")
    return compared(rows, similarity).distinct()


def _checked(pairs: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                least, most = min(len(p), len(q)), max(len(p), len(q))
                near = least >= similarity * most
                if near:
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    near = both >= similarity * (len(p) + len(q) - both)
                keep.append(bool(near))
            yield b.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (src, dst) of ``edges`` whose sets are similar enough. The links of a hub are checked in blocks."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    degree = ends.groupBy("node").count()
    e = edges.join(degree.select(F.col("node").alias("src"), F.col("count").alias("n_src")), "src")
    e = e.join(degree.select(F.col("node").alias("dst"), F.col("count").alias("n_dst")), "dst")
    swap = F.col("n_dst") > F.col("n_src")
    pick = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    blocks = F.ceil(F.greatest("n_src", "n_dst") / HUB_LINKS)
    e = e.select(pick("dst", "src").alias("src"), pick("src", "dst").alias("dst"), blocks.alias("blocks"))
    e = e.withColumn("block", F.pmod(F.xxhash64("dst"), "blocks")).drop("blocks")
    hubs = e.select("src", "block").distinct().join(sets.select(F.col("node").alias("src"), F.col("shingles").alias("a")), "src")
    others = e.join(sets.select(F.col("node").alias("dst"), F.col("shingles").alias("b")), "dst")
    return _checked(others.join(hubs, ["src", "block"]), similarity)


def _sets(docs: DataFrame, group: DataFrame, distinct: DataFrame, shingle: int) -> DataFrame:
    """(node, comp, size, shingles) of the nodes in ``group``; each text is taken from the document with its smallest id."""

    def kernel(texts: list[str]) -> dict:
        node, sets = zip(*[shingle_set(t, shingle) for t in texts], strict=True) if texts else ((), ())
        return {"node": np.array(node, np.uint64).view(np.int64), "shingles": [h.tobytes() for h in sets]}

    # a table's size is known before the join is planned, so texts are not shuffled for a short list of ids
    wanted = staged(distinct.join(group, "node", "left_semi").select(F.col("least").alias("doc_id")), "wanted-ids")
    slim = docs.select("doc_id", "text")
    slim = slim.join(wanted, "doc_id", "left_semi").unionByName(slim.where("doc_id is null"))
    found = per_document(slim, kernel, [field("node", T.LongType()), field("shingles", T.BinaryType())], keep=[])
    once = found.join(group, "node").groupBy("node").agg(F.first("comp").alias("comp"), F.first("shingles").alias("shingles"))
    return once.select("node", "comp", F.length("shingles").alias("size"), "shingles")


def similar_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, max_leaves: int = MAX_LEAVES, section: int | None = None) -> DataFrame:
    """(doc_id, node, component_id, root) for every row of ``docs``; component_id is the group's smallest doc_id.

    Words are lower-cased in A-Z. Null, empty and wordless texts are copies of each other and of nothing else;
    a text of fewer words than a shingle is one shingle. Repeated rows stay rows of their own; a null doc_id takes
    part but is never the smallest id (component_id is null if its group has none). An empty table gives an empty
    result; very long texts are read whole; other columns don't take part. Every link is exact. Links between texts of
    at most ``FEW`` distinct shingles are all found; others by the fingerprints, with the recall that the README gives.
    ``section``: bytes of a section; by default as the number of rows demands.
    """
    size = section or section_bytes(docs.count())
    fps = staged(fingerprints(docs, shingle, SECTIONS * size), "wide-fps")
    distinct = staged(fps.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("few").alias("few"), F.count("*").alias("rows")), "wide-fp")
    empty = F.lit(xxhash.xxh64_intdigest(b"") - (1 << 64))
    edges = staged(candidates(distinct.where(F.col("node") != empty).select("node", "fp"), similarity, max_leaves, size), "wide-links")
    stars = components(edges)
    group = stars.select("node", F.col("root").alias("comp")).union(stars.select("root", "root").distinct())
    sets = staged(_sets(docs, group, distinct, shingle), "shingles")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("blocks")
    big = staged(sets.groupBy("comp").agg(blocks).where("blocks > 1"), "big-groups")
    zero = F.lit(0).cast("long")
    small = sets.join(big, "comp", "left_anti").select("comp", zero.alias("lo"), zero.alias("hi"), "node", F.col("node").alias("part"), "shingles")
    links = compared(small, similarity).unionByName(few_links(distinct, similarity))
    tables = [edges, stars, sets, big]
    crowded = not big.isEmpty()
    if crowded:
        inner = group.join(big, "comp", "left_semi").select(F.col("node").alias("src"))
        links = links.unionByName(verified(edges.join(inner, "src", "left_semi"), sets.join(big, "comp", "left_semi"), similarity))
    links = staged(links, "near-links")
    linked = components(links)
    tables.append(links)
    if crowded:
        more = staged(links_across(sets, big, linked, similarity), "near-links")
        tables.append(more)
        if not more.isEmpty():
            unstaged(linked)
            linked = components(links.unionByName(more))
    linked_all = linked.union(linked.select(F.col("root").alias("node"), "root").distinct())
    inside = staged(distinct.select("node", "least").join(linked_all, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "wide-roots")
    for gone in (linked, *tables):
        unstaged(gone)
    ids = inside.groupBy("root").agg(F.min("least").alias("component_id"))
    known = inside.join(ids, "root").select("node", "root", "component_id")
    return join_known(fps.select("doc_id", "node"), known, "node", frequent(distinct, "node"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with one document of each group left: the one with the smallest doc_id.

    Rows of the group that repeat that doc_id are cut to one, also where other rows with it hold texts of other
    groups; a group without any doc_id keeps one of its rows. Other columns may have any name.
    """
    found = similar_documents(docs, shingle, similarity)
    return one_of_each(docs, found, "node", lambda rows: _named(rows, shingle, docs.columns))


def _named(rows: DataFrame, shingle: int, columns: list[str | Column]) -> DataFrame:
    def kernel(texts: list[str]) -> dict:
        return {"__key": np.array([shingle_set(t, shingle)[0] for t in texts], np.uint64).view(np.int64)}

    return per_document(rows, kernel, [field("__key", T.LongType())], keep=columns)
