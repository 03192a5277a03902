"""SimHash near-duplicate groups by a binary trie self-join.

Every fingerprint is a root-to-leaf path of a binary trie. Two copies of the trie are walked together: a pair
of nodes carries the bits in which its two paths differ so far and is dropped as soon as that exceeds the error
budget. To spread the walk, the trie is built over ``radius + 1`` rotations of the bits: paths within the budget
agree on a whole leading block of at least one rotation, so in that trie they stay on one node to the block's
end. Each rotation's walk therefore starts from single nodes at that depth, and those are what Spark shuffles.
A node with too many leaves is first taken further down as node pairs in Spark itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, join_known, per_document, staged, unstaged

BITS = 64
#: Leaves under one node (or pair) that a single task takes; larger ones are split along the trie.
MAX_LEAVES = 100_000
#: Trie levels that one split in Spark descends.
SPLIT_BITS = 8


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """SimHash over ``shingle``-word shingles, repeats included; 0 where there is no word."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    joined, n = b" ".join(w), max(1, len(w) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(w)) - 1 :].tolist()
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    bits = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits in a signed long. Null texts count as empty."""

    def kernel(texts: list[str]) -> dict:
        return {"fp": np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)}

    return per_document(docs, kernel, [field("fp", T.LongType())])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def walk(v: np.ndarray, pairs: np.ndarray, err: np.ndarray, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Traverse node pairs together and return the linked leaves as two index arrays.

    v: leaves; a node is a range of v whose values are sorted and share their first ``depth`` bits.
    pairs: (start, end, start, end) of both nodes; err: bits in which their paths differ.
    """
    found: list[np.ndarray] = []
    while len(pairs):
        a0, a1, b0, b1 = pairs.T
        same, single = a0 == b0, (a1 - a0 == 1) & (b1 - b0 == 1)
        leaves = pairs[single & ~same]
        if len(leaves):
            x, y = leaves[:, 0], leaves[:, 2]
            near = popcount(v[x] ^ v[y]) <= radius
            found.append(np.stack([x[near], y[near]]))
        pairs, err, same = pairs[~single], err[~single], same[~single]
        if depth >= BITS or not len(pairs):
            break  # below the last bit a node is one value
        a0, a1, b0, b1 = pairs.T
        ones = np.concatenate(([0], np.cumsum((v >> np.uint64(BITS - 1 - depth)) & np.uint64(1)))).astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        kids = [(a0, am, b0, bm), (am, a1, bm, b1), (a0, am, bm, b1), (am, a1, b0, bm)]
        more = [err, err, err + 1, np.where(same, radius + 1, err + 1)]  # a node with itself: its halves meet once
        pairs = np.concatenate([np.stack(k, axis=1) for k in kids])
        err, depth = np.concatenate(more), depth + 1
        ok = (err <= radius) & (pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])
        pairs, err = pairs[ok], err[ok]
    both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return both[0], both[1]


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fewest links that join what the given ones join: each node with the least of its group."""
    nodes, flat = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = flat[: len(x)], flat[len(x) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def rotate(v: np.ndarray, by: int) -> np.ndarray:
    return v if not by else (v << np.uint64(by)) | (v >> np.uint64(BITS - by))


def _walk_groups(radius: int):
    """Arrow kernel over rows sorted by (shift, depth, lo, hi, rot): walks all node pairs of a chunk at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for shift, depth in np.unique(rows[:, :2], axis=0).tolist():
                part = rows[(rows[:, 0] == shift) & (rows[:, 1] == depth)]
                new = np.concatenate(([True], (part[1:, 2:4] != part[:-1, 2:4]).any(axis=1)))
                at = np.flatnonzero(new)
                end = np.append(at[1:], len(part))
                v = np.ascontiguousarray(part[:, 4]).view(np.uint64)
                lo, hi = part[at, 2].view(np.uint64), part[at, 3].view(np.uint64)
                # the leaves under the first node of a pair stand before those under the second one
                first = np.concatenate(([0], np.cumsum((v >> np.uint64(BITS - depth)) == np.repeat(lo, end - at))))
                mid = np.where(lo == hi, end, at + first[end] - first[at])
                pairs = np.stack([at, mid, np.where(lo == hi, at, mid), end], axis=1)
                ok = (pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])
                x, y = walk(v, pairs[ok], popcount(lo ^ hi)[ok], depth, radius)
                if not len(x):
                    continue
                w = rotate(v, (BITS - shift) % BITS).view(np.int64)
                s, d = forest(w[x], w[y])
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(d)], names=["src", "dst"])

        held, n = [], 0
        for b in batches:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            held, n = [*held, rows], n + len(rows)
            if n < 1 << 19:
                continue
            rows = np.concatenate(held)
            last = (rows[:, :4] != rows[-1, :4]).any(axis=1).nonzero()[0]
            cut = last[-1] + 1 if len(last) else 0  # the last node pair may go on
            yield from links(rows[:cut]) if cut else ()
            held, n = [rows[cut:]], len(rows) - cut
        if n:
            yield from links(np.concatenate(held))

    return run


def links(distinct_fps: DataFrame, radius: int = 2, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """(src, dst): links that join exactly the fingerprints within ``radius`` bits, directly or through others."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    n = max(int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    starts = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        fp = F.col("fp")
        rot = fp if not a else F.shiftleft(fp, a).bitwiseOR(F.shiftrightunsigned(fp, BITS - a))
        top = F.shiftrightunsigned(rot, BITS - (b - a))
        starts.append(F.struct(F.lit(a).alias("shift"), F.lit(b - a).alias("depth"), top.alias("lo"), top.alias("hi"), rot.alias("rot")))
    rows = distinct_fps.select(F.inline(F.array(*starts)))
    key = ["shift", "depth", "lo", "hi"]
    done = None
    while True:
        sizes = rows.groupBy(*key).count()
        big = sizes.where(F.col("count") > max_leaves).drop("count")
        depth = rows.agg(F.max("depth")).first()[0] if done is not None else max(b - a for a, b in zip(cuts, cuts[1:], strict=False))
        if depth is None or depth + SPLIT_BITS >= BITS or big.isEmpty():
            break
        small = rows.join(big, key, "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = staged(_split(rows.join(big, key, "left_semi"), radius), "trie-pairs")
    rows = rows if done is None else done.unionByName(rows)
    dealt = rows.repartition(n, *key).sortWithinPartitions(*key, _unsigned("rot")).select(*key, "rot")
    return dealt.mapInArrow(_walk_groups(radius), "src long, dst long")


def _unsigned(column: str) -> F.Column:
    """Order of a signed long read as unsigned."""
    return F.col(column).bitwiseXOR(F.lit(-(1 << 63)))


def _split(rows: DataFrame, radius: int) -> DataFrame:
    """Take node pairs SPLIT_BITS levels down: a leaf goes to each pair of children that is still in the budget."""
    masks = [m for m in range(1 << SPLIT_BITS) if m.bit_count() <= radius]
    # children of the leaf's own node, and of the other node at each affordable difference
    deep = F.col("depth") + SPLIT_BITS
    leaf = F.expr(f"shiftrightunsigned(rot, {BITS} - depth - {SPLIT_BITS})")
    mine = F.expr(f"shiftrightunsigned(rot, {BITS} - depth)")
    other = F.when(mine == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    low = leaf.bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))
    r = rows.select("*", deep.alias("deep"), leaf.alias("leaf"), other.alias("other"), low.alias("low"))
    r = r.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
    r = r.where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) + F.bit_count("mask") <= radius)
    far = F.shiftleft(F.col("other"), SPLIT_BITS).bitwiseOR(F.col("low").bitwiseXOR(F.col("mask")))
    r = r.select("shift", F.col("deep").alias("depth"), "leaf", far.alias("far"), "rot")
    return r.select("shift", "depth", F.least("leaf", "far").alias("lo"), F.greatest("leaf", "far").alias("hi"), "rot")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root): alternating large-star and small-star rounds until each component is one star.

    Minima come from aggregates and joins, never from collected neighbour lists; each round is a staged table.
    """
    edges = staged(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = staged(small, "cc")
        # a star forest: no node has two parents, no parent has a parent
        rest = new.groupBy("u").count().where("count > 1").select("u").union(new.select(F.col("v").alias("u")).join(new.select("u"), "u", "left_semi"))
        unstaged(edges)
        edges = new
        if rest.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, seed: int = 42, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """(doc_id, fp, component_id, root) for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other; repeated rows stay rows of their own;
    a null doc_id takes part but is never the smallest id (component_id is null if its component has none).
    An empty table gives an empty result. root is the component's smallest fingerprint.
    """
    fps = staged(fingerprints(docs, shingle, seed), "fps")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "fp")
    linked = components(links(distinct.select("fp"), radius, max_leaves))
    linked = linked.union(linked.select(F.col("root").alias("node"), "root").distinct())
    inside = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    inside = staged(inside, "roots")
    ids = inside.groupBy("root").agg(F.min("least").alias("component_id"))
    known = inside.join(ids, "root").select("fp", "root", "component_id")
    return join_known(fps, known, "fp", frequent(distinct, "fp")).select("doc_id", "fp", "component_id", "root")


def frequent(distinct: DataFrame, key: str, share: int = 1024) -> DataFrame:
    """Keys of over a ``share``-th of all rows, so at most ``share`` of them. ``distinct``: key, rows."""
    total = distinct.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return distinct.where(F.col("rows") > total / share).select(key)


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` with one document of each group left: the one with the smallest doc_id.

    Rows of the group that repeat that doc_id are cut to one, also where other rows with it hold texts of other
    groups; a group without any doc_id keeps one of its rows.
    """

    def named(rows: DataFrame) -> DataFrame:
        return per_document(rows, lambda ts: {"__key": np.array([fingerprint(t, shingle) for t in ts], np.uint64).view(np.int64)}, [field("__key", T.LongType())], keep=docs.columns)

    return one_of_each(docs, near_duplicates(docs, shingle, radius), "fp", named)


def one_of_each(docs: DataFrame, found: DataFrame, key: str, named: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The document with the smallest id of each group in ``found``; ``named`` adds the value of ``key`` as __key.

    Rows of an id that occurs once are chosen by the id. Where an id repeats, its rows can hold different texts, and
    where it is null it says nothing: those rows are chosen by their key, one for each group.
    """
    columns = docs.columns
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("least"))
    # the ids that go are fewer than those that stay: as long as they are small enough to broadcast, no text is moved
    gone = staged(ids.where("n > 1 OR NOT least").select("doc_id"), "gone-ids")
    kept = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(*columns)
    roots = found.select(F.col(key).alias("__key"), F.col("root").alias("__root"), F.col("component_id").alias("__least")).distinct()
    repeated = ids.where("n > 1 AND least").select("doc_id")
    if not repeated.isEmpty():
        rows = named(docs.join(repeated, "doc_id", "left_semi").select(*columns)).join(roots, "__key").where(F.col("doc_id") == F.col("__least"))
        kept = kept.unionByName(rows.dropDuplicates(["__root"]).select(*columns))
    nameless = docs.where("doc_id IS NULL")
    if not nameless.isEmpty():
        rows = named(nameless).join(roots.where("__least IS NULL"), "__key")
        kept = kept.unionByName(rows.dropDuplicates(["__root"]).select(*columns))
    return kept
