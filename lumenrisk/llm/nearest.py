"""Approximate nearest neighbours: stable projections under a kd-tree, verified until a chi-square test stops.

Unit vectors are projected by a matrix of independent normal values, so the squared projected distance over the
squared true one follows a chi-square law with as many degrees of freedom as there are projected dimensions. A search
verifies points in the order of their projected distance r, a kd-tree's leaf at a time, and stops once
F(r^2 / d^2) reaches ``SURE``, where d is the distance of the k-th best so far: a point at most that far away would lie
behind r with a probability of 1 - SURE only.

The tree's upper levels deal the vectors to blocks, fitted on a bounded sample; every vector is indexed. A query is
searched in its own block, then in all other blocks that the same test can't rule out by the distance of their box.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_sample, staged

#: Projected dimensions, probability of the stopping test, points of a leaf.
DIMS, SURE, LEAF = 8, 0.99, 128
#: Vectors that the upper levels are fitted on; vectors of a block, and blocks of the upper levels, that they aim at.
SAMPLE, BLOCK, BLOCKS = 8192, 8192, 1024
#: Vectors of a block, and queries that are searched in it at once, at most; above, both are dealt by a hash.
MOST, SLICE = 65536, 8192


def quantile(sure: float, dims: int) -> float:
    """x with F(x) = sure for chi-square with an even number of degrees of freedom, by bisection of its closed form."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < sure else (lo, mid)
    return hi


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, without overflow on the way."""
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def projection(length: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(17).normal(size=(length, dims))


class KdTree:
    """Median splits of the widest dimension, down to ``leaf`` points or ``leaves`` leaves."""

    def __init__(self, p: np.ndarray, leaf: int = LEAF, leaves: int = 1 << 30) -> None:
        self.splits: list[tuple[int, float, int, int]] = []  # dimension, value, children; leaves are ~place
        self.members: list[np.ndarray] = []
        self.root = self._grow(p, np.arange(len(p)), leaf, leaves)

    def _grow(self, p: np.ndarray, own: np.ndarray, leaf: int, leaves: int) -> int:
        spread = np.ptp(p[own], axis=0) if len(own) > max(leaf, 1) and leaves > 1 else np.zeros(1)
        d = int(spread.argmax())
        if spread[d] <= 0:
            self.members.append(own)
            return ~(len(self.members) - 1)
        at = float(np.median(p[own, d]))
        right = p[own, d] >= at
        if right.all():  # the median is the least value
            right = p[own, d] > at
            at = float(p[own[right], d].min())
        place = len(self.splits)
        self.splits.append((d, at, 0, 0))
        few = self._grow(p, own[~right], leaf, leaves // 2)
        more = self._grow(p, own[right], leaf, leaves - leaves // 2)
        self.splits[place] = (d, at, few, more)
        return place

    def assign(self, p: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.full(len(p), self.root)
        while len(open_ := np.flatnonzero(node >= 0)):
            for n in np.unique(node[open_]).tolist():
                d, at, few, more = self.splits[n]
                own = np.flatnonzero(node == n)
                node[own] = np.where(p[own, d] >= at, more, few)
        return ~node


def box_distance(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``q`` to each box."""
    out = np.zeros((len(q), len(lo)))
    for d in range(q.shape[1]):
        x = q[:, d, None]
        out += np.square(np.maximum(np.maximum(lo[:, d] - x, x - hi[:, d]), 0))
    return out


class Block:
    """Vectors of one block under their own kd-tree."""

    def __init__(self, x: np.ndarray, least: np.ndarray, matrix: np.ndarray) -> None:
        """least: for each vector the smallest of its ids, nulls as the largest."""
        self.unit = units(x)
        p = self.unit @ matrix
        tree = KdTree(p)
        order = np.concatenate(tree.members) if len(x) else np.zeros(0, int)
        self.edges = np.cumsum([0, *map(len, tree.members)])
        self.order, self.unit, self.x, self.least = order, self.unit[order], x[order], least[order]
        self.length = np.sqrt((self.x * self.x).sum(1))
        self.lo = np.array([p[m].min(0) for m in tree.members if len(m)]).reshape(-1, matrix.shape[1])
        self.hi = np.array([p[m].max(0) for m in tree.members if len(m)]).reshape(-1, matrix.shape[1])

    def search(self, q: np.ndarray, p: np.ndarray, bound: np.ndarray, k: int, limit: float) -> list[list[tuple[float, float, int]]]:
        """For each row of ``q``: at most ``k`` of (score, smallest id, place), best first, none worse than its ``bound``.

        ``p``: the projected queries. Leaves come in the order of their distance, in rounds of one, two, four, ... for
        each query; a leaf is verified for all queries that still want it at once. Before that the test is made anew.
        """
        best: list[list[tuple[float, float, int]]] = [[] for _ in range(len(q))]
        unit, length = units(q), np.sqrt((q * q).sum(1))
        worst = bound.copy()  # score of the k-th best so far
        away = box_distance(p, self.lo, self.hi)
        turn = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1, kind="stable")
        done, wide = 0, 1
        while done < len(self.lo):
            for leaf in range(len(self.lo)):
                wants = (turn[:, leaf] >= done) & (turn[:, leaf] < done + wide)
                wants = np.flatnonzero(wants & (away[:, leaf] < limit * (2 - 2 * worst + 1e-9)))
                if not len(wants):
                    continue
                at = slice(self.edges[leaf], self.edges[leaf + 1])
                near = unit[wants] @ self.unit[at].T
                for row in np.flatnonzero((near >= worst[wants, None] - 1e-9).any(1)).tolist():
                    i = int(wants[row])
                    places = self.edges[leaf] + np.flatnonzero(near[row] >= worst[i] - 1e-9)
                    score = (self.x[places] * q[i]).sum(1) / (self.length[places] * length[i])
                    own = [(s, t, j) for s, t, j in zip(score.tolist(), self.least[places].tolist(), places.tolist(), strict=True) if s >= bound[i]]
                    best[i] = sorted(best[i] + own, key=lambda b: (-b[0], b[1]))[:k]
                    if len(best[i]) == k:
                        worst[i] = max(best[i][-1][0], bound[i])
            done, wide = done + wide, wide * 2
        return best


_LISTED = T.ArrayType(T.StructType([T.StructField("far", T.DoubleType()), T.StructField("lost", T.BooleanType()), T.StructField("vec_id", T.LongType()), T.StructField("same", T.BooleanType())]))


def _matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, length)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, sure: float = SURE, dims: int = DIMS, block: int = BLOCK, most: int = MOST, slice_: int = SLICE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each row whose id ``every`` divides.

    Candidates are all rows but the query's own row. Nearness is the cosine in double precision on the original vectors;
    ties go to the smaller id, null ids last. Vectors that are null, empty, zero, hold a null or non-finite value, or
    are not as long as most take no part. Equal vectors are one point with the k + 1 smallest of their ids, so copies
    can't fill a block, and no link is lost by it. Repeated rows are rows of their own: each is answered, and each
    other one is a candidate. Other columns don't take part; an empty table gives an empty result; fewer candidates than ``k`` are
    all returned where the test lets them be seen.
    """
    spark = vectors.sparkSession
    limit, keep = quantile(sure, dims), k + 1
    rows, n, length = _valid(vectors, id_col, vec_col)
    matrix = projection(max(length, 1), dims)
    leaves = min(max(n // block, 1), BLOCKS)
    sample = bounded_sample(rows, "vec_id", SAMPLE).select("v").collect() if leaves > 1 else []  # at most SAMPLE vectors
    upper = KdTree(units(np.array([r.v for r in sample], float).reshape(-1, length)) @ matrix, leaves=leaves) if sample else None

    def placed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = units(x) @ matrix
        return p, upper.assign(p) if upper and len(p) else np.zeros(len(p), int)

    # equal vectors are one point, with the smallest of their ids
    order = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    points = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    points = points.groupBy("v").agg(F.collect_list(F.struct("vec_id")).alias("ids"))
    fields = [T.StructField("v", rows.schema["v"].dataType), T.StructField("ids", points.schema["ids"].dataType), T.StructField("leaf", T.IntegerType()), T.StructField("p", T.ArrayType(T.DoubleType()))]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, leaf = placed(_matrix(b.column(0), length))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf, pa.int32()), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["v", "ids", "leaf", "p"])

    points = staged(points.mapInArrow(index, T.StructType(fields)), "points")
    # a row for each leaf of the upper levels, of which there are at most BLOCKS
    boxes = points.groupBy("leaf").agg(F.count("*").alias("n"), *[f(F.col("p")[d]).alias(f"{name}{d}") for name, f in (("lo", F.min), ("hi", F.max)) for d in range(dims)]).orderBy("leaf").collect()
    parts = {r.leaf: -(-r.n // most) for r in boxes}
    lo, hi = (np.array([[r[f"{name}{d}"] for d in range(dims)] for r in boxes]).reshape(-1, dims) for name in ("lo", "hi"))
    names = np.array([r.leaf for r in boxes], int)
    table = F.broadcast(spark.createDataFrame([(leaf, m) for leaf, m in parts.items()], "leaf int, parts int"))
    block_of = (F.col("leaf").cast("long") * F.lit(1 << 20) + F.pmod(F.xxhash64("v"), F.col("parts"))).alias("block")
    points = points.join(table, "leaf").select(block_of, "v", "ids")

    asked = rows.where(F.col("vec_id") % every == 0).withColumn("q", F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
    queries = staged(asked.groupBy("q").agg(F.any_value("v").alias("v")), "asked")
    visit = T.StructType([T.StructField("q", T.StringType()), T.StructField("v", rows.schema["v"].dataType), T.StructField("block", T.LongType()), T.StructField("bound", T.DoubleType())])

    def visits(batches: Iterator[pa.RecordBatch], known: bool) -> Iterator[pa.RecordBatch]:
        """Each query's own block; with what is ``known`` of its k-th best, all others that the test leaves open."""
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                p, home = placed(_matrix(b.column(1), length))
                part = np.array(b.column(2).to_pylist())
                bound = np.array(b.column(3).to_pylist()) if known else np.full(len(p), -2.0)
                away = box_distance(p, lo, hi)
                home = np.where(np.isin(home, names), home, names[away.argmin(1)])  # a leaf of the sample alone has no block
                row, block = [], []
                for i in range(len(p)):
                    own = int(home[i]) * (1 << 20) + int(part[i]) % parts[int(home[i])]
                    if not known:
                        row.append(i), block.append(own)
                        continue
                    for leaf in names[away[i] < limit * (2 - 2 * bound[i] + 1e-9)].tolist():
                        for x in range(leaf << 20, (leaf << 20) + parts[leaf]):
                            if x != own:
                                row.append(i), block.append(x)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), b.column(1).take(pa.array(row, pa.int64())), pa.array(block, pa.int64()), pa.array(bound[row] if row else [], pa.float64())], names=visit.fieldNames())

    found = T.StructType([T.StructField("q", T.StringType()), T.StructField("found", _LISTED)])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.string()), "found": pa.array([], _FOUND)})
        x, q = _matrix(left.column("v"), length), _matrix(right.column("v"), length)
        ids = [[i["vec_id"] for i in row] for row in left.column("ids").to_pylist()]
        least = np.array([math.inf if row[0] is None else row[0] for row in ids], float if any(row[0] is None for row in ids) else np.int64)
        own = Block(x, least, matrix)
        out = []
        for i, best in enumerate(own.search(q, units(q) @ matrix, np.array(right.column("bound").to_pylist(), float), keep, limit)):
            out.append([{"far": -s, "lost": v is None, "vec_id": v, "same": bool((own.x[j] == q[i]).all())} for s, _, j in best for v in ids[own.order[j]]])
        names = right.column("q").to_pylist()
        held = [(n, o) for n, o in zip(names, out, strict=True) if o]
        return pa.table({"q": pa.array([n for n, _ in held], pa.string()), "found": pa.array([o for _, o in held], _FOUND)})

    def searched(wanted: DataFrame) -> DataFrame:
        """Blocks against their queries; a block with many is searched in slices of them."""
        slices = wanted.groupBy("block").agg(F.ceil(F.count("*") / slice_).cast("int").alias("slices"))
        right = wanted.join(slices, "block").withColumn("slice", F.pmod(F.xxhash64("q"), F.col("slices")).cast("int"))
        dealt = slices.select("block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        left = points.join(dealt, "block").select("block", "slice", "v", "ids")
        right = right.select("block", F.col("slice").alias("of"), "q", "v", "bound")
        return left.groupBy("block", "slice").cogroup(right.groupBy("block", "of")).applyInArrow(search, found)

    part = F.pmod(F.xxhash64("q"), F.lit(1 << 20)).alias("part")
    first = staged(searched(queries.select("q", "v", part, F.lit(None).cast("double").alias("bound")).mapInArrow(lambda b: visits(b, False), visit)), "first-found")
    kth = F.coalesce(-F.try_element_at(F.array_sort(F.transform("found", lambda f: f.far)), F.lit(keep)), F.lit(-2.0))
    known = queries.join(first.select("q", kth.alias("bound")), "q", "left").select("q", "v", part, F.coalesce("bound", F.lit(-2.0)).alias("bound"))
    rest = searched(known.mapInArrow(lambda b: visits(b, True), visit))
    merged = first.unionByName(rest).groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, keep).alias("found"))
    # the query's own row is one of the copies of its vector; without it the others move up
    answers = asked.select(F.col("vec_id").alias("query_id"), "q").join(merged, "q")
    own = F.array_position(F.transform("found", lambda f: f.same & f.vec_id.eqNullSafe(F.col("query_id"))), F.lit(True))
    answers = answers.withColumn("own", own).select("query_id", F.posexplode(F.slice(F.filter("found", lambda f, i: (i + 1) != F.col("own")), 1, k)).alias("at", "f"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", (-F.col("f.far")).alias("score"))


_FOUND = pa.list_(pa.struct([("far", pa.float64()), ("lost", pa.bool_()), ("vec_id", pa.int64()), ("same", pa.bool_())]))


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """(vec_id, v) of the vectors that take part, their number and their length: the most frequent one, of ties the longest."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    wide = lambda x: x.cast("double")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(wide(x)) & (F.abs(wide(x)) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    by = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return (rows.where(F.size("v") == by["length"]), by["count"], by["length"]) if by else (rows, 0, 0)
