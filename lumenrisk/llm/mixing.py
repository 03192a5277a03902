"""Mixing sources to target weights by nested hash-threshold histograms (DataFrame functions only).

Each document has a 48-bit hash of its id and text. A source takes every document a whole number of times and once
more those whose hash lies under the source's threshold. The threshold is found in four nested histograms of 4096
buckets: tokens are summed by source and bucket, the bucket in which the budget runs out is located by a running
sum, and only that bucket is opened for the next level. Nothing is sorted but at most 4096 sums of a source. The
last bucket is one hash: the rows that repeat a document. As many of them are taken as come nearest to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, staged, unstaged

LEVELS, LEVEL_BITS = 4, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def unit_hash(doc_id: Column, text: Column) -> Column:
    """48 bits of md5 of the id and the text, so that rows without id, or of one id, are each drawn by themselves."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, LEVELS * LEVEL_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point, null last.

    A target stops at ``most`` times its source; the excess is reshared by weight. The fixed point of that is a
    water level: sources in order of most*size/weight are full until the level of the rest is below theirs.
    One row for each source goes through the windows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w"))
    s = s.withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(share)).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("full"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open"),
    )
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # the first source that the level does not fill; without one all are full
    s = s.withColumn("stop", F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("z"), F.col("source").alias("n"), F.col("level").alias("level")))).over(every))
    level = F.col("stop.level")
    cap = F.col("cap").cast("double")
    return s.select("source", "source_size", F.when(level.isNull(), cap).otherwise(F.least(cap, level * F.col("w"))).alias("target"))


def thresholds(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """By source (__source) its size, target, whole passes, hash threshold (__until), and of the __equal rows at that
    very hash how many (__some) are taken as well. ``sized``: source, h, size."""
    same = lambda a, b: a.eqNullSafe(b)
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("passes", F.least(whole, F.lit(most)).cast("long"))
    goal = goal.withColumn("left", F.col("target") - F.col("passes") * F.col("source_size"))
    none = F.lit(0).cast("long")
    goal = staged(goal.select("*", none.alias("base"), none.alias("words"), none.alias("equal")), "mix-goals")
    width = LEVELS * LEVEL_BITS
    for level in range(1, LEVELS + 1):
        down = width - level * LEVEL_BITS
        g = goal.select(F.col("source").alias("gs"), "left", "base")
        # base: the bucket, as found so far, in which the budget runs out; at the first level all is one bucket
        inside = sized.join(g, same(F.col("source"), F.col("gs")) & (F.shiftright("h", down + LEVEL_BITS) == F.col("base")))
        sums = inside.groupBy("gs", F.shiftright("h", down).alias("b")).agg(F.sum("size").alias("n"), F.count("*").alias("c"), F.first("left").alias("left"))
        run = Window.partitionBy("gs").orderBy("b")
        sums = sums.withColumn("upto", F.sum("n").over(run))
        # the bucket that the budget ends in, and what is left for it
        edge = sums.where(F.col("upto") > F.col("left")).groupBy("gs").agg(F.min(F.struct("b", (F.col("left") - F.col("upto") + F.col("n")).alias("rest"), "n", "c")).alias("e"))
        last = goal
        goal = goal.join(edge, same(F.col("source"), F.col("gs")), "left").select(
            "source", "source_size", "target", "passes",
            F.coalesce(F.col("e.rest"), F.col("left")).alias("left"),
            # no bucket passes the budget: all of them are taken
            F.coalesce(F.col("e.b"), F.shiftleft(F.col("base") + 1, LEVEL_BITS)).alias("base"),
            F.coalesce(F.col("e.n"), F.lit(0)).alias("words"), F.coalesce(F.col("e.c"), F.lit(0)).alias("equal"),
        )
        goal = staged(goal, "mix-goals")
        unstaged(last)
    some = F.when(F.col("words") > 0, F.floor(F.col("left") * F.col("equal") / F.col("words") + 0.5)).otherwise(0).cast("long")
    columns = {"__source": "source", "__source_size": "source_size", "__target": "target", "__passes": "passes", "__until": "base", "__equal": "equal"}
    return goal.select(*[F.col(c).alias(n) for n, c in columns.items()], some.alias("__some"))


def _taken(rows: DataFrame, goal: DataFrame, source: str, h: str, most: int) -> DataFrame:
    """``rows`` with the columns of ``goal`` and __copies, how often the mix takes each."""
    joined = rows.join(goal, F.col(source).eqNullSafe(F.col("__source")))
    times = lambda more: F.least(F.col("__passes") + more.cast("long"), F.lit(most).cast("long")).alias("__copies")
    at = F.col(h) == F.col("__until")
    if goal.where("__some > 0 AND __some < __equal").isEmpty():
        return joined.select("*", times((F.col(h) < F.col("__until")) | (at & (F.col("__some") > 0))))
    # rows that repeat one document, of which a part is taken: they are numbered, by pieces and then inside a piece
    part = at & (F.col("__some") > 0) & (F.col("__some") < F.col("__equal"))
    edge = staged(joined.where(part).withColumn("__row", F.monotonically_increasing_id()), "mix-edge")
    edge = edge.withColumn("__piece", F.shiftright("__row", 33))
    sums = edge.groupBy("__source", "__piece").count()
    before = Window.partitionBy("__source").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("__source").alias("__s"), F.col("__piece").alias("__p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__source", "__piece").orderBy("__row")) + F.col("__before")
    edge = edge.join(sums, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__piece") == F.col("__p"))).withColumn("__rank", rank)
    edge = edge.select(*joined.columns, times(F.col("__rank") <= F.col("__some")))
    return joined.where(~part).select("*", times((F.col(h) < F.col("__until")) | (at & (F.col("__some") > 0)))).unionByName(edge)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``.

    Null or blank texts have size 0 and are taken 0 words; rows without id and rows that repeat an id are drawn each
    by its own text; of rows that also repeat the text so many are taken as come nearest to the target, and which
    ones makes no difference to the result. A null source is a source of its own; an empty table gives an empty
    result; other columns don't take part. Very long texts count whole, and are the grain of what a source can miss.
    """
    sized = docs.select("doc_id", "source", unit_hash(F.col("doc_id"), F.col("text")).alias("h"), word_count(F.col("text")).alias("size"))
    sized = staged(sized, "mix-sizes")
    out = _taken(sized, thresholds(sized, weights, share, most), "source", "h", most)
    return out.select("doc_id", "source", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size")).alias("taken"))


def mix_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """``docs`` with size, target, copies and taken: the thresholds are found as in ``mix``, then filter whole rows.

    Columns of ``docs`` with these names give way to the mix's own; others may have any name. Nulls, empty and
    repeated rows and an empty table are treated as in ``mix``.
    """
    own = ("size", "target", "copies", "taken")
    columns = [c for c in docs.columns if c not in own]
    added = {"__h": unit_hash(F.col("doc_id"), F.col("text")), "__size": word_count(F.col("text"))}
    sized = staged(docs.select("source", added["__h"].alias("h"), added["__size"].alias("size")), "mix-sizes")
    goal = thresholds(sized, weights, share, most)
    unstaged(sized)
    rows = _taken(docs.select(*columns, *[c.alias(n) for n, c in added.items()]), goal, "source", "__h", most)
    return rows.select(*columns, F.col("__size").alias("size"), F.col("__target").alias("target"), F.col("__copies").alias("copies"), (F.col("__copies") * F.col("__size")).alias("taken"))
