"""Joins, grouping, resume and splits of the caption data flow."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nest_annotations(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """images with annotations (sorted by id) and coco_objects (sorted distinct non-empty names); empty where none."""
    named = annotations.join(categories, "category_id", "left").withColumn("category_name", F.coalesce("category_name", F.lit("")))
    by = named.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "category_id", "category_name"))).alias("annotations"))
    out = images.join(by, "image_id", "left")
    empty = F.coalesce("annotations", F.array().cast(by.schema["annotations"].dataType))
    out = out.withColumn("annotations", empty)
    return out.withColumn("coco_objects", object_names(F.col("annotations")))


def object_names(annotations: Column, objects: Column | None = None) -> Column:
    """``objects`` if given, else the sorted distinct non-empty names of the annotations."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform(annotations, lambda a: a["category_name"]), lambda n: n != "")))
    return names if objects is None else F.coalesce(objects, names)


def nest_captions(images: DataFrame, captions: DataFrame) -> DataFrame:
    """images with their captions in the order of ``ord``; an empty array where none."""
    by = captions.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", "caption"))).alias("c"))
    out = images.join(by, "image_id", "left")
    return out.withColumn("captions", F.coalesce(F.transform("c", lambda x: x["caption"]), F.array().cast("array<string>"))).drop("c")


def pending(samples: DataFrame, done: DataFrame, key: str = "image_id") -> DataFrame:
    return samples.join(done.select(key).distinct(), key, "left_anti")


def only_labelled(samples: DataFrame, labels: DataFrame, key: str = "image_id") -> DataFrame:
    return samples.join(labels.select(key).distinct(), key, "left_semi")


def with_generations(labels: DataFrame, generations: DataFrame, key: str = "image_id") -> DataFrame:
    """labels with the generation's raw ids where it has any, else their own."""
    g = generations.select(key, F.col("response_token_ids").alias("__raw"))
    out = labels.join(g, key, "left")
    return out.withColumn("response_token_ids", F.when(F.size("__raw") > 0, F.col("__raw")).otherwise(F.col("response_token_ids"))).drop("__raw")


def target_tokens(rows: DataFrame) -> DataFrame:
    """One row a span: its first token's id and the ids before it; spans without a token in the response are left out."""
    e = rows.select("image_id", "response_token_ids", F.posexplode("spans").alias("span_idx", "span"))
    first = F.get("span.token_indices", F.lit(0))
    e = e.withColumn("first", first).where((F.size("span.token_indices") > 0) & (F.col("first") < F.size("response_token_ids")))
    return e.select("image_id", "span_idx", "span.label", "first", F.get("response_token_ids", F.col("first")).alias("target_token_id"), F.slice("response_token_ids", F.lit(1), F.col("first")).alias("prefix"))


def hash_rank(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def hash_split(ids: DataFrame, key: str, cuts: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """(key, split): the share of hash space below each cut; needs neither order nor counts."""
    u = F.conv(F.substring(hash_rank(F.col(key), seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    out, at = None, 0.0
    for name, share in cuts:
        at += share
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return ids.select(key, out.otherwise(cuts[-1][0]).alias("split"))


def count_split(ids: DataFrame, key: str, ratio: float = 0.9, seed: int = 42, rest: tuple[str, ...] = ("test",)) -> DataFrame:
    """(key, split): exactly max(1, int(n * ratio)) in train, the others halved among two names or all in one.

    The rank is that of the hash; its running count goes over the hashes' leading byte, then inside it.
    """
    if not 0 < ratio < 1:
        raise ValueError("the ratio lies between 0 and 1")
    h = ids.select(key, hash_rank(F.col(key), seed).alias("h")).withColumn("b", F.substring("h", 1, 3))
    sizes = h.groupBy("b").count()
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("below"), F.sum("count").over(Window.partitionBy()).alias("n"))
    r = h.join(F.broadcast(sizes), "b").withColumn("rank", F.col("below") + F.row_number().over(Window.partitionBy("b").orderBy("h", key)) - 1)  # 4096 rows
    train = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(ratio)))
    out = F.when(F.col("rank") < train, "train")
    if len(rest) == 2:
        out = out.when(F.col("rank") < train + F.floor((F.col("n") - train) / 2), rest[0])
    return r.select(key, out.otherwise(rest[-1]).alias("split"))


def seeded_sample(ids: list[int], n: int, seed: int = 42) -> list[int]:
    """The reference order's sample: for id lists that fit the driver; hash_split serves larger ones."""
    return random.Random(seed).sample(ids, n) if n < len(ids) else list(ids)


def first_rows(rows: DataFrame, key: str, n: int | None) -> DataFrame:
    """The first n by key; all for None or 0."""
    return rows.orderBy(key).limit(n) if n else rows


def in_split(rows: DataFrame, splits: DataFrame, name: str, key: str = "image_id") -> DataFrame:
    """Rows whose id is in the split; test falls back to val where it is empty."""
    if name == "test" and splits.where("split = 'test'").isEmpty():
        name = "val"
    return rows.join(splits.where(F.col("split") == name).select(key).distinct(), key, "left_semi")
