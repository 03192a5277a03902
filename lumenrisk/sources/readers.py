"""Sources and sinks: caption JSON, question lines, JSON maps, image listings, incremental tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import relational as R
from .json_parts import array_elements, map_entries

INSTANCES = {
    "images": "struct<id:long,file_name:string>",
    "categories": "struct<id:long,name:string>",
    "annotations": "struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int>",
}
CAPTIONS = {"annotations": "struct<id:long,image_id:long,caption:string>"}
QUESTIONS = "text string, image string, label string, question_id long"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reads has the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def required(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        if path and not exists(spark, path):
            raise FileNotFoundError(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text file with their 0-based number; blank lines count but are left out.

    Lines are numbered inside their split, and splits by how many lines stand before them: one small row a split.
    """
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("m"))
    split, inside = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(split.alias("split")).count().select("split", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    out = rows.withColumn("split", split).join(F.broadcast(sizes), "split")  # one row a split
    return out.select((F.col("before") + inside).alias("line"), "value").where(F.trim("value") != "")


def coco_samples(spark: SparkSession, instances: str, captions: str, images_dir: str = "", n: int | None = None, seed: int = 42) -> DataFrame:
    """(image_id, file_name, image_path, annotations, coco_objects, captions) from two caption JSON documents, which are
    read in splits.

    A missing path is an error. ``n`` draws that many images by a hash of id and ``seed``.
    """
    required(spark, instances, captions, images_dir)
    doc = array_elements(spark, instances, INSTANCES)
    images = doc["images"].select(F.col("id").alias("image_id"), "file_name", F.concat_ws("/", F.lit(images_dir), "file_name").alias("image_path"))
    cats = doc["categories"].select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    anns = doc["annotations"].drop("ord")
    caps = array_elements(spark, captions, CAPTIONS)["annotations"].select("ord", "image_id", "caption")
    out = R.nest_captions(R.nest_annotations(images, anns, cats), caps)
    return out.orderBy(F.xxhash64("image_id", F.lit(seed))).limit(n) if n else out


def existing_files(samples: DataFrame, folder: str) -> DataFrame:
    """Samples whose image is in the folder; the listing reads no file's content."""
    files = samples.sparkSession.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("file_name"))
    return samples.join(files, "file_name", "left_semi")


def question_file(spark: SparkSession, folder: str, split: str) -> str:
    """The first of the four names that a split's questions can have."""
    names = [f"{prefix}pope_{split}.{end}" for end in ("json", "jsonl") for prefix in ("coco_", "")]
    for name in names:
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"no questions of split {split!r} in {folder}; expected one of {names}")


def pope_questions(spark: SparkSession, path: str, n: int | None = None, split: str | None = None, images_dir: str = "") -> DataFrame:
    """(question_id, image_id, image_file, image_path, question, object_word, gt_label); the id defaults to the 0-based
    line. ``path`` is a file, or with ``split`` a folder. Questions of another form are left out."""
    path = question_file(spark, path, split) if split else path
    required(spark, path)
    q = numbered_lines(spark, path).select("line", F.from_json("value", QUESTIONS).alias("q")).select("line", "q.*")
    where = F.concat_ws("/", F.lit(images_dir), "image") if images_dir else F.col("image")
    q = q.select(F.coalesce("question_id", F.col("line").cast("long")).alias("question_id"), X.image_id(F.col("image")).alias("image_id"), F.col("image").alias("image_file"), where.alias("image_path"), F.col("text").alias("question"), X.object_word(F.col("text")).alias("object_word"), F.lower(X.strip(F.col("label"))).alias("gt_label"))
    return R.first_rows(q.where(F.col("object_word").isNotNull()), "question_id", n)


def caption_rows(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """(image_id, caption) of known images with a non-empty caption; an error if none is left."""
    rows = spark.read.schema("image_id long, caption string").json(path)
    out = rows.where(F.trim("caption") != "").join(samples.select("image_id"), "image_id", "left_semi")
    if out.isEmpty():
        raise ValueError(f"no caption in {path} belongs to a sample")
    return out


def json_map(spark: SparkSession, path: str, value: str, whole: bool = False) -> DataFrame:
    """(image_id, value columns) of JSON objects keyed by ids: one object a line, or with ``whole`` one over the whole
    file, which is read in splits."""
    required(spark, path)
    if whole:
        found = map_entries(spark, path, f"struct<{value}>")
        return found.select(F.col("key").try_cast("long").alias("image_id"), *[c for c in found.columns if c not in ("ord", "key")])
    maps = spark.read.text(path).select(F.from_json("value", f"map<string,struct<{value}>>").alias("m"))
    return maps.select(F.explode("m").alias("key", "v")).select(F.col("key").cast("long").alias("image_id"), "v.*")


def save_json(rows: DataFrame, path: str, key: str | None = None) -> None:
    """One JSON object a line; with ``key`` each is keyed by the row's id, as ``json_map`` reads it."""
    if key is None:
        rows.write.mode("overwrite").json(path)
        return
    value = F.struct(*[c for c in rows.columns if c != key])
    rows.select(F.to_json(F.create_map(F.col(key).cast("string"), value)).alias("value")).write.mode("overwrite").text(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Incremental sink: new rows only, never a rewrite."""
    rows.write.mode("append").parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table that may not have been written yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type, path: str):
    """``kind``: the model class of pyspark.ml; nothing is ever unpickled."""
    return kind.load(path)
