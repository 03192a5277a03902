"""Shared pieces of the training-data operators: staging, words, Arrow kernels, bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at exactly these six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Documents handed to Python at once; bounds a worker's memory at batch x longest text.
BATCH_ROWS = 512

_own_dir: dict[str, str] = {}


def stage_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dir[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{stage_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unstaged(df: DataFrame) -> None:
    """Delete a staged table that no later step reads again."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def per_document(
    docs: DataFrame,
    kernel: Callable[..., dict[str, Sequence]],
    fields: list[T.StructField],
    keep: Sequence[str | Column] = ("doc_id",),
    text_col: str = "text",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Run ``kernel`` on the whole texts of a batch (null: empty), and on the ``extra`` columns if there are any;
    it returns one sequence for each field.

    Only ``keep``, the text and ``extra`` reach Python, so the scan is pruned to them and other columns can't clash.
    """
    kept = docs.select(*keep)
    slim = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), *[c.alias(f"__extra{i}") for i, c in enumerate(extra)])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kept.schema] + fields)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    n = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                got = kernel(*[b.column(i).to_pylist() for i in range(n, b.num_columns)])
                cols = [b.column(i).cast(arrow.field(i).type) for i in range(n)]
                cols += [pa.array(got[f.name], type=to_arrow_type(f.dataType)) for f in fields]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return slim.mapInArrow(run, schema)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds, F.lit(-1).cast("long"))


def bounded_sample(rows: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, chosen by a hash of the id, so that reruns and every input size draw alike."""
    return rows.orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit(7)), F.col(id_col)).limit(bound)


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, folds: int, out: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, ``more``, label): the rows of a bounded sample of labelled ids outside the held-out fold ``out``.

    Repeated labels of an id are averaged and rounded up; null ids and labels are left out. The ids are at most
    ``bound``, so they are safe to broadcast against the documents; an id can have many rows, see ``collected``.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", folds) != out))
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    )
    chosen = F.broadcast(bounded_sample(chosen, "doc_id", bound))
    return docs.select("doc_id", "text", *more).join(chosen, "doc_id")


def collected(rows: DataFrame, bound: int) -> list[Row]:
    """The distinct ``rows``, at most ``bound`` by a hash of all columns, in the order of their columns.

    What repeats counts once, and an id with any number of different texts can't fill the driver; reruns, layouts and
    numbers of partitions give the same list.
    """
    once = rows.distinct()
    return sorted(once.orderBy(F.xxhash64(*once.columns), *once.columns).limit(bound).collect())


def join_known(rows: DataFrame, known: DataFrame, key: str, hot: DataFrame, most: int = 1024) -> DataFrame:
    """``rows`` joined with ``known`` (one row for each ``key``), without a task that holds all rows of a frequent key.

    ``hot``: keys with many rows, at most ``most`` of them by how they were chosen; their part of ``known`` is broadcast.
    """
    hot = F.broadcast(hot.select(key).limit(most))
    often = rows.join(F.broadcast(known.join(hot, key, "left_semi")), key)
    return often.unionByName(rows.join(hot, key, "left_anti").join(known, key))
