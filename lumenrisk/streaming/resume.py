"""Resumable item processing as a file-source stream: new files only, each id once, each batch's results exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import pending
from ..sources.readers import read_or_empty

#: The column that holds a batch's number; each batch is a folder of that name and number.
BATCH = "batch"


def process_new(spark: SparkSession, source: str, schema: T.StructType | str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "image_id") -> StreamingQuery:
    """Run ``work`` on the rows of files not seen yet; a rerun goes on where the last one ended.

    A batch writes its rows and then its ids, each to the folder of its own number, in place of what an earlier attempt
    left there; ids of other batches alone count as done. So a batch that is tried again, wherever it broke off, gives
    the same rows once. The ids' folder is the commit: ``committed`` shows the rows of no batch without it. Ids that
    were worked on before are left out in each batch, whether they gave rows or not.
    """
    done_path = _done(target)
    ids = T.StructType([f for f in (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)) if f.name == key] + [T.StructField(BATCH, T.LongType())])

    def batch(rows: DataFrame, number: int) -> None:
        done = read_or_empty(spark, done_path, ids).where(F.col(BATCH) != number)
        fresh = pending(rows.dropDuplicates([key]), done, key).persist()
        try:
            work(fresh).write.mode("overwrite").parquet(f"{target.rstrip('/')}/{BATCH}={number}")
            fresh.select(key).write.mode("overwrite").parquet(f"{done_path}/{BATCH}={number}")
        finally:
            fresh.unpersist()

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _done(target: str) -> str:
    return f"{target.rstrip('/')}-done"


def committed(spark: SparkSession, target: str) -> DataFrame:
    """The rows of ``target`` whose batches have ended, without the number of the batch."""
    whole = spark.read.parquet(_done(target)).select(BATCH).distinct()
    return spark.read.parquet(target).join(whole, BATCH, "left_semi").drop(BATCH)
