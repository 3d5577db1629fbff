"""Append logs as streams: resumable, each key once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def follow(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New JSON-lines files of a log folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def append_new(stream: DataFrame, out: str, keys: list[str], work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Apply ``work`` to the rows whose keys the Parquet log at ``out`` lacks, and append.

    The checkpoint resumes after a stop; the anti-join makes a repeated batch harmless.
    """

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        fresh = rows.dropDuplicates(keys)
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(out)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            fresh = fresh.join(spark.read.parquet(out).select(*keys), keys, "left_anti")
        work(fresh).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_each(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; state older than ``late`` is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
