"""Intermediate tables in a folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session without it uses its warehouse folder, which is shared too."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"


def new_path(spark: SparkSession) -> str:
    """A path of this session's own; what is there goes when the session ends."""
    path = f"{folder(spark)}/t-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


#: Rows of a few columns that may go to every executor, once they are counted.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """``df`` written, and broadcast if it is counted to have few rows; what it joins with is then not shuffled."""
    df = df if getattr(df, "_scratch_path", None) else cut(df)
    return F.broadcast(df) if df.count() <= FEW else df


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that nothing reads any more."""
    if path := getattr(df, "_scratch_path", None):
        _delete(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may have ended already
            _delete(spark, path)
