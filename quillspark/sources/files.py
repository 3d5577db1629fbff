"""File sources: CSV, JSON arrays, JSON lines, Parquet, dataset registries."""

from __future__ import annotations

import json
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillspark import schemas
from quillspark.sources import scratch


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system Spark knows exists."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, absent: tuple[str, ...] = ()) -> DataFrame:
    """All columns as strings: header, doubled quotes, line breaks in quotes, byte-order mark; empty fields stay empty.

    In the columns ``absent`` a field without quotes and text is null; ``""`` is empty there too.
    """
    # Spark takes a text equal to the null value for null: one that no file holds
    options = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8", "enforceSchema": False, "nullValue": f"absent-{uuid.uuid4().hex}"}
    header = spark.read.options(**options, inferSchema=False).csv(path)
    if schema is not None:
        wanted = [f.name for f in schema.fields]
        header = header.select(*(F.col(f"`{c}`") if c in header.columns else F.lit(None).cast("string").alias(c) for c in wanted))
        present = [c for c in wanted if c in header.columns]
    else:
        present = header.columns
    return header.na.fill("", subset=[c for c in present if c not in absent and isinstance(header.schema[c].dataType, StringType)])


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A file that is one JSON array of objects."""
    return spark.read.schema(schema).options(multiLine=True, mode="FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines: blank lines skipped, a missing path is empty; a malformed line fails the job and is named with its file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    marked = StructType([*schema.fields, StructField("_malformed", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_file", F.input_file_name())
    parsed = lines.select("value", "_file", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}).alias("r"))
    fault = F.raise_error(F.concat(F.lit("malformed line in "), "_file", F.lit(": "), F.substring("value", 1, 200)))
    whole = F.when(F.col("r").isNull() | F.col("r._malformed").isNotNull(), fault.cast(schema)).otherwise(F.struct(*(F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields)))
    return parsed.select(whole.alias("r")).where("r IS NOT NULL").select("r.*")


def read_source(spark: SparkSession, path: str, schema: StructType = schemas.SOURCE) -> DataFrame:
    """Dispatch on the suffix: .csv, .json, .jsonl or .parquet."""
    match PurePosixPath(path).suffix.lower():
        case ".csv":
            return read_csv(spark, path, schema)
        case ".json":
            return read_json_array(spark, path, schema)
        case ".jsonl":
            return read_jsonl(spark, path, schema)
        case ".parquet":
            return spark.read.parquet(path)
        case other:
            raise ValueError(f"no reader for {other or path!r}: CSV, JSON, JSON lines or Parquet")


def with_position(df: DataFrame, name: str = "source_row") -> DataFrame:
    """Number the rows of a scan in file order from 0.

    Rows are counted by partition, and a partition's rows start behind those of the ones before it:
    each partition numbers its own, in order, and only the counts meet (one row a partition).
    """
    return numbered(df.withColumn("_id", F.monotonically_increasing_id()), name)


def in_order(df: DataFrame, *keys: str, name: str) -> DataFrame:
    """Number the rows of a table by ``keys`` from 0: sorted by ranges and written, so that no task sorts all."""
    return numbered(scratch.cut(df.orderBy(*keys).withColumn("_id", F.monotonically_increasing_id())), name)


def numbered(marked: DataFrame, name: str) -> DataFrame:
    """Rows with rising ids ``_id`` (partition and place in it) numbered without gaps."""
    part = F.shiftright("_id", 33)
    counts = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    placed = marked.join(F.broadcast(counts), part == F.col("_p"))
    return placed.withColumn(name, (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("int")).drop("_id", "_p", "_before")


def read_registry(spark: SparkSession, path: str) -> dict:
    """A dataset registry: one small JSON object."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return json.loads(text)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    """Inline rows: few-shot examples, default questions, stage names."""
    return spark.createDataFrame(rows, schema)
