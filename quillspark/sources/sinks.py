"""File sinks: CSV, JSON lines, JSON arrays and documents, Markdown, registries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import scratch

#: Fixed value: the byte-order mark that spreadsheet programs expect.
BOM = "﻿"


def write_csv(df: DataFrame, path: str, single: bool = False, quote_empty: bool = False) -> None:
    """Header and minimal quoting, texts with the white space at their ends.

    ``single`` for reports that people open: one file, with a byte-order mark. No task has all rows:
    executors write them in parts, which the file system's own copy puts one after another.
    ``quote_empty``: an empty text is ``""``, so that it differs from an absent value.
    """
    options = {"header": True, "escape": '"', "emptyValue": '""' if quote_empty else "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if not single:
        df.write.mode("overwrite").options(**options).csv(path)
        return
    spark, parts = df.sparkSession, scratch.new_path(df.sparkSession)
    df.write.options(**options | {"header": False}).csv(parts)
    header = ",".join('"' + c.replace('"', '""') + '"' if re.search(r'[",\r\n]', c) else c for c in df.columns)
    _join(spark, parts, f"{path}/part-00000.csv", f"{BOM}{header}\n", "", replace=path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append one batch to a log; nulls are written, texts are not escaped."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def replace_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_json_document(spark: SparkSession, path: str, value: object) -> None:
    """Manifest, report or summary."""
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def write_json_array(df: DataFrame, path: str) -> None:
    """A training file that is one JSON array.

    Executors write the rows with their separators; the file system's own copy puts those
    files under one pair of brackets. No row passes through the driver's Python.
    """
    spark, parts = df.sparkSession, scratch.new_path(df.sparkSession)
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.option("lineSep", ",\n").text(parts)
    _join(spark, parts, path, "[\n", "\n]\n", "]\n", drop=2)  # the last separator stays behind


def _join(spark: SparkSession, parts: str, path: str, before: str, after: str, nothing: str = "", drop: int = 0, replace: str | None = None) -> None:
    """One file of the files that tasks wrote, in order, without the last ``drop`` bytes; ``nothing`` stands after ``before`` if they are empty.

    The file system copies; no row passes through the driver's Python. ``replace`` is deleted first, the parts at the end.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    source, target = folder.getFileSystem(conf), to.getFileSystem(conf)
    found = sorted((x.getPath().toString(), x.getLen()) for x in source.listStatus(folder) if x.getPath().getName().startswith("part-") and x.getLen())
    if replace is not None:
        target.delete(jvm.org.apache.hadoop.fs.Path(replace), True)
    out = target.create(to, True)
    try:
        out.write(bytearray(before.encode()))
        for k, (name, size) in enumerate(found):
            stream = source.open(jvm.org.apache.hadoop.fs.Path(name))
            jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, size - drop if k == len(found) - 1 else size)
            stream.close()
        out.write(bytearray((after if found else nothing).encode()))
    finally:
        out.close()
    source.delete(folder, True)


def markdown(title: str, items: Iterable[tuple[str, object]], notes: Iterable[str] = ()) -> str:
    """A heading, a list of named values, closing notes."""
    lines = [f"# {title}", "", *(f"- {name}: {value}" for name, value in items)]
    for note in notes:
        lines += ["", note]
    return "\n".join(lines) + "\n"
