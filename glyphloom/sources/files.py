"""Small files read on the driver through Spark's file systems, and text files whose lines need their numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return bool(fs.exists(p))


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    fs, p = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def parent(folder: str, up: int = 1) -> str:
    for _ in range(up):
        folder = folder.rstrip("/").rpartition("/")[0]
    return folder


def name_of(folder: str) -> str:
    return folder.rstrip("/").rpartition("/")[2]


def text(spark: SparkSession, path: str) -> str:
    """A whole small file."""
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def json_file(spark: SparkSession, path: str) -> dict:
    """A small JSON file; {} where there is none."""
    return json.loads(text(spark, path)) if exists(spark, path) else {}


def lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small file that aren't empty."""
    return [x for x in text(spark, path).replace("\r", "").split("\n") if x]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, line): the lines of one text file, counted from 0 in the file's order. Splits are counted first, so no task reads the whole file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            at = []
            for x in b.column("block").to_pylist():
                at.append(seen.get(x, 0))
                seen[x] = at[-1] + 1
            yield pa.record_batch([b.column("value"), b.column("block"), pa.array(at, pa.int64())], ["line", "block", "at"])

    rows = raw.mapInArrow(counted, "line string, block long, at long")
    sizes = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}  # a row for each split
    before, starts = 0, []
    for block in sorted(sizes):
        starts.append((block, before))
        before += sizes[block]
    first = spark.createDataFrame(starts, "block long, before long")
    return rows.join(F.broadcast(first), "block").select((F.col("before") + F.col("at")).alias("i"), "line")


def first_line(spark: SparkSession, path: str, comment: str | None = None) -> str | None:
    """The first line of a text file that is no comment."""
    rows = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0)
    rows = rows.where(~F.col("value").startswith(comment)) if comment else rows
    found = rows.select("value").head(1)  # of the first split, whose lines are in order
    return found[0]["value"] if found else None
