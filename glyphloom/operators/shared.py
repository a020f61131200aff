"""Tables that plans keep between their stages, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own on a local master, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if master not in _OWN:
        _OWN[master] = tempfile.mkdtemp(prefix="glyphloom-")
        atexit.register(shutil.rmtree, _OWN[master], ignore_errors=True)
    return _OWN[master]


_OWN: dict[str, str] = {}


def kept(df: DataFrame, what: str) -> DataFrame:
    """df, written and read again: lineage ends there, and lost executors cost nothing that has been written."""
    path = f"{shared_dir(df.sparkSession)}/glyphloom/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes what kept() wrote for these frames, once nothing reads them any more."""
    for df in frames:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
