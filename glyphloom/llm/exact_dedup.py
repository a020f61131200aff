"""Operator 6, exact dedup by a content sort, in DataFrame operations only.

Rows are range-partitioned, by splitters that Spark samples, on the first bytes of the normalised text and a fingerprint of
the rest; each partition is sorted, externally where it must be, by the whole bytes, and each row is compared in full with
the one before it. Only groups of copies too large for one partition carry a salt, so that splitters may fall within them:
their number is at most HOT times that of partitions, for each holds over 1/HOT of a partition's rows. The leaders of their
parts, as few, are then compared in full once more.

Nulls and ties: a null text is an empty one. Of equal texts the row with the largest (keep='max') or smallest (keep='min')
doc_id stays; null ids come last, and of rows with that same id exactly one stays. An empty table gives no rows. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, partitions, release, written

#: A group of copies is salted if it has over 1/HOT of the mean rows of a partition.
HOT = 8
#: Bytes of text in the sort key before the fingerprint.
PREFIX = 16


def exact_duplicates(docs: DataFrame, keep: str = "max", normalise=lambda text: text) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. normalise: from a text column to another."""
    spark = docs.sparkSession
    n = partitions(spark)
    best, order = (F.max, F.desc_nulls_last) if keep == "max" else (F.min, F.asc_nulls_last)
    text: Column = F.coalesce(normalise(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("row", F.monotonically_increasing_id())  # of a scan, the same each time; rows of one id are told apart by it
    counts, _ = written(rows.groupBy("h").agg(F.count("*").alias("n")), "copies")
    total = counts.agg(F.sum("n")).first()[0] or 0
    per = max(1, total // n // HOT)
    hot = counts.where(F.col("n") > per).select("h", F.ceil(F.col("n") / per).cast("long").alias("salts"))  # under HOT * n rows
    rows = rows.join(F.broadcast(hot), "h", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "row"), "salts"))).withColumn("prefix", F.substring(F.encode("t", "utf-8"), 1, PREFIX))
    dealt = rows.repartitionByRange(n, "prefix", "h", "salt")
    key = ["prefix", "h", "salt"]
    by_text = Window.partitionBy(*key).orderBy("t", order("doc_id"))
    before = F.lag("t").over(by_text)
    runs = dealt.select("doc_id", *key, F.col("salts").isNotNull().alias("hot"), F.sha2("t", 256).alias("text_sha256"), (before.isNull() | (before != F.col("t"))).cast("int").alias("new"), F.row_number().over(by_text).alias("place"))
    runs = runs.withColumn("run", F.sum("new").over(Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*key, "run")
    first = F.row_number().over(whole.orderBy("place"))
    runs = runs.select("doc_id", "h", "salt", "run", "hot", "text_sha256", best("doc_id").over(whole).alias("keep_id"), F.count("*").over(whole).alias("group_size"), first.alias("nth"))
    slim, _ = written(runs, "runs")
    release(spark)
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    kept = (F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    cold = slim.where(~F.col("hot")).withColumn("kept", kept).select(out)
    parts = slim.where("hot and nth = 1").select("h", "salt", "run", "keep_id", "group_size")  # under 2 * HOT * n rows
    if not parts.take(1):
        return cold
    ids = F.broadcast(parts.select(F.col("h").alias("h1"), F.col("keep_id").alias("id1")).distinct())
    leader = docs.select(F.col("doc_id").cast("long").alias("id2"), text.alias("t")).withColumn("h2", F.xxhash64("t")).join(ids, (F.col("h2") == F.col("h1")) & F.col("id2").eqNullSafe(F.col("id1"))).select("h2", "id2", "t").distinct()
    same = Window.partitionBy("h", "t")
    groups = parts.join(leader, (F.col("h") == F.col("h2")) & F.col("keep_id").eqNullSafe(F.col("id2"))).select("h", "salt", "run", "t", "keep_id", best("keep_id").over(same).alias("all_id"), F.sum("group_size").over(same).alias("all_size"))
    groups = groups.withColumn("at", F.min(F.when(F.col("keep_id").eqNullSafe(F.col("all_id")), F.col("salt"))).over(same))  # rows of the id that stays may have more than one salt
    groups, _ = written(groups.select("h", "salt", "run", "all_id", "all_size", "at"), "groups")
    joined = slim.where("hot").drop("keep_id", "group_size").join(F.broadcast(groups), ["h", "salt", "run"]).withColumnsRenamed({"all_id": "keep_id", "all_size": "group_size"})
    return cold.unionByName(joined.withColumn("kept", kept & (F.col("salt") == F.col("at"))).select(out))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir), keep="max")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
