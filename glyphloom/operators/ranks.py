"""Exact quantiles and rank correlations of whole tables, without one task that holds all values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, kept

#: Values that are sorted on the driver once a quantile has been narrowed down to them.
SMALL = 200_000


def quantiles(table: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation. Each pass divides the values at two approximate quantiles around the one that is asked for,
    counts the parts and goes on with the part that holds it, down to SMALL values or to one value, whatever ties there are."""
    values = table.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n = values.count()
    if not n:
        return [None] * len(shares)
    if n <= SMALL:
        found = sorted(r["v"] for r in values.collect())
        return [_between(found[math.floor((n - 1) * q)], found[math.ceil((n - 1) * q)], (n - 1) * q) for q in shares]
    held = kept(values, "values")
    try:
        return [_narrowed(held, n, q) for q in shares]
    finally:
        discard(held)


def _between(low: float, high: float, at: float) -> float:
    return low if low == high else low + (high - low) * (at - math.floor(at))


def _narrowed(values: DataFrame, n: int, share: float) -> float:
    at = (n - 1) * share
    low = _placed(values, n, math.floor(at))
    seen = values.agg(F.count(F.when(F.col("v") <= low, 1)).alias("upto"), F.min(F.when(F.col("v") > low, F.col("v"))).alias("above")).first()
    return _between(low, low if seen["upto"] > math.ceil(at) else seen["above"], at)


def _placed(part: DataFrame, n: int, place: int, margin: float = 0.01) -> float:
    """The value at a place, from 0, of n values in order. low and high are values of the part and leave it, so every pass makes it smaller."""
    v = F.col("v")
    while n > SMALL:
        own = place / (n - 1)
        low, high = part.approxQuantile("v", [max(0.0, own - margin), min(1.0, own + margin)], margin / 4)
        pieces = ((v < low, None), (v == low, low), ((v > low) & (v < high), None), ((v == high) & (v > low), high), (v > high, None))
        for n, (where, value) in zip(part.agg(*(F.count(F.when(where, 1)) for where, _ in pieces)).first(), pieces, strict=True):
            if place < n:
                break
            place -= n
        if value is not None:
            return value
        part = part.where(where)
    return sorted(r["v"] for r in part.collect())[place]


def average_ranks(table: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """table with the average rank of value, ties alike. Ranges of distinct values are counted first, so no task sorts the whole table:
    ranks are running sums over distinct values within ranges, after the counts of the ranges below. The table is written first, since
    values that are computed twice may differ in their last digit and then miss their rank."""
    spark, table = table.sparkSession, kept(table, "ranked")
    distinct = table.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("times"))
    placed = kept(distinct.repartitionByRange("__v").withColumn("part", F.spark_partition_id()), "ranges")
    total, before = 0, []
    for r in placed.groupBy("part").agg(F.sum("times").alias("n")).orderBy("part").collect():  # a row for each partition
        before.append((r["part"], total))
        total += r["n"]
    starts = spark.createDataFrame(before, "part int, before long")
    running = F.sum("times").over(Window.partitionBy("part").orderBy("__v"))
    ranks = placed.join(F.broadcast(starts), "part").select("__v", (F.col("before") + running - (F.col("times") - 1) / 2).alias(name))
    return table.join(ranks, F.col(value) == F.col("__v")).drop("__v")


def numbered(table: DataFrame, by: str, name: str = "ord") -> DataFrame:
    """table with its rows' places, from 0, in order of a column without ties. Ranges are counted first; no task sorts the whole table."""
    placed = kept(table.repartitionByRange(by).withColumn("__part", F.spark_partition_id()), "ranges")
    total, before = 0, []
    for r in placed.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():  # a row for each partition
        before.append((r["__part"], total))
        total += r["n"]
    starts = table.sparkSession.createDataFrame(before, "__part int, __before long")
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__part").orderBy(by)) - 1
    return placed.join(F.broadcast(starts), "__part").withColumn(name, place).drop("__part", "__before")
