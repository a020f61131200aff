"""Exact k nearest neighbours of points of any dimension, in two rounds whatever the data.

The targets' space is divided by a k-d tree that is grown on a bounded sample of their places, so that clumps get small leaves and
outliers large ones. A point first meets the targets of its own leaf; its k-th distance there bounds the ball in which its nearest
can lie. It then meets the targets of the other leaves that its ball touches, and no others.

A leaf has at least k + 1 distinct places of targets, since it has as many of the sample. Of targets in one place only the k + 1
with the smallest ids can be among anyone's nearest; the others are left out before anything is grouped. Points are dealt into tasks of
LIMIT points at most within a leaf, so a crowded place is no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import kept

#: Places of the sample: a SHARE-th of the targets, within these bounds. The tree on the driver has no more nodes.
SHARE, LEAST, MOST = 32, 1 << 11, 1 << 20
#: Points of one task within a leaf, and pairs of points whose distances are held at once.
LIMIT, PAIRS = 20_000, 1 << 21


@dataclass
class Tree:
    """A complete binary tree: inner node i splits dimension dim[i] at split[i]; its children are 2 i + 1 and 2 i + 2."""

    dim: np.ndarray
    split: np.ndarray
    depth: int

    def leaf(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (p[np.arange(len(p)), self.dim[at]] > self.split[at])
        return at

    def touched(self, p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) of the leaves that the balls of radius r around the points touch."""
        row, at = np.arange(len(p)), np.zeros(len(p), np.int64)
        r = r * (1 + 1e-9) + 1e-300
        for _ in range(self.depth):
            gap = p[row, self.dim[at]] - self.split[at]
            left, right = gap <= r[row], gap >= -r[row]
            row, at = np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
        return row, at


def grown(places: np.ndarray, least: int) -> Tree:
    """Splits at medians of the widest dimension, as long as every leaf keeps at least `least` of the distinct places."""
    depth = 0
    while len(places) // 2 ** (depth + 1) >= least + 1:
        depth += 1
    dim, split = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    parts = {0: np.arange(len(places))}
    for i in range(2**depth - 1):
        rows = parts.pop(i)
        own = places[rows]
        spread = own.max(0) - own.min(0)
        best = None
        for d in np.argsort(-spread, kind="stable").tolist():  # a dimension with ties splits unevenly: the most even of the wide ones
            values = np.sort(own[:, d])
            cut = values[(len(values) - 1) // 2]
            low = int(np.searchsorted(values, cut, "right"))
            uneven = abs(2 * low - len(values))
            if best is None or uneven < best[0]:
                best = (uneven, d, cut)
            if uneven <= 1 or len(best) > 3:
                break
        _, d, cut = best
        dim[i], split[i] = d, cut
        right = own[:, d] > cut
        parts[2 * i + 1], parts[2 * i + 2] = rows[~right], rows[right]
    if any(len(rows) < least for rows in parts.values()) and depth:  # ties: a shallower tree
        return grown_to(places, least, depth - 1)
    return Tree(dim, split, depth)


def grown_to(places: np.ndarray, least: int, depth: int) -> Tree:
    """grown, with at most that depth."""
    return grown(places[np.lexsort(places.T[::-1])][:: max(1, len(places) // max(1, (least + 1) * 2**depth))], least) if depth else Tree(np.zeros(0, np.int64), np.zeros(0), 0)


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def closest(q: np.ndarray, t: np.ndarray, k: int, forbidden: np.ndarray | None = None, radius: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of t, distance) of the k nearest, ties in t's order. forbidden: for each q a row of t or -1."""
    out = ([], [], [])
    step = max(1, PAIRS // max(1, len(t)))
    for a in range(0, len(q), step):
        d = np.zeros((len(q[a : a + step]), len(t)))
        for c in range(q.shape[1]):
            gap = q[a : a + step, c, None] - t[:, c]
            d += gap * gap
        d = np.sqrt(d)
        if forbidden is not None:
            own = forbidden[a : a + step]
            d[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf
        if len(t) > 4 * k + 16:
            cut = np.partition(d, k - 1, axis=1)[:, k - 1]
            if radius is not None:
                cut = np.minimum(cut, radius[a : a + step])
            row, col = np.nonzero((d <= cut[:, None]) & np.isfinite(d))
        else:
            row, col = np.nonzero(np.isfinite(d) if radius is None else (d <= radius[a : a + step, None]) & np.isfinite(d))
        value = d[row, col]
        order = np.lexsort((col, value, row))
        row, col, value = row[order], col[order], value[order]
        first = np.searchsorted(row, row)
        near = np.arange(len(row)) - first < k
        for held, x in zip(out, (row[near] + a, col[near], value[near]), strict=True):
            held.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.int64, np.int64, np.float64), strict=True))


def nearest_vectors(points: DataFrame, targets: DataFrame, k: int = 1, exclude_self: bool = False, batch: str | None = None) -> DataFrame:
    """(src, dst, d, place): the k nearest targets of each point, ties by id. points, targets: (id, p array<double>[, batch]).

    With batch, only targets of the point's batch count; batches are few. A null or a NaN in a point or target is an error.
    """
    spark = points.sparkSession
    kind = points.schema["id"].dataType
    empty = spark.createDataFrame([], T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("d", T.DoubleType()), T.StructField("place", T.IntegerType())]))
    group = F.col(batch).cast("string") if batch else F.lit("")
    bad = F.exists("p", lambda x: x.isNull() | F.isnan(x)) | F.col("p").isNull()
    q, t = (df.select("id", F.col("p").cast("array<double>").alias("p"), group.alias("batch")) for df in (points, targets))
    seen = t.agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("bad"), F.max(F.size("p")).alias("dims")).first()
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} targets without complete coordinates")
    if not seen["n"]:
        return empty
    dims, n = seen["dims"], seen["n"]
    wanted = min(MOST, max(LEAST, n // SHARE))
    drawn = t if n <= wanted else t.where(F.pmod(F.xxhash64("p", "batch"), F.lit(1 << 30)) < F.lit((1 << 30) * wanted // n))
    rows = drawn.select("batch", "p").distinct().toArrow()  # about MOST rows at most
    names = rows.column("batch").to_numpy(zero_copy_only=False)
    places = matrix(rows.column("p"), dims) if len(names) else np.zeros((0, dims))
    need = k + 1
    trees = {b: grown(places[names == b], need) for b in sorted(set(names))}
    flat = Tree(np.zeros(0, np.int64), np.zeros(0), 0)

    def leafed(batches):
        for b in batches:
            p, label = matrix(b.column("p"), dims), b.column("batch").to_numpy(zero_copy_only=False)
            if not np.isfinite(p).all():
                raise ValueError("a point without complete coordinates")
            leaf = np.zeros(len(p), np.int64)
            for x in set(label):
                leaf[label == x] = trees.get(x, flat).leaf(p[label == x])
            yield pa.record_batch([*b.columns, pa.array(leaf)], [*b.schema.names, "leaf"])

    def with_leaf(df: DataFrame) -> DataFrame:
        return df.mapInArrow(leafed, T.StructType([*df.schema.fields, T.StructField("leaf", T.LongType())]))

    if k + 1 < n:  # of targets in one place, those that can be among the nearest
        t = t.withColumn("at", F.row_number().over(Window.partitionBy("batch", "p").orderBy("id"))).where(F.col("at") <= need).drop("at")
    t = with_leaf(t)
    found_type = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("d", T.DoubleType()), T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("batch", T.StringType()), T.StructField("leaf", T.LongType())])

    def met(asking: DataFrame, further: bool) -> DataFrame:
        """Candidates (src, dst, d) of asking (id, p, batch, leaf[, r]) among the targets of their leaves; if further, also where their balls go on (p, batch, leaf, d: radius)."""
        crowded = {(r["batch"], r["leaf"]): -(-r["count"] // LIMIT) for r in asking.groupBy("batch", "leaf").count().where(F.col("count") > LIMIT).collect()}  # a row for each LIMIT points at most
        if crowded:
            parts = spark.createDataFrame([(b, x, m) for (b, x), m in crowded.items()], "batch string, leaf long, parts long")
            deal = lambda df, part: df.join(F.broadcast(parts), ["batch", "leaf"], "left").withColumn("part", part).drop("parts")
            m = F.coalesce("parts", F.lit(1).cast("long"))
            asking, there = deal(asking, F.pmod(F.xxhash64("id"), m)), deal(t, F.explode(F.sequence(F.lit(0).cast("long"), m - 1)))
        else:
            asking, there = asking.withColumn("part", F.lit(0).cast("long")), t.withColumn("part", F.lit(0).cast("long"))

        def join(ask: pa.Table, have: pa.Table) -> pa.Table:
            schema = pa.schema([("src", ask.schema.field("id").type), ("dst", ask.schema.field("id").type), ("d", pa.float64()), ("p", pa.list_(pa.float64())), ("batch", pa.string()), ("leaf", pa.int64())])
            if not ask.num_rows:
                return schema.empty_table()
            have = have.take(pa.compute.sort_indices(have.column("id"))) if have.num_rows else have
            a, b = matrix(ask.column("p"), dims), matrix(have.column("p"), dims) if have.num_rows else np.zeros((0, dims))
            own = None
            if exclude_self:
                own = pa.compute.index_in(ask.column("id"), value_set=have.column("id").combine_chunks()).to_pandas().fillna(-1).to_numpy(np.int64) if have.num_rows else np.full(len(a), -1)
            row, col, d = closest(a, b, k, own, None if further else ask.column("r").to_numpy())
            blank = pa.nulls(len(row))
            ids = ask.column("id").combine_chunks()
            out = [pa.table([ids.take(pa.array(row)), have.column("id").combine_chunks().take(pa.array(col)) if have.num_rows else ids.slice(0, 0), pa.array(d), blank.cast(pa.list_(pa.float64())), blank.cast(pa.string()), blank.cast(pa.int64())], schema=schema)]
            if further:
                label, leaf = ask.column("batch")[0].as_py(), ask.column("leaf")[0].as_py()
                radius = np.full(len(a), np.inf)
                full = np.bincount(row, minlength=len(a)) >= k
                last = np.zeros(len(a))
                np.maximum.at(last, row, d)
                radius[full] = last[full]
                r, to = trees.get(label, flat).touched(a, radius)
                other = to != leaf
                r, to = r[other], to[other]
                if len(r):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(r) * dims + 1, dims), pa.int32()), pa.array(a[r].ravel()))
                    out.append(pa.table([ids.take(pa.array(r)), pa.nulls(len(r), ids.type), pa.array(radius[r]), lists, pa.array([label] * len(r), pa.string()), pa.array(to)], schema=schema))
            return pa.concat_tables(out)

        keys = ["batch", "leaf", "part"]
        return asking.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(lambda a, b: join(a, b), found_type)

    first = kept(met(with_leaf(q), True), "near")
    pairs = first.where("leaf is null").select("src", "dst", "d")
    asking = first.where("leaf is not null").select(F.col("src").alias("id"), "p", "batch", "leaf", F.col("d").alias("r"))
    if len(trees) and max(x.depth for x in trees.values()):
        pairs = pairs.union(met(asking, False).select("src", "dst", "d"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def nearest(points: DataFrame, targets: DataFrame, k: int = 1, exclude_self: bool = False, batch: str | None = None, coordinates: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """nearest_vectors of points and targets (id, x, y[, batch])."""
    p: Column = F.array(*(F.col(c).cast("double") for c in coordinates))
    own = [batch] if batch else []
    return nearest_vectors(points.select("id", p.alias("p"), *own), targets.select("id", p.alias("p"), *own), k, exclude_self, batch)
