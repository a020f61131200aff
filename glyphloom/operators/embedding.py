"""Principal components, projections and mixes of per-cell vectors, and corrections of them by batch.

Vectors are columns of arrays: (cell, v array<double>). Loadings, means and centres have one row for each feature and stay on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as sc
from .nearest import matrix
from .shared import discard, kept


def vectors(values: DataFrame, features: Sequence[str], cells: DataFrame) -> DataFrame:
    """(cell, v) over the features in their order, absent entries as zeros, for every cell. values: (cell, gene, value)."""
    spark, n = values.sparkSession, len(features)
    index = F.broadcast(spark.createDataFrame([(g, i) for i, g in enumerate(features)], "gene string, gi int"))
    rows = values.join(index, "gene").groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("gi", F.col("value").cast("double")))).alias("m"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, m = np.zeros((len(b), n)), b.column("m")
            of = np.repeat(np.arange(len(b)), [len(x) if x.is_valid else 0 for x in m])
            live = m.drop_null()
            if len(of):
                y[of, live.keys.to_numpy()[live.offsets[0].as_py() : live.offsets[-1].as_py()]] = live.items.to_numpy(zero_copy_only=False)[live.offsets[0].as_py() : live.offsets[-1].as_py()]
            yield pa.record_batch([b.column("cell"), pa.array(list(y), pa.list_(pa.float64()))], ["cell", "v"])

    kind = cells.schema["cell"].dataType.simpleString()
    return cells.select("cell").join(rows, "cell", "left").mapInArrow(dense, f"cell {kind}, v array<double>")


@dataclass
class Components:
    """loadings: features x components, the largest of each component positive; mean of the features; share of the variance."""

    loadings: np.ndarray
    mean: np.ndarray
    share: np.ndarray

    def applied(self, rows: DataFrame, centre: bool = True, name: str = "v") -> DataFrame:
        """rows with `name` as its projection."""
        return multiplied(rows, self.loadings, self.mean if centre else np.zeros(len(self.mean)), name)


def multiplied(rows: DataFrame, weights: np.ndarray, mean: np.ndarray, name: str = "v") -> DataFrame:
    at = rows.columns.index(name)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = (matrix(b.column(name), len(mean)) - mean) @ weights
            columns = list(b.columns)
            columns[at] = pa.array(list(y), pa.list_(pa.float64()))
            yield pa.record_batch(columns, b.schema.names)

    return rows.mapInArrow(project, T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == name else f.dataType) for f in rows.schema.fields]))


def principal(rows: DataFrame, n: int, name: str = "v") -> Components:
    """The first n principal components (fewer than rows and features allow) of centred vectors."""
    size = rows.select(F.size(name).alias("p")).first()
    p, m = (size["p"] if size else 0), rows.count()
    k = max(1, min(n, m - 1, p))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(rows.select(array_to_vector(name).alias("x")))
    loadings = model.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
    means = rows.select(F.posexplode(name).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()  # a row for each feature
    mean = np.zeros(p)
    for r in means:
        mean[r["i"]] = r["m"]
    return Components(loadings * np.where(sign == 0, 1, sign), mean, model.explainedVariance.toArray())


def column_deviations(rows: DataFrame, name: str = "v") -> np.ndarray:
    """The deviation (ddof 0) of each component, 1e-12 at least."""
    found = rows.select(F.posexplode(name).alias("i", "x")).groupBy("i").agg(F.stddev_pop("x").alias("s")).collect()
    out = np.zeros(len(found))
    for r in found:
        out[r["i"]] = r["s"]
    return np.maximum(out, 1e-12)


def by_deviation(rows: DataFrame, name: str = "v") -> DataFrame:
    s = column_deviations(rows, name)
    return multiplied(rows, np.diag(1 / s), np.zeros(len(s)), name)


def by_length(rows: DataFrame, name: str = "v") -> DataFrame:
    return rows.withColumn(name, sc.l2_normalised(F.col(name)))


def mixed(identity: DataFrame, context: DataFrame, share: float) -> DataFrame:
    """(cell, v): both vectors of a cell, weighed by the roots of 1 - share and share."""
    if not 0 <= share <= 1:
        raise ValueError("the share must be within 0 and 1")
    both = identity.select("cell", F.col("v").alias("a")).join(context.select("cell", F.col("v").alias("b")), "cell")
    return both.select("cell", sc.mixed_embedding(F.col("a"), F.col("b"), share).alias("v"))


def harmonised(rows: DataFrame, batch: str = "batch", clusters: int | None = None, theta: float = 2.0, ridge: float = 1.0, sigma: float = 0.1, rounds: int = 6, inner: int = 4, tol: float = 1e-4, seed: int = 0) -> DataFrame:
    """rows (cell, batch, v) with v corrected for batches by soft clusters (Korsunsky et al. 2019).

    Cells have cosine-normalised places and shares in clusters that favour a mixture of batches; in each cluster a ridge regression on batches
    takes their offsets away. Cells stay distributed: a round reads them once for the sums over clusters and batches.
    """
    spark = rows.sparkSession
    labels = sorted(str(r[0]) for r in rows.select(F.col(batch).cast("string")).distinct().collect())
    n_of = {r[0]: r[1] for r in rows.groupBy(F.col(batch).cast("string")).count().collect()}
    n, b_n = sum(n_of.values()), len(labels)
    if b_n < 2:
        return rows
    dims = rows.select(F.size("v")).first()[0]
    k = clusters or max(2, min(100, round(n / 30)))
    freq = np.array([n_of[b] / n for b in labels])
    sample = rows.select("v").orderBy(F.xxhash64(F.col("cell").cast("string"), F.lit(seed))).limit(max(4 * k, 2000)).toArrow()
    z = matrix(sample.column("v"), dims)
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    centres = z[np.random.default_rng(seed).choice(len(z), k, replace=len(z) < k)]
    for _ in range(20):
        own = (z @ centres.T).argmax(1)
        centres = np.stack([z[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    offsets = np.zeros((k, b_n, dims))
    observed = np.full((k, b_n), n / k) * freq
    held = kept(rows.withColumn("__batch", F.col(batch).cast("string")), "cells")
    code = {b: i for i, b in enumerate(labels)}

    def shares(original: np.ndarray, at: np.ndarray, state) -> tuple[np.ndarray, np.ndarray]:
        """Shares of cells in clusters, and corrected places, from the round's state."""
        centres_, offsets_, observed_ = state
        expected = observed_.sum(1, keepdims=True) * freq
        weight = ((expected + 1) / (observed_ + 1)) ** theta

        def soft(p: np.ndarray) -> np.ndarray:
            p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
            d = 2 * (1 - p @ centres_.T)
            r = np.exp(-(d - d.min(1, keepdims=True)) / sigma) * weight[:, at].T
            return r / np.maximum(r.sum(1, keepdims=True), 1e-300)

        r = soft(original)
        for _ in range(2):  # the correction depends on the shares, and these on the corrected place
            place = original - np.einsum("nk,knd->nd", r, offsets_[:, at])
            r = soft(place)
        return r, original - np.einsum("nk,knd->nd", r, offsets_[:, at])

    def sums(state) -> dict[str, np.ndarray]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            o, s, c, cost = np.zeros((k, b_n)), np.zeros((k, b_n, dims)), np.zeros((k, dims)), 0.0
            for b in batches:
                original = matrix(b.column("v"), dims)
                at = np.array([code[x] for x in b.column("__batch").to_pylist()], int)
                if not len(at):
                    continue
                r, place = shares(original, at, state)
                unit = place / np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-12)
                c += r.T @ unit
                cost += float((r * 2 * (1 - unit @ state[0].T)).sum())
                for x in range(b_n):
                    own = at == x
                    o[:, x] += r[own].sum(0)
                    s[:, x] += r[own].T @ original[own]
            yield pa.record_batch([pa.array([np.concatenate([o.ravel(), s.ravel(), c.ravel(), [cost]]).tolist()], pa.list_(pa.float64()))], ["x"])

        total = held.select("v", "__batch").mapInArrow(partial, "x array<double>").select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
        cut = np.cumsum([k * b_n, k * b_n * dims, k * dims])
        return {"o": total[: cut[0]].reshape(k, b_n), "s": total[cut[0] : cut[1]].reshape(k, b_n, dims), "c": total[cut[1] : cut[2]].reshape(k, dims), "cost": total[cut[2]]}

    last = np.inf
    for _ in range(rounds):
        for _ in range(inner):  # shares and centres settle before each correction; halfway steps keep batches from swapping clusters
            found = sums((centres, offsets, observed))
            observed = (observed + found["o"]) / 2
            centres = found["c"] / np.maximum(np.linalg.norm(found["c"], axis=1, keepdims=True), 1e-12)
        for c in range(k):  # ridge regression of places on an intercept and the batches; the intercept isn't shrunk
            design = np.zeros((b_n + 1, b_n + 1))
            share = found["o"][c]
            design[0, 0], design[0, 1:], design[1:, 0] = share.sum(), share, share
            design[1:, 1:] = np.diag(share + ridge)
            right = np.vstack([found["s"][c].sum(0), found["s"][c]])
            offsets[c] = np.linalg.lstsq(design, right, rcond=None)[0][1:]
        if abs(last - found["cost"]) <= tol * abs(found["cost"]):
            break
        last = found["cost"]
    state = (centres, offsets, observed)

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array([code[x] for x in b.column("__batch").to_pylist()], int)
            columns = list(b.columns)
            if len(at):
                columns[b.schema.names.index("v")] = pa.array(list(shares(matrix(b.column("v"), dims), at, state)[1]), pa.list_(pa.float64()))
            yield pa.record_batch(columns, b.schema.names)

    out = kept(held.mapInArrow(correct, held.schema).drop("__batch"), "corrected")
    discard(held)
    return spark.read.schema(out.schema).parquet(out.kept_at)
