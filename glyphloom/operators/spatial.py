"""Spatial queries as DataFrame plans: label distances, kernel weights, neighbourhood features, density clusters, slices, colonies."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest import grown, nearest
from .shared import discard, kept

#: Largest extent, in micrometres, that a section is expected to have.
SECTION_UM = 7000.0


def distance(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.sqrt((F.col(ax) - F.col(bx)) * (F.col(ax) - F.col(bx)) + (F.col(ay) - F.col(by)) * (F.col(ay) - F.col(by)))


# Distances to a label


def scale_factors(factors: dict[str, float], mpp: float | None = None, hires_scale: float | None = None) -> tuple[float, float | None]:
    """Micrometres per pixel and the scale of the small image: what is given, else what the library's factors have."""
    mpp = mpp if mpp is not None else factors.get("microns_per_pixel")
    if mpp is None or not math.isfinite(mpp) or mpp <= 0:
        raise ValueError("microns_per_pixel must be a positive number")
    hires_scale = hires_scale if hires_scale is not None else factors.get("tissue_hires_scalef", factors.get("regist_target_img_scalef"))
    if hires_scale is not None and (not math.isfinite(hires_scale) or hires_scale <= 0):
        raise ValueError("hires_scale must be a positive number")
    return float(mpp), None if hires_scale is None else float(hires_scale)


def coordinate_system(extent: float | None, mpp: float, hires_scale: float | None) -> str:
    """'hires' or 'fullres': the one in which the extent is that of a section, else by the scale, with a warning."""
    if hires_scale is None or hires_scale >= 0.99:
        return "fullres"
    if extent is None or not math.isfinite(extent) or extent <= 0:
        warnings.warn("coordinates without extent are taken as full resolution", stacklevel=2)
        return "fullres"
    full, small = extent * mpp <= SECTION_UM, extent * mpp / hires_scale <= SECTION_UM
    if full != small:
        return "fullres" if full else "hires"
    guess = "hires" if hires_scale < 0.5 else "fullres"
    warnings.warn(f"the resolution of the coordinates is not clear; {guess} is assumed", stacklevel=2)
    return guess


def label_distance(obs: DataFrame, label: str, mpp: float = 1.0, hires_scale: float | None = None, system: str | None = None) -> DataFrame:
    """(id, d_px, d_um): distance of every cell to the nearest of a label. obs: (id, x, y, label).

    system: 'fullres', 'hires' or 'auto'; without it the small image's scale is used where it is given.
    """
    if system not in (None, "auto", "fullres", "hires"):
        raise ValueError(f"unknown coordinate system {system}")
    if system == "hires" and hires_scale is None:
        raise ValueError("hires coordinates need hires_scale")
    targets = obs.where(F.col("label") == label).select("id", "x", "y")
    if not targets.take(1):
        raise ValueError(f"no cell has the label {label}")
    if system == "auto":
        box = obs.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
        system = coordinate_system(max(box["w"], box["h"]), mpp, hires_scale)
    scale = 1.0 if system == "fullres" else (hires_scale or 1.0)
    near = nearest(obs.select("id", "x", "y"), targets)
    return near.select(F.col("src").alias("id"), F.col("d").alias("d_px"), (F.col("d") * (mpp / scale)).alias("d_um"))


# Neighbourhood graphs


def kernel_weights(points: DataFrame, k: int, batch: str | None = None) -> DataFrame:
    """(src, dst, w, d): exp(-(d / r)^2) over the k nearest of the batch, r the k-th positive distance (the last if fewer; 1 if none),
    summing to 1 per src; equal weights where that sum is 0. A cell alone in its batch has an edge of weight 1 to itself."""
    edges = nearest(points, points, k, exclude_self=True, batch=batch).select("src", "dst", "d")
    own = Window.partitionBy("src")
    r = F.coalesce(F.max(F.when(F.col("d") > 0, F.col("d"))).over(own), F.lit(1.0))
    raw = edges.withColumn("raw", F.exp(-(F.col("d") / r) * (F.col("d") / r))).withColumn("total", F.sum("raw").over(own)).withColumn("n", F.count("*").over(own))
    weights = raw.select("src", "dst", F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(1 / F.col("n")).alias("w"), "d")
    lone = points.groupBy(*([batch] if batch else [])).agg(F.count("*").alias("n"), F.min("id").alias("src")).where("n = 1")
    return weights.unionByName(lone.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w"), F.lit(0.0).alias("d")))


def graph_distances(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", (1 - F.col("w")).alias("distance"))


def truncated(edges: DataFrame, k: int) -> DataFrame:
    """The k largest weights of each source, summing to 1 again."""
    kept_ = edges.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("place") <= k)
    return kept_.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("w"))


def neighbourhood_mean(edges: DataFrame, counts: DataFrame) -> DataFrame:
    """(cell, gene, value): weighted sum over neighbours. counts: (cell, gene, value)."""
    return edges.join(counts, edges.dst == counts.cell).groupBy(F.col("src").alias("cell"), "gene").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def offsets(edges: DataFrame, points: DataFrame) -> DataFrame:
    """edges with dx and dy from src to dst."""
    a = points.select(F.col("id").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = points.select(F.col("id").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return edges.join(a, "src").join(b, "dst").withColumn("dx", F.col("bx") - F.col("ax")).withColumn("dy", F.col("by") - F.col("ay")).drop("ax", "ay", "bx", "by")


def directional_weights(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Weights times the cosine of the direction, over the sum of their sizes (1 if that is 0)."""
    turned = offsets(edges, points).withColumn("wc", F.col("w") * F.cos(F.atan2("dy", "dx")))
    size = F.sum(F.abs("wc")).over(Window.partitionBy("src"))
    return turned.select("src", "dst", (F.col("wc") / F.when(size > 0, size).otherwise(1.0)).alias("w"))


def slopes(edges: DataFrame, points: DataFrame, counts: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """(cell, gene, value): steepness of the plane fitted to a gene over a cell's neighbours (ridge on all three coefficients, equal
    weights); 0 for cells with under three neighbours. Genes that no neighbour shows are left out (their slope is 0).

    The plane's normal equations need sums over edges only: six of a cell's, three more for each gene.
    """
    moved = offsets(edges, points)
    a = moved.groupBy("src").agg(F.count("*").alias("n"), *(F.sum(e).alias(name) for e, name in ((F.col("dx"), "sx"), (F.col("dy"), "sy"), (F.col("dx") * F.col("dx"), "sxx"), (F.col("dx") * F.col("dy"), "sxy"), (F.col("dy") * F.col("dy"), "syy"))))
    y = moved.join(counts, moved.dst == counts.cell).groupBy("src", "gene").agg(F.sum("value").alias("t"), F.sum(F.col("dx") * F.col("value")).alias("tx"), F.sum(F.col("dy") * F.col("value")).alias("ty"))
    n, xx, yy, x, y_, xy = F.col("n") + ridge, F.col("sxx") + ridge, F.col("syy") + ridge, F.col("sx"), F.col("sy"), F.col("sxy")
    det = n * (xx * yy - xy * xy) - x * (x * yy - xy * y_) + y_ * (x * xy - xx * y_)
    bx = (-(x * yy - xy * y_) * F.col("t") + (n * yy - y_ * y_) * F.col("tx") - (n * xy - x * y_) * F.col("ty")) / det
    by = ((x * xy - xx * y_) * F.col("t") - (n * xy - x * y_) * F.col("tx") + (n * xx - x * x) * F.col("ty")) / det
    return y.join(a, "src").select(F.col("src").alias("cell"), "gene", F.when(F.col("n") >= 3, F.sqrt(bx * bx + by * by)).otherwise(0.0).alias("value"))


def neighbourhood_gradient(edges: DataFrame, points: DataFrame, counts: DataFrame, mode: str = "cosphi", k: int | None = None, ridge: float = 1e-6) -> DataFrame:
    """(cell, gene, value) of the directional mean ('cosphi') or the fitted slope ('regression') over the k heaviest edges."""
    edges = truncated(edges, k) if k is not None else edges
    if mode.lower() == "cosphi":
        return neighbourhood_mean(directional_weights(edges, points), counts)
    if mode.lower() == "regression":
        return slopes(edges, points, counts, ridge)
    raise ValueError(f"unknown gradient {mode}")


def neighbourhood_features(points: DataFrame, counts: DataFrame, k: int = 15, batch: str | None = None, gradient: str | None = None, k_gradient: int | None = None) -> DataFrame:
    """(cell, kind, gene, value): kind 'M' for the weighted mean, 'G' for the gradient over the k_gradient (2 k) nearest."""
    edges = kept(kernel_weights(points, k, batch), "edges")
    out = neighbourhood_mean(edges, counts).select("cell", F.lit("M").alias("kind"), "gene", "value")
    if gradient:
        wide = k_gradient or 2 * k
        far = edges if wide <= k else kept(kernel_weights(points, wide, batch), "edges")
        out = out.unionByName(neighbourhood_gradient(far, points, counts, gradient).select("cell", F.lit("G").alias("kind"), "gene", "value"))
    return out


# Components and density clusters


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): smallest node that links (u, v) reach, by neighbours' labels and labels of labels, until none changes."""
    both = kept(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "links")
    labels = kept(nodes.select("node", F.col("node").alias("label")).distinct(), "labels")
    while True:
        labels_ = labels.select("node", "label")
        near = both.join(labels_, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        new = labels_.join(near, F.col("node") == F.col("u"), "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was"))
        hop = new.select(F.col("node").alias("at"), F.col("label").alias("to"))
        done = kept(new.join(hop, F.col("label") == F.col("at")).select("node", F.col("to").alias("label"), "was"), "labels")
        over = not done.where("label <> was").take(1)
        discard(labels)
        if over:
            discard(both)
            return done.select("node", F.col("label").alias("component"))
        labels = done


def _cell_steps() -> Column:
    """Cells, of those with a diagonal of eps, that a point within eps can be in."""
    return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4))


def density_clusters(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(id, cluster): DBSCAN. Cluster is the smallest core id it holds; null for noise. A border point joins the smallest cluster with a core within eps.

    Cells have a diagonal of eps, so all points of a cell are within eps of each other: a cell with min_samples points is all core
    without a comparison, and cores of one cell are one cluster. Only points of cells with fewer count their neighbours, and only
    cells are linked, each pair by its closest cores (equal places count once).
    """
    side = eps / math.sqrt(2)
    cells = kept(points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side)), "cells")
    full = cells.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    sparse = cells.join(full, ["cx", "cy"]).where(F.col("n") < min_samples).drop("n")
    ids = dict(cells.dtypes)["id"]

    def looks(df: DataFrame) -> DataFrame:
        return df.withColumn("step", F.explode(_cell_steps())).select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"), (F.col("cx") + F.col("step.i")).alias("cx"), (F.col("cy") + F.col("step.j")).alias("cy"))

    within = (F.col("ux") - F.col("x")) * (F.col("ux") - F.col("x")) + (F.col("uy") - F.col("y")) * (F.col("uy") - F.col("y")) <= eps * eps
    counted = looks(sparse).join(cells, ["cx", "cy"]).where(within).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples)
    cores = kept(cells.join(full, ["cx", "cy"]).where(F.col("n") >= min_samples).drop("n").unionByName(sparse.join(counted, F.col("id") == F.col("u"), "left_semi")), "cores")
    names = cores.groupBy("cx", "cy").agg(F.min("id").alias("name"))
    places = cores.select("cx", "cy", "x", "y").distinct()
    # towards the cells later in order, a core is sent only where it is within eps of their square
    ahead = F.expr("step.i > 0 or (step.i = 0 and step.j > 0)")
    to = [F.col(f"c{a}") + F.col(f"step.{s}") for a, s in (("x", "i"), ("y", "j"))]
    sent = places.withColumn("step", F.explode(_cell_steps())).where(ahead).select("x", "y", F.col("cx").alias("ax"), F.col("cy").alias("ay"), to[0].alias("bx"), to[1].alias("by"))
    back = places.withColumn("step", F.explode(_cell_steps())).where(ahead).select("x", "y", (F.col("cx") - F.col("step.i")).alias("ax"), (F.col("cy") - F.col("step.j")).alias("ay"), F.col("cx").alias("bx"), F.col("cy").alias("by"))

    def near_square(cx: str, cy: str) -> Column:
        gap = [F.greatest(F.col(c) * side - F.col(v), F.col(v) - (F.col(c) + 1) * side, F.lit(0.0)) for c, v in ((cx, "x"), (cy, "y"))]
        return gap[0] * gap[0] + gap[1] * gap[1] <= eps * eps * (1 + 1e-9)

    def linked(a: pa.Table, b: pa.Table) -> pa.Table:
        keys = ["ax", "ay", "bx", "by"]
        kind = pa.schema([(k, pa.int64()) for k in keys])
        if not a.num_rows or not b.num_rows:
            return kind.empty_table()
        p, q = (np.stack([t.column(c).to_numpy() for c in "xy"], 1) for t in (a, b))
        close = False
        if len(p) * len(q) <= 1 << 22:
            d = p[:, None] - q
            close = bool(((d * d).sum(2) <= eps * eps).any())
        else:  # a tree over the larger side; each place of the other meets the leaves that its ball touches
            p, q = (p, q) if len(p) <= len(q) else (q, p)
            tree = grown(q, 64)
            leaf = tree.leaf(q)
            order = np.argsort(leaf, kind="stable")
            bounds = np.searchsorted(leaf[order], np.arange(2**tree.depth) + 2**tree.depth - 1)
            bounds = np.append(bounds, len(q))
            for at in range(0, len(p), 256):
                row, to_ = tree.touched(p[at : at + 256], np.full(len(p[at : at + 256]), eps))
                for r, x in zip(row.tolist(), (to_ - 2**tree.depth + 1).tolist(), strict=True):
                    d = q[order[bounds[x] : bounds[x + 1]]] - p[at + r]
                    if ((d * d).sum(1) <= eps * eps).any():
                        close = True
                        break
                if close:
                    break
        return pa.table([pa.array([a.column(k)[0].as_py()], pa.int64()) for k in keys], schema=kind) if close else kind.empty_table()

    keys = ["ax", "ay", "bx", "by"]
    sent, back = sent.where(near_square("bx", "by")), back.where(near_square("ax", "ay"))
    pairs = sent.groupBy(*keys).cogroup(back.groupBy(*keys)).applyInArrow(lambda a, b: linked(a, b), "ax long, ay long, bx long, by long")
    a, b = (names.select(F.col("cx").alias(f"{s}x"), F.col("cy").alias(f"{s}y"), F.col("name").alias(n)) for s, n in (("a", "u"), ("b", "v")))
    labels = components(pairs.join(a, ["ax", "ay"]).join(b, ["bx", "by"]), names.select(F.col("name").alias("node")))
    clusters = names.join(labels, F.col("name") == F.col("node")).select("cx", "cy", F.col("component").alias("cluster"))
    own = kept(cores.join(clusters, ["cx", "cy"]).select("id", "cx", "cy", "x", "y", "cluster"), "own")
    rest = sparse.join(own.select("id"), "id", "left_anti")
    border = looks(rest).join(own.select("x", "y", "cx", "cy", "cluster"), ["cx", "cy"]).where(within).groupBy(F.col("u").alias("id")).agg(F.min("cluster").alias("cluster"))
    found = own.select("id", "cluster").unionByName(border)
    return cells.select("id").join(found, "id", "left").select(F.col("id").cast(ids).alias("id"), "cluster")


def cluster_numbers(clusters: DataFrame) -> DataFrame:
    """(cluster, number): clusters numbered from 0 in order of their smallest core. There are few of them."""
    return clusters.where("cluster is not null").select("cluster").distinct().withColumn("number", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("int"))


def slices(points: DataFrame, eps: float, min_samples: int, min_cells: int, prefix: str = "S", start: int = 1, debris: str = "debris") -> DataFrame:
    """(id, x, y, slice_cluster, slice_id): density clusters of at least min_cells, numbered by mean y, then mean x; debris otherwise.

    slice_cluster is the number of the density cluster of whatever size, -1 for noise.
    """
    found = kept(density_clusters(points, eps, min_samples), "found")
    labelled = points.select("id", "x", "y").join(found, "id").join(F.broadcast(cluster_numbers(found)), "cluster", "left")
    sums = labelled.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my")).where(F.col("n") >= min_cells)
    named = sums.withColumn("slice_id", F.format_string(f"{prefix}%03d", F.row_number().over(Window.orderBy("my", "mx", "cluster")) + (start - 1))).select("cluster", "slice_id")
    return labelled.join(named, "cluster", "left").select("id", "x", "y", F.coalesce("number", F.lit(-1)).alias("slice_cluster"), F.coalesce("slice_id", F.lit(debris)).alias("slice_id"))


def slice_counts(sliced: DataFrame, debris: str = "debris") -> DataFrame:
    """(n_slices, n_debris, slice_ids) of slices()."""
    real = F.when(F.col("slice_id") != debris, F.col("slice_id"))
    return sliced.agg(F.countDistinct(real).alias("n_slices"), F.count(F.when(F.col("slice_id") == debris, 1)).alias("n_debris"), F.array_sort(F.collect_set(real)).alias("slice_ids"))


def slice_summary(sliced: DataFrame, debris: str = "debris") -> DataFrame:
    spans = [f(c).alias(f"{c}_{name}") for c in ("x", "y") for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    rows = sliced.where(F.col("slice_id") != debris).groupBy("slice_id").agg(F.count("*").alias("n"), *spans)
    rows = rows.withColumn("x_span", F.col("x_max") - F.col("x_min")).withColumn("y_span", F.col("y_max") - F.col("y_min"))
    return rows.select("slice_id", "n", *(F.bround(c, 1).alias(c) for c in rows.columns if c not in ("slice_id", "n")))


def split_by_slice(table: DataFrame, slice_key: str = "slice_id", exclude: tuple[str, ...] = ("debris",)) -> dict[str, DataFrame]:
    """The rows of each slice by its id, in order of the ids as text. Ids are few; rows stay distributed."""
    ids = sorted(str(r[0]) for r in table.select(slice_key).where(F.col(slice_key).isNotNull()).distinct().collect())
    return {i: table.where(F.col(slice_key).cast("string") == i) for i in ids if i not in exclude}


def colonies(points: DataFrame, eps: float = 50.0, min_samples: int = 5, min_size: int = 40) -> DataFrame:
    """(id, x, y, colony): the number of the density cluster as text; null for noise and for clusters under min_size."""
    found = kept(density_clusters(points, eps, min_samples), "found")
    size = found.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    numbered = size.join(F.broadcast(cluster_numbers(found)), "cluster").select("cluster", F.col("number").cast("string").alias("colony"))
    return points.select("id", "x", "y").join(found, "id").join(numbered, "cluster", "left").select("id", "x", "y", "colony")


def colony_counts(found: DataFrame) -> DataFrame:
    return found.agg(F.countDistinct("colony").alias("n_colonies"), F.count("colony").alias("n_assigned"), F.count(F.when(F.col("colony").isNull(), 1)).alias("n_noise_or_small"))


def central_members(points: DataFrame) -> DataFrame:
    """(grp, id, d): of each group the member nearest to its mean point. points: (id, x, y, grp)."""
    points = points.where("grp is not null")
    mean = points.groupBy("grp").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
    best = points.join(mean, "grp").groupBy("grp").agg(F.min(F.struct(distance("x", "y", "mx", "my").alias("d"), F.col("id").alias("id"))).alias("b"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("n").alias("n"))
    return best.select("grp", F.col("b.id").alias("id"), F.col("b.d").alias("d"), F.col("mx").alias("x"), F.col("my").alias("y"), "n")


def marked_centroids(found: DataFrame, label: str = "GCC") -> DataFrame:
    """colonies() with centroid_type: the label for the member nearest to its colony's mean point, else null."""
    marks = central_members(found.withColumnRenamed("colony", "grp")).select("id", F.lit(label).alias("centroid_type"))
    return found.join(F.broadcast(marks), "id", "left")


def centroid_distance(marked: DataFrame, label: str = "GCC") -> DataFrame:
    """(id, d): distance to the nearest marked centroid."""
    targets = marked.where(F.col("centroid_type") == label).select("id", "x", "y")
    if not targets.take(1):
        raise ValueError(f"no cell is marked {label}")
    return nearest(marked.select("id", "x", "y"), targets).select(F.col("src").alias("id"), "d")


# Extents


def data_extent(points: DataFrame, pad: float = 0.05, extra: float = 0.0) -> DataFrame:
    """(xmin, xmax, ymin, ymax) of the numbers among x and y, with a padding (1 where there is no extent)."""
    out = []
    for c in ("x", "y"):
        v = F.when(~F.isnan(c), F.col(c))
        low, high = F.min(v), F.max(v)
        margin = F.when(high > low, (high - low) * pad).otherwise(1.0) + extra
        out += [(low - margin).alias(f"{c}min"), (high + margin).alias(f"{c}max")]
    return points.agg(*out).select("xmin", "xmax", "ymin", "ymax")


def square_size(points: DataFrame, binsize: float | None = None, mpp: float | None = None) -> float:
    """Side of a bin in pixels: binsize over mpp, else the smaller median of gaps between distinct coordinates, else 1."""
    if binsize is not None:
        return float(binsize / mpp) if mpp and mpp > 0 else float(binsize)

    def gap(c: str) -> float | None:
        # each range of the coordinate is sorted by a task; gaps across ranges come from the ranges' ends
        values = points.where(F.col(c).isNotNull() & ~F.isnan(c)).select(F.col(c).cast("double").alias("v")).distinct()
        if not values.take(2)[1:]:
            return None
        placed = values.repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id())

        def gaps(batches):
            last = None
            for b in batches:
                v = b.column("v").to_numpy()
                if not len(v):
                    continue
                d = np.diff(v) if last is None else np.diff(np.append(last, v))
                if last is None:
                    yield pa.record_batch([pa.array([v[0]]), pa.array(["first"])], ["v", "kind"])
                last = v[-1]
                yield pa.record_batch([pa.array(d), pa.array(["gap"] * len(d))], ["v", "kind"])
            if last is not None:
                yield pa.record_batch([pa.array([last]), pa.array(["last"])], ["v", "kind"])

        rows = kept(placed.select("v").mapInArrow(gaps, "v double, kind string"), "gaps")
        ends = sorted((r["v"], r["kind"]) for r in rows.where("kind <> 'gap'").collect())  # two for each partition
        between = [b[0] - a[0] for a, b in zip(ends, ends[1:], strict=False) if a[1] == "last" and b[1] == "first"]
        all_ = rows.where("kind = 'gap'").select("v").union(points.sparkSession.createDataFrame([(float(x),) for x in between], "v double"))
        return all_.where("v > 0").agg(F.percentile("v", 0.5)).first()[0]

    found = [g for g in (gap("x"), gap("y")) if g]
    return float(min(found)) if found else 1.0
