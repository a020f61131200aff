"""Polygons of cells: hulls of labelled bins, borders from offsets, validity, contact, alignment with cells.

A polygon is a column of (x, y) structs without its closing vertex.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc

RING = "array<struct<x: double, y: double>>"
#: Corners of a disc, and what marks an unused vertex of a border of 16-bit offsets (fixed value of the file format).
DISC, UNUSED = 32, 32767


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counterclockwise (Andrew's chain); points on its edges are left out."""
    points = np.unique(np.asarray(points, float), axis=0)
    if len(points) < 3:
        return points

    def half(rows: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def buffered(points: np.ndarray, radius: float, corners: int = DISC) -> np.ndarray:
    """The convex hull of discs (polygons of `corners` corners) around the points."""
    turn = np.arange(corners) * (2 * math.pi / corners)
    disc = radius * np.column_stack([np.cos(turn), np.sin(turn)])
    return hull((hull(points)[:, None] + disc).reshape(-1, 2))


def cell_polygon(points: np.ndarray, half: float) -> np.ndarray:
    """Outline of a cell's bins: a square around a single one, else the hull widened by half a bin."""
    points = np.unique(np.asarray(points, float), axis=0)
    if len(points) == 1:
        return points[0] + half * np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]])
    return buffered(points, half)


def label_polygons(bins: DataFrame, bin_um: float = 2.0, mpp: float | None = None) -> DataFrame:
    """(label, vertices) of bins (label, x, y); label 0 has none. Rows and columns of a label's bins but for the outermost can't be corners and stay where they are."""
    half = sc.half_size(bin_um, mpp)
    own = bins.where("label <> 0").groupBy("label", "x").agg(F.min("y").alias("low"), F.max("y").alias("high"))

    def outline(part: pd.DataFrame) -> pd.DataFrame:
        points = np.concatenate([part[["x", "low"]].to_numpy(float), part[["x", "high"]].to_numpy(float)])
        ring = [{"x": float(x), "y": float(y)} for x, y in cell_polygon(points, half)]
        return pd.DataFrame({"label": part["label"].iloc[:1], "vertices": [ring]})

    return own.groupBy("label").applyInPandas(outline, f"label {bins.schema['label'].dataType.simpleString()}, vertices {RING}")


def cells_of_bins(bins: DataFrame, counts: DataFrame, bin_um: float = 2.0, mpp: float | None = None, polygons: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cells (cell, object_id, x, y, bin_count[, vertices]) and their counts (cell, gene, value) from labelled bins (bin, label, x, y) and counts (bin, gene, value)."""
    live = bins.where("label <> 0")
    cells = live.groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("bin_count"))
    cells = cells.join(label_polygons(bins, bin_um, mpp), "label", "left") if polygons else cells
    sums = counts.join(live.select("bin", "label"), "bin").groupBy("label", "gene").agg(F.sum("value").alias("value"))
    name = sc.cell_name(F.col("label")).alias("cell")
    return cells.select(name, F.col("label").alias("object_id"), *cells.columns[1:]), sums.select(name, "gene", "value")


def spot_diameter(diameter: float, cells: DataFrame) -> float:
    """Of a cell with the mean number of bins."""
    return diameter * math.sqrt(cells.agg(F.avg("bin_count")).first()[0] or 1.0)


def with_polygons(cells: DataFrame, bins: DataFrame, bin_um: float = 2.0, mpp: float | None = None) -> DataFrame:
    """cells (object_id, ...) with vertices from labelled bins; null for cells without bins."""
    return cells.drop("vertices").join(label_polygons(bins, bin_um, mpp).withColumnRenamed("label", "object_id"), "object_id", "left")


def border_polygon(offsets: Column, x: Column, y: Column) -> Column:
    """Vertices of offsets (dx, dy) around a cell's centre, unused ones left out; a 10 x 10 square where under three are left."""
    live = F.filter(offsets, lambda o: ~((o["dx"] == UNUSED) & (o["dy"] == UNUSED)))
    ring = F.transform(live, lambda o: F.struct((x + o["dx"]).cast("double").alias("x"), (y + o["dy"]).cast("double").alias("y")))
    return F.when(F.size(live) >= 3, ring).otherwise(sc.rectangle(x - 5, y - 5, x + 5, y + 5))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _on(a: Column, b: Column, c: Column) -> Column:
    """c, in line with a and b, lies between them."""
    return c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def _meet(p: Column, q: Column) -> Column:
    """Whether two edges (a, b) have a point in common."""
    a, b, c, d = p["a"], p["b"], q["a"], q["b"]
    s1, s2, s3, s4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    return ((s1 != s2) & (s3 != s4)) | ((s1 == 0) & _on(a, b, c)) | ((s2 == 0) & _on(a, b, d)) | ((s3 == 0) & _on(c, d, a)) | ((s4 == 0) & _on(c, d, b))


def simple(ring: Column) -> Column:
    """Whether a ring has three vertices at least, an area, and no two edges that meet but neighbours at their vertex."""
    n = F.size(ring)
    index = F.sequence(F.lit(0), n - 1)
    edge = lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b"))
    apart = lambda i, j: (j > i + 1) & ~((i == 0) & (j == n - 1))
    crossing = F.exists(index, lambda i: F.exists(index, lambda j: apart(i, j) & _meet(edge(i), edge(j))))
    return F.coalesce((n >= 3) & (sc.signed_area(ring) != 0) & ~crossing, F.lit(False))


def intersects(a: Column, b: Column) -> Column:
    """Whether two polygons have a point in common, edges and corners included."""
    contains = lambda outer, inner: sc.inside(F.get(inner, F.lit(0))["x"], F.get(inner, F.lit(0))["y"], outer)
    return F.exists(sc._edges(a), lambda p: F.exists(sc._edges(b), lambda q: _meet(p, q))) | contains(a, b) | contains(b, a)


def valid_bounds(ring: Column) -> Column:
    """Whether a polygon can be drawn: vertices, finite bounds and an extent on both axes."""
    box = sc.bounds(ring)
    finite = [~F.isnan(box[c]) & (F.abs(box[c]) != math.inf) for c in ("xmin", "ymin", "xmax", "ymax")]
    return F.coalesce((F.size(ring) > 0) & finite[0] & finite[1] & finite[2] & finite[3] & (box["xmax"] > box["xmin"]) & (box["ymax"] > box["ymin"]), F.lit(False))


def total_bounds(polygons: DataFrame, ring: str = "vertices") -> DataFrame:
    box = sc.bounds(F.col(ring))
    return polygons.select(box.alias("b")).agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


def finite_bounds(bounds: DataFrame) -> bool:
    row = bounds.first()
    return all(v is not None and math.isfinite(v) for v in row) and row["xmax"] > row["xmin"] and row["ymax"] > row["ymin"]


def drawable(polygons: DataFrame, ring: str = "vertices") -> tuple[DataFrame, bool]:
    """All rows where their common bounds are fine, else those that can be drawn; and whether some were left out."""
    return (polygons, False) if finite_bounds(total_bounds(polygons, ring)) else (polygons.where(valid_bounds(F.col(ring))), True)


def kept_geometries(geometries: DataFrame, obs: DataFrame) -> DataFrame:
    """Geometries of the cells that obs still has, in its order (ord) where it has one; all of them if none is left."""
    own = obs.select("cell_id", *([c for c in ("ord",) if c in obs.columns]))
    out = geometries.drop("ord").join(own, "cell_id") if "ord" in own.columns else geometries.join(own, "cell_id", "left_semi")
    return out if out.take(1) else geometries


def geometry_of(cells: DataFrame, geometries: DataFrame) -> DataFrame:
    """cells with vertices: the table's, else those of their WKT column, else null."""
    stored = geometries.select("cell_id", F.col("vertices").alias("__stored"))
    text = sc.parse_wkt(F.col("geometry")) if "geometry" in cells.columns else F.lit(None).cast(RING)
    return cells.drop("vertices").join(stored, "cell_id", "left").withColumn("vertices", F.coalesce("__stored", text)).drop("__stored")
