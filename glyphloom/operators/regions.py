"""Named regions of interest over cells or bins, without widgets: an immutable set of polygons and the rows they take in."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from .geometry import intersects

Ring = tuple[tuple[float, float], ...]


def rectangle(x0: float, y0: float, x1: float, y1: float) -> Ring:
    """From two opposite corners, in whatever order."""
    (a, b), (c, d) = sorted((x0, x1)), sorted((y0, y1))
    return (a, c), (b, c), (b, d), (a, d)


def ellipse(x0: float, y0: float, x1: float, y1: float, degrees: float = 0.0, n: int = 64) -> Ring:
    """The polygon of n corners within the box of two opposite corners."""
    cx, cy, u, v, turn = (x0 + x1) / 2, (y0 + y1) / 2, abs(x1 - x0) / 2, abs(y1 - y0) / 2, math.radians(degrees)
    at = [(u * math.cos(2 * math.pi * i / n), v * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return tuple((cx + p * math.cos(turn) - q * math.sin(turn), cy + p * math.sin(turn) + q * math.cos(turn)) for p, q in at)


def lasso(vertices: Sequence[tuple[float, float]]) -> Ring:
    if len(vertices) < 3:
        raise ValueError("a region needs three vertices")
    return tuple((float(x), float(y)) for x, y in vertices)


def marked(x: tuple[float, float], y: tuple[float, float]) -> Ring:
    """The rectangle between limits, reversed ones put in order."""
    return rectangle(x[0], y[0], x[1], y[1])


@dataclass(frozen=True)
class RegionSet:
    """Regions in order of their making; of overlapping ones the last wins."""

    regions: tuple[tuple[str, Ring], ...] = ()
    prefix: str = "ROI"
    made: int = 0

    def add(self, vertices: Sequence[tuple[float, float]], name: str | None = None) -> RegionSet:
        """A region of that name, or of the prefix and the next free number."""
        made, names = self.made, {n for n, _ in self.regions}
        if name is None:
            made += 1
            while f"{self.prefix}_{made}" in names:
                made += 1
            name = f"{self.prefix}_{made}"
        if name in names:
            raise KeyError(f"there is a region {name}")
        return replace(self, regions=(*self.regions, (name, lasso(vertices))), made=made)

    def rename(self, old: str, new: str) -> RegionSet:
        """The region moves to the end."""
        held = dict(self.regions)
        if old not in held:
            raise KeyError(f"there is no region {old}")
        if new in held:
            raise KeyError(f"there is a region {new}")
        return replace(self, regions=(*((n, r) for n, r in self.regions if n != old), (new, held[old])))

    def undo(self) -> RegionSet:
        return replace(self, regions=self.regions[:-1])

    def clear(self) -> RegionSet:
        return replace(self, regions=(), made=0)

    def frame(self, spark) -> DataFrame:
        """(name, ord, vertices)."""
        return spark.createDataFrame([(n, i, [{"x": x, "y": y} for x, y in r]) for i, (n, r) in enumerate(self.regions)], "name string, ord int, vertices array<struct<x: double, y: double>>")

    def labelled(self, rows: DataFrame, mode: str | None = None, name: str = "ROI") -> DataFrame:
        """rows with the region of each: cells (vertices) that touch it, or points (x, y) strictly inside of it; null for none.

        Regions are drawn by hand and few: they are literals of the plan, and their boxes are compared first.
        """
        mode = mode or mode_of(rows)
        label = F.lit(None).cast("string")
        for region, ring in self.regions:
            label = F.when(self._takes(rows, ring, mode), region).otherwise(label)
        return rows.withColumn(name, label)

    def ids(self, rows: DataFrame, region: str, mode: str | None = None, key: str = "cell_id") -> DataFrame:
        ring = dict(self.regions)[region]
        return rows.where(self._takes(rows, ring, mode or mode_of(rows))).select(key)

    @staticmethod
    def _takes(rows: DataFrame, ring: Ring, mode: str) -> Column:
        shape = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring))
        (low, high), (bottom, top) = ((min(v), max(v)) for v in zip(*ring, strict=True))
        if mode == "squarebin":
            return F.col("x").between(low, high) & F.col("y").between(bottom, top) & sc.inside(F.col("x"), F.col("y"), shape)
        box = sc.bounds(F.col("vertices"))
        near = (box["xmin"] <= high) & (box["xmax"] >= low) & (box["ymin"] <= top) & (box["ymax"] >= bottom)
        return F.coalesce(F.when(near, intersects(F.col("vertices"), shape)), F.lit(False))


def mode_of(rows: DataFrame, given: str | None = None) -> str:
    """'cellbin' where a row has a polygon, else 'squarebin' where there are coordinates."""
    if given:
        if given not in ("cellbin", "squarebin"):
            raise ValueError(f"unknown mode {given}")
        return given
    if "vertices" in rows.columns and rows.where("vertices is not null").take(1):
        return "cellbin"
    if {"x", "y"} <= set(rows.columns):
        return "squarebin"
    raise ValueError("neither polygons nor coordinates")


def selectable(rows: DataFrame, mode: str) -> DataFrame:
    """Rows that a region can take in."""
    return rows.where("vertices is not null") if mode == "cellbin" else rows
