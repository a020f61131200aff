"""Scalar expressions: identifiers, colours, polygons, arrays. All are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_name(i: Column) -> Column:
    """cellid_ with at least nine digits and -1."""
    return F.format_string("cellid_%09d-1", i.cast("long"))


def hex_to_rgb(colour: Column) -> Column:
    """#rrggbb to three shares of 255."""
    return F.array(*(F.conv(F.substring(colour, i, 2), 16, 10).cast("double") / 255 for i in (2, 4, 6)))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    """Shares to #rrggbb; half-even rounding, clamped."""
    return F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(v * 255).cast("int")))), 2, "0") for v in (r, g, b))))


def _edges(ring: Column) -> Column:
    """Array of (a, b) vertices of a ring of (x, y) structs, closed."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    return _sum(F.transform(_edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def centroid(ring: Column) -> Column:
    """Area centroid (x, y)."""
    def part(c: str) -> Column:
        return _sum(F.transform(_edges(ring), lambda e: (e["a"][c] + e["b"][c]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))) / (6 * signed_area(ring))

    return F.struct(part("x").alias("x"), part("y").alias("y"))


def bounds(ring: Column) -> Column:
    def of(c: str, f) -> Column:
        return f(F.transform(ring, lambda v: v[c]))

    return F.struct(of("x", F.array_min).alias("xmin"), of("y", F.array_min).alias("ymin"), of("x", F.array_max).alias("xmax"), of("y", F.array_max).alias("ymax"))


def wkt(ring: Column) -> Column:
    text = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(text, ", "), F.lit("))"))


def parse_wkt(text: Column) -> Column:
    """Ring of a POLYGON text without holes, its closing vertex removed; null if it has another form."""
    body = F.regexp_extract(text, r"^\s*POLYGON\s*\(\(([^()]*)\)\)\s*$", 1)
    points = F.transform(F.split(body, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].try_cast("double").alias("y")))
    return F.when(body != "", F.slice(points, 1, F.size(points) - 1))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Strictly inside: ray casting, with points on an edge excluded."""
    def cross(e: Column) -> Column:
        return (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])

    def touches(e: Column) -> Column:
        return (cross(e) == 0) & x.between(F.least(e["a"]["x"], e["b"]["x"]), F.greatest(e["a"]["x"], e["b"]["x"])) & y.between(F.least(e["a"]["y"], e["b"]["y"]), F.greatest(e["a"]["y"], e["b"]["y"]))

    def crosses(e: Column) -> Column:
        return ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"]))

    edges = _edges(ring)
    return ~F.exists(edges, touches) & (F.size(F.filter(edges, crosses)) % 2 == 1)


def ellipse(cx: Column, cy: Column, width: Column, height: Column, degrees: float = 0.0, n: int = 64) -> Column:
    turn = F.radians(F.lit(degrees))

    def at(i: Column) -> Column:
        t = i * (2 * 3.141592653589793 / n)
        u, v = width / 2 * F.cos(t), height / 2 * F.sin(t)
        return F.struct((cx + u * F.cos(turn) - v * F.sin(turn)).alias("x"), (cy + u * F.sin(turn) + v * F.cos(turn)).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*(F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))


def aliases(gene: Column) -> Column:
    """A gene's name and its .N / -N variants."""
    return F.array_distinct(F.array(gene, F.regexp_replace(gene, r"\.(\d+)$", "-$1"), F.regexp_replace(gene, r"-(\d+)$", ".$1")))


def clipped(v: Column, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def mixed_embedding(identity: Column, context: Column, share: float) -> Column:
    return F.concat(F.transform(identity, lambda x: x * (1 - share) ** 0.5), F.transform(context, lambda x: x * share**0.5))


def half_size(bin_um: float, mpp: float | None) -> float:
    """Half a bin in pixels."""
    return bin_um / mpp / 2 if mpp and mpp > 0 else 1.0
