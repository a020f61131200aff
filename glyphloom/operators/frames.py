"""What a plot of cells or bins shows, as tables: values, colours, legends, extents and image crops. Nothing is drawn."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from . import counts as ct
from . import spatial as sp
from .geometry import drawable, total_bounds

#: The colours of categories (fixed values: the common ten and twenty categorical colours of plots).
TEN = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")
TWENTY = ("#1f77b4", "#aec7e8", "#ff7f0e", "#ffbb78", "#2ca02c", "#98df8a", "#d62728", "#ff9896", "#9467bd", "#c5b0d5", "#8c564b", "#c49c94", "#e377c2", "#f7b6d2", "#7f7f7f", "#c7c7c7", "#bcbd22", "#dbdb8d", "#17becf", "#9edae5")
#: Colours of genes that are blended, up to seven (plain primary and secondary colours).
GENE_COLOURS = ("#ff0000", "#00ff00", "#0000ff", "#ffff00", "#ff00ff", "#00ffff", "#ffffff")
MISSING = "#d3d3d3"


def colour_list(colours: str | Sequence[str] | None) -> list[str | None]:
    return [colours] if colours is None or isinstance(colours, str) else list(colours)


def checked_colours(obs: DataFrame, genes: Sequence[str], colours: Sequence[str | None], layers: Sequence[str] = ()) -> None:
    for c in colours:
        if c is None or c in obs.columns or c in genes:
            continue
        raise ValueError(f"{c} is a layer, neither a column nor a gene" if c in layers else f"{c} is neither a column nor a gene")


def library(libraries: Sequence[str], given: str | None = None) -> str:
    """The library that is meant: the given one, which must exist, or the only one or first."""
    if given is not None:
        if given not in libraries:
            raise ValueError(f"no library {given} among {list(libraries)}")
        return given
    if not libraries:
        raise ValueError("there is no library")
    return libraries[0]


def of_groups(obs: DataFrame, colour: str | None, groups: Sequence[str] | None, by: str | None = None) -> DataFrame:
    """Rows whose column `by` (the coloured one, where it is a column) is among the groups."""
    if groups is None:
        return obs
    column = by if by is not None else colour if colour in obs.columns else None
    if column is None or column not in obs.columns:
        raise ValueError("groups need a column")
    return obs.where(F.col(column).cast("string").isin([str(g) for g in groups]))


def coloured(obs: DataFrame, counts: DataFrame | None, colour: str | None) -> DataFrame:
    """obs with `value`: a column, or a gene's counts, zeros included. obs: (cell_id, ...); counts: (cell, gene, value)."""
    if colour is None:
        return obs.withColumn("value", F.lit(None).cast("string"))
    if colour in obs.columns:
        return obs.withColumn("value", F.col(colour))
    own = counts.where(F.col("gene") == colour).groupBy(F.col("cell").alias("cell_id")).agg(F.sum("value").alias("value"))
    return obs.join(own, "cell_id", "left").fillna(0.0, ["value"])


def is_hex(values: DataFrame, column: str = "value") -> bool:
    """Whether the first hundred values are all colours as #rrggbb."""
    if dict(values.dtypes)[column] != "string":
        return False
    seen = values.where(F.col(column).isNotNull()).select(column).limit(100).agg(F.count("*").alias("n"), F.bool_and(F.col(column).startswith("#") & (F.length(column) == 7)).alias("ok")).first()
    return bool(seen["n"] and seen["ok"])


def categories(values: DataFrame, column: str = "value") -> list[str]:
    """Distinct values as text, shorter ones first, so that 2 comes before 10."""
    rows = values.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("c")).distinct().collect()  # a legend's entries
    return sorted((r["c"] for r in rows), key=lambda c: (len(c), c))


def legend(names: Sequence[str], palette: Mapping[str, str] | Sequence[str] | None = None, default: str = "gray") -> dict[str, str]:
    """A colour for each category: from a mapping (else the default), a list that starts anew at its end, or ten or twenty colours."""
    if isinstance(palette, Mapping):
        return {n: palette.get(n, default) for n in names}
    if palette is not None and (isinstance(palette, str) or not isinstance(palette, Sequence)):
        raise ValueError(f"unknown palette {palette!r}")
    colours = list(palette) if palette else TEN if len(names) <= len(TEN) else TWENTY
    return {n: colours[i % len(colours)] for i, n in enumerate(names)}


def mapped(column: Column, colours: Mapping[str, str], missing: str | None = MISSING) -> Column:
    if not colours:
        return F.lit(missing)
    pairs = F.create_map(*(F.lit(x) for pair in colours.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, column.cast("string")), F.lit(missing))


def shares(rows: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """rows with `share`: value between the limits (its least and largest), 0 to 1; null for none. Equal limits are kept apart by 1e-12."""
    if low is None or high is None:
        seen = rows.where(~F.isnan(F.col("value").cast("double"))).agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
        low, high = (seen["low"] if low is None else low), (seen["high"] if high is None else high)
    low, high = float(low or 0.0), float(high or 0.0)
    high = high + 1e-12 if high == low else high
    v = F.col("value").cast("double")
    return rows.withColumn("share", F.when(v.isNotNull() & ~F.isnan(v), F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))))


def painted(rows: DataFrame, palette: Mapping[str, str] | Sequence[str] | None = None, low: float | None = None, high: float | None = None, missing: str = MISSING) -> tuple[DataFrame, dict[str, str]]:
    """rows with `fill` (text values: their own or a category's colour) or `share` (numbers), and the legend of categories."""
    if dict(rows.dtypes)["value"] in ("string", "boolean"):
        if is_hex(rows):
            return rows.withColumn("fill", F.coalesce("value", F.lit(missing))), {}
        colours = legend(categories(rows), palette)
        return rows.withColumn("fill", mapped(F.col("value"), colours, missing)), colours
    return shares(rows, low, high), {}


def cell_frame(obs: DataFrame, geometries: DataFrame, counts: DataFrame | None = None, colour: str | None = None, groups: Sequence[str] | None = None, by: str | None = None, palette=None, edge: str | None = None, edge_palette=None, low: float | None = None, high: float | None = None) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """(cell_id, wkt, value, fill or share, edge) of the cells that can be drawn, and the legends of fill and edge."""
    rows = of_groups(obs, colour, groups, by)
    rows = coloured(rows, counts, colour)
    edges: dict[str, str] = {}
    outline = F.lit(None).cast("string")
    if edge is not None:
        edges = legend(categories(rows, edge), edge_palette)
        outline = mapped(F.col(edge), edges, None)
    own, _ = drawable(geometries.join(rows.select("cell_id"), "cell_id", "left_semi"))
    rows = rows.drop("vertices").join(own.select("cell_id", "vertices"), "cell_id")
    rows, fills = painted(rows, palette, low, high)
    shown = "fill" if "fill" in rows.columns else "share"
    return rows.select("cell_id", sc.wkt(F.col("vertices")).alias("wkt"), "value", shown, outline.alias("edge")), fills, edges


def bin_frame(obs: DataFrame, counts: DataFrame | None = None, colour: str | None = None, groups: Sequence[str] | None = None, by: str | None = None, crop: tuple[float, float, float, float] | None = None, palette=None, low: float | None = None, high: float | None = None, missing: str = MISSING, binsize: float | None = None, mpp: float | None = None) -> tuple[DataFrame, dict[str, str], float]:
    """(cell_id, x, y, value, fill or share) of the bins within crop (x0, x1, y0, y1), the legend, and the side of a bin."""
    rows = obs if crop is None else obs.where(F.col("x").between(crop[0], crop[1]) & F.col("y").between(crop[2], crop[3]))
    rows, fills = painted(coloured(of_groups(rows, colour, groups, by), counts, colour), palette, low, high, missing)
    return rows.select("cell_id", "x", "y", "value", "fill" if "fill" in rows.columns else "share"), fills, sp.square_size(obs, binsize, mpp)


def hex_groups(rows: DataFrame) -> DataFrame:
    """(fill, cells): how many cells have each colour of their own."""
    return rows.groupBy(F.col("value").alias("fill")).agg(F.count("*").alias("cells"))


def frame_extent(geometries: DataFrame, points: DataFrame | None = None) -> tuple[float, float, float, float]:
    """(xmin, ymin, xmax, ymax) of polygons, else of points, else 0 to 1."""
    box = total_bounds(geometries).first()
    if any(v is None for v in box) and points is not None:
        box = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return (0.0, 0.0, 1.0, 1.0) if any(v is None or not math.isfinite(v) for v in box) else tuple(float(v) for v in box)


def image_crop(height: int, width: int, scale: float = 1.0, box: tuple[float, float, float, float] | None = None) -> tuple[tuple[int, int, int, int], tuple[float, float, float, float]]:
    """Pixels (x0, y0, x1, y1) of an image that cover a box of data (xmin, ymin, xmax, ymax), and their place in data (left, right, bottom, top).

    An image of scale under 1 is smaller than the data; one without overlap with the box is shown whole.
    """
    scale = min(scale, 1.0)
    pixels = (0, 0, width, height)
    if box is not None:
        cut = (max(0, math.floor(box[0] * scale)), max(0, math.floor(box[1] * scale)), min(width, math.ceil(box[2] * scale)), min(height, math.ceil(box[3] * scale)))
        if cut[0] < cut[2] and cut[1] < cut[3]:
            pixels = cut
    x0, y0, x1, y1 = pixels
    return pixels, (x0 / scale, x1 / scale, y1 / scale, y0 / scale)


def blended(counts: DataFrame, cells: DataFrame, genes: Sequence[str], colours: Sequence[str] | None = None, low: float = 1.0, high: float = 99.0, gamma: float = 1.0, background: str = "#e0e0e0") -> DataFrame:
    """(cell, colour): each gene's share of 0 to 1 (between its percentiles, zeros included) weighs its colour; the background where all are 0.

    cells: (cell). counts: (cell, gene, value).
    """
    if len(genes) < 2:
        raise ValueError("a blend needs two genes")
    colours = list(colours) if colours is not None else list(GENE_COLOURS[: len(genes)])
    if len(colours) != len(genes):
        raise ValueError(f"{len(colours)} colours for {len(genes)} genes")
    own = counts.where(F.col("gene").isin(list(genes)))
    found = {r["gene"] for r in own.select("gene").distinct().collect()}
    if missing := [g for g in genes if g not in found]:
        raise ValueError(f"no genes {missing}")
    n = cells.count()
    rgb = {g: [int(c[i : i + 2], 16) / 255 for i in (1, 3, 5)] for g, c in zip(genes, colours, strict=True)}
    rows = ct.percentile_scaled(own, n, low / 100, high / 100)
    # a cell without an entry of a gene has that gene's share of zero
    zeros = {r["gene"]: r["zero"] for r in rows.select("gene", "zero").distinct().collect()}
    base = [sum(zeros.get(g, 0.0) * k for g, k in zip(genes, part, strict=True)) for part in ([1.0] * len(genes), *([rgb[g][i] for g in genes] for i in range(3)))]
    channel = lambda i: F.create_map(*(F.lit(x) for g in genes for x in (g, rgb[g][i])))[F.col("gene")]
    more = F.col("value") - F.col("zero")
    sums = rows.groupBy("cell").agg(F.sum(more).alias("w"), *(F.sum(more * channel(i)).alias(f"c{i}") for i in range(3)))
    mixed = cells.select("cell").join(sums, "cell", "left").fillna(0.0, ["w", "c0", "c1", "c2"])
    total = F.col("w") + base[0]
    parts = [F.pow(F.least(F.greatest((F.col(f"c{i}") + base[i + 1]) / total, F.lit(0.0)), F.lit(1.0)), F.lit(gamma)) for i in range(3)]
    return mixed.select("cell", F.when(total > 0, sc.rgb_to_hex(*parts)).otherwise(background).alias("colour"))


def faceted(counts: DataFrame, cells: DataFrame, genes: Sequence[str], low: float = 1.0, high: float = 99.0) -> dict[str, DataFrame]:
    """(cell, value) for each gene: its share between its percentiles, zeros included."""
    n = cells.count()
    out = {}
    for g in genes:
        rows = ct.percentile_scaled(counts.where(F.col("gene") == g), n, low / 100, high / 100)
        zero = rows.select("zero").limit(1).collect()
        out[g] = cells.select("cell").join(rows.select("cell", "value"), "cell", "left").fillna(zero[0]["zero"] if zero else 0.0, ["value"])
    return out
