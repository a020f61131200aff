"""Scans of matrix, position, polygon and bin files into relations, and their sinks.

A data set is a dict of DataFrames (counts, cells, genes, polygons ...) and plain dicts (scalefactors, metadata). HDF5 files are read
where h5py is installed; without it the same tables are expected as Parquet (see hdf5_table).
"""

from __future__ import annotations

import math
import struct
import warnings

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import geometry as gm
from ..operators import spatial as sp
from ..operators.relations import checked_left_join
from . import files

#: Coordinate columns in order of preference (fixed names of the file formats).
COORDINATES = (("pxl_col_in_fullres", "pxl_row_in_fullres"), ("pxl_col", "pxl_row"), ("x", "y"), ("array_col", "array_row"))
#: Columns of cells that a section's table may have (fixed names of the file format).
CELL_COLUMNS = ("x_centroid", "y_centroid", "cell_area", "nucleus_area", "transcript_counts", "total_counts", "nucleus_count", "control_probe_counts", "genomic_control_counts", "control_codeword_counts", "unassigned_codeword_counts", "segmentation_method")


def coordinates(table: DataFrame) -> DataFrame:
    """table with x and y, from the first complete pair of COORDINATES; a null in one of them is an error."""
    for x, y in COORDINATES:
        if x in table.columns and y in table.columns:
            out = table.withColumn("x", F.col(x).cast("double")).withColumn("y", F.col(y).cast("double"))
            if out.where("x is null or y is null").take(1):
                raise ValueError(f"null coordinates in {x}, {y}")
            return out
    raise ValueError(f"no coordinates among {table.columns}")


# Matrices


def _named(spark: SparkSession, folder: str, *names: str) -> str:
    for n in names:
        for suffix in ("", ".gz"):
            if files.exists(spark, f"{folder}/{n}{suffix}"):
                return f"{folder}/{n}{suffix}"
    raise FileNotFoundError(f"{folder} has none of {names}")


def matrix_market(spark: SparkSession, folder: str, by_symbol: bool = True) -> DataFrame:
    """(cell, gene, value) of a folder with matrix.mtx, features.tsv (or genes.tsv) and barcodes.tsv, each plain or as .gz. Indices count from 1.

    The line of dimensions is the first that is no comment; it is left out by its place, since an entry may look like it.
    """
    rows = files.numbered_lines(spark, _named(spark, folder, "matrix.mtx")).where(~F.col("line").startswith("%") & (F.trim("line") != ""))
    head = rows.agg(F.min("i").alias("i")).first()["i"]
    if head is None:
        raise ValueError(f"{folder} has no matrix")
    part = F.split(F.trim("line"), r"\s+")
    entries = rows.where(F.col("i") != head).select((part[0].cast("long") - 1).alias("g"), (part[1].cast("long") - 1).alias("c"), part[2].cast("double").alias("value"))
    genes = files.numbered_lines(spark, _named(spark, folder, "features.tsv", "genes.tsv")).select(F.col("i").alias("g"), F.split("line", "\t")[1 if by_symbol else 0].alias("gene"))
    cells = files.numbered_lines(spark, _named(spark, folder, "barcodes.tsv")).select(F.col("i").alias("c"), F.trim(F.split("line", "\t")[0]).alias("cell"))
    return entries.join(F.broadcast(genes), "g").join(cells, "c").select("cell", "gene", "value")  # genes: a row for each


def features(spark: SparkSession, folder: str) -> DataFrame:
    """(ord, gene, gene_id, feature_type)."""
    part = F.split("line", "\t")
    return files.numbered_lines(spark, _named(spark, folder, "features.tsv", "genes.tsv")).select(F.col("i").alias("ord"), part[1].alias("gene"), part[0].alias("gene_id"), F.get(part, F.lit(2)).alias("feature_type"))


def compressed_columns(columns: DataFrame) -> DataFrame:
    """(column, row, value) of a column-compressed matrix: (column, start, stop) joined with its entries by range. columns: (column, rows, values) arrays."""
    return columns.select("column", F.explode(F.arrays_zip("rows", "values")).alias("e")).select("column", F.col("e.rows").alias("row"), F.col("e.values").alias("value"))


def hdf5_table(spark: SparkSession, path: str, group: str) -> DataFrame:
    """The table `group` of an HDF5 file: through h5py where it is installed, else from the Parquet table <path>.<group> beside it."""
    staged = f"{path}.{group.replace('/', '.')}"
    if files.exists(spark, staged):
        return spark.read.parquet(staged)
    try:
        import h5py
    except ModuleNotFoundError:
        raise FileNotFoundError(f"{path} needs h5py, or its table {group} as Parquet in {staged}") from None
    with h5py.File(path, "r") as f:  # a file that the driver can open
        return spark.createDataFrame(pd.DataFrame({n: list(f[group][n]) for n in f[group].dtype.names}))


def hdf5_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(cell, gene, value) of a matrix file: a staged Parquet table with these columns, or its groups through h5py."""
    staged = f"{path}.matrix"
    if files.exists(spark, staged):
        return spark.read.parquet(staged).select("cell", "gene", "value")
    try:
        import h5py
    except ModuleNotFoundError:
        raise FileNotFoundError(f"{path} needs h5py, or the Parquet table {staged}") from None
    with h5py.File(path, "r") as f:
        m = f["matrix"]
        ends = m["indptr"][:]
        columns = [(m["barcodes"][c].decode(), m["indices"][a:b].tolist(), [float(v) for v in m["data"][a:b]]) for c, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
        names = spark.createDataFrame([(i, g.decode()) for i, g in enumerate(m["features"]["name"][:])], "row long, gene string")
    rows = compressed_columns(spark.createDataFrame(columns, "column string, rows array<long>, values array<double>"))
    return rows.join(F.broadcast(names), "row").select(F.col("column").alias("cell"), "gene", "value")


def counts_of(spark: SparkSession, folder: str, h5: str = "filtered_feature_bc_matrix.h5", directory: str = "filtered_feature_bc_matrix") -> DataFrame:
    """(cell, gene, value) of the HDF5 file if it can be read, else of the matrix folder."""
    at, staged = f"{folder}/{h5}", f"{folder}/{h5}.matrix"
    if files.exists(spark, at) or files.exists(spark, staged):
        try:
            return hdf5_matrix(spark, at)
        except Exception as e:
            if not files.exists(spark, f"{folder}/{directory}"):
                raise FileNotFoundError(f"neither {at} nor {folder}/{directory} can be read") from e
            warnings.warn(f"{at} can't be read; {directory} is", stacklevel=2)
    if not files.exists(spark, f"{folder}/{directory}"):
        raise FileNotFoundError(f"neither {at} nor {folder}/{directory} is there")
    return matrix_market(spark, f"{folder}/{directory}")


# Positions, images and factors


def separated(spark: SparkSession, path: str) -> DataFrame:
    """A text table with a header, whose separator is the one of comma, tab, semicolon and bar that its first line has most."""
    head = files.first_line(spark, path) or ""
    return spark.read.option("header", True).option("inferSchema", True).option("sep", max(",\t;|", key=head.count)).csv(path)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """A table of positions, Parquet or else the .csv of the same name, with its key as `cell`: `barcode`, else the first column."""
    if files.exists(spark, path) and path.endswith(".parquet"):
        table = spark.read.parquet(path)
    else:
        other = path.replace(".parquet", ".csv")
        if not files.exists(spark, other):
            raise FileNotFoundError(f"neither {path} nor {other} is there")
        table = separated(spark, other)
    return table.withColumnRenamed("barcode" if "barcode" in table.columns else table.columns[0], "cell")


def image_size(content: bytes) -> tuple[int, int, int]:
    """Height, width and channels of a PNG, or of the first page of a TIFF."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        width, height, _, colour = struct.unpack(">IIBB", content[16:26])
        return height, width, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[colour]
    if content[:2] in (b"II", b"MM"):
        order = "<" if content[:2] == b"II" else ">"
        at = struct.unpack(order + "I", content[4:8])[0]
        tags = {}
        for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
            tag, kind, _ = struct.unpack(order + "HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
            tags[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), content[at + 10 + 12 * k : at + 10 + 12 * k + (2 if kind == 3 else 4)])[0]
        return tags[257], tags[256], tags.get(277, 1)
    raise ValueError("neither PNG nor TIFF")


def images(spark: SparkSession, paths: dict[str, str]) -> DataFrame | None:
    """(key, height, width, channels, content) of images by key; none of them if one is missing."""
    if missing := [p for p in paths.values() if not files.exists(spark, p)]:
        warnings.warn(f"no images: {missing} are missing", stacklevel=2)
        return None
    sized = F.udf(lambda c: image_size(bytes(c)), "struct<height: int, width: int, channels: int>")  # a row for each image
    out = None
    for key, path in paths.items():
        row = spark.read.format("binaryFile").load(path).select(F.lit(key).alias("key"), sized("content").alias("s"), "content").select("key", "s.*", "content")
        out = row if out is None else out.unionByName(row)
    return out


def tissue_image(spark: SparkSession, folder: str, given: str | None = None) -> DataFrame | None:
    """The registered image of a folder's data: the given file or folder, else `03.register` or `register` one or two folders up."""
    places = [given] if given else [f"{files.parent(folder, up)}/{name}" for up in (1, 2) for name in ("03.register", "register")]
    for place in places:
        if not files.exists(spark, place):
            continue
        path = place if place.lower().endswith((".tif", ".tiff")) else register_image(spark, place)
        if path is None or not path.lower().endswith((".tif", ".tiff")):
            continue
        return images(spark, {"hires": path})
    if given:
        warnings.warn(f"{given} is no image that can be read", stacklevel=2)
    return None


def register_image(spark: SparkSession, folder: str) -> str | None:
    """A folder's registered image: *_regist.tif, *.TIF, one with `stitch` in its name, any .tif; masks and cuts only if nothing else is there."""
    names = files.listed(spark, folder)
    rules = (lambda n: n.endswith("_regist.tif"), lambda n: n.endswith(".TIF"), lambda n: "stitch" in n.lower() and n.lower().endswith(".tif"), lambda n: n.lower().endswith((".tif", ".tiff")))
    for rule in rules:
        found = [n for n in names if rule(n)]
        if found:
            plain = [n for n in found if "mask" not in n.lower() and "tissue_cut" not in n.lower()]
            return f"{folder}/{(plain or found)[0]}"
    return None


def _picked(spark: SparkSession, folder: str, found: list[str], what: str) -> str:
    if not found:
        raise FileNotFoundError(f"{folder} has no {what}")
    if len(found) > 1:
        warnings.warn(f"{folder} has {found}; the first is read", stacklevel=3)
    return f"{folder}/{found[0]}"


def cellbin_file(spark: SparkSession, folder: str) -> str:
    names = [n for n in files.listed(spark, folder) if n.lower().endswith(".gef")]
    return _picked(spark, folder, [n for n in names if "cellbin" in n.lower()] or names, "cell bin file")


def tissue_file(spark: SparkSession, folder: str) -> str:
    names = [n for n in files.listed(spark, folder) if n.endswith(".gef")]
    return _picked(spark, folder, [n for n in names if "tissue" in n] or [n for n in names if "cellbin" not in n.lower()], "tissue file")


def segmentation_file(spark: SparkSession, folder: str, given: str = "graphclust_annotated_cell_segmentations.geojson") -> str:
    """The given file, else the first of the usual names that is there, with a warning."""
    if files.exists(spark, f"{folder}/{given}"):
        return f"{folder}/{given}"
    others = ("graphclust_annotated_cell_segmentations.geojson", "annotated_cell_segmentations.geojson", "cell_segmentations.geojson")
    for other in others:
        if files.exists(spark, f"{folder}/{other}"):
            warnings.warn(f"{given} is missing; {other} is read", stacklevel=2)
            return f"{folder}/{other}"
    raise FileNotFoundError(f"{folder} has none of {[given, *others]}")


# Data sets


def sample_of(folder: str) -> str:
    return files.name_of(files.parent(folder, 2)) if files.name_of(folder) == "outs" else files.name_of(folder)


def _pictures(spark: SparkSession, folder: str, scale: str) -> tuple[DataFrame | None, dict]:
    paths = {"hires": f"{folder}/spatial/tissue_hires_image.png", "lowres": f"{folder}/spatial/tissue_lowres_image.png"}
    return images(spark, paths), files.json_file(spark, f"{folder}/{scale}")


def read_hd_bin(spark: SparkSession, folder: str, sample: str | None = None, binsize: int = 16, table: str = "spatial/tissue_positions.parquet", scale: str = "spatial/scalefactors_json.json") -> dict:
    """counts, cells (with x and y), images, scalefactors, sample and binsize of a folder of bins. Every barcode must have one position."""
    counts = counts_of(spark, folder)
    cells = coordinates(checked_left_join(counts.select("cell").distinct(), positions(spark, f"{folder}/{table}"), "cell"))
    pictures, factors = _pictures(spark, folder, scale)
    return {"counts": counts, "cells": cells, "images": pictures, "scalefactors": factors, "sample": sample or sample_of(folder), "binsize": binsize}


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(ord, <properties>, vertices) of the outer rings of a file's polygons. The file is one JSON value."""
    rows = spark.read.option("multiLine", True).json(path).select(F.posexplode("features").alias("ord", "f"))
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))
    closed = F.get(ring, F.lit(0)) == F.element_at(ring, -1)
    return rows.select("ord", "f.properties.*", F.when(closed, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring).alias("vertices"))


def aligned(cells: DataFrame, others: DataFrame, key: str, what: str) -> DataFrame:
    """Rows of both by key; those of one alone are counted in warnings, and no common row is an error."""
    out = cells.join(others, key)
    if not out.take(1):
        raise ValueError(f"no {key} is common to the matrix and {what}")
    for a, b, text in ((cells, others, f"cells of the matrix have no {what}"), (others, cells, f"rows of {what} have no cell of the matrix")):
        if n := a.select(key).join(b.select(key), key, "left_anti").count():
            warnings.warn(f"{n} {text}", stacklevel=3)
    return out


CLASS = "struct<name: string, color: array<int>>"


def classification(column: str, kind: str):
    """A column of classifications as (name, color): structs as they are, texts of dicts with either kind of quotes."""
    c = F.col(column)
    return c if kind.startswith("struct") else F.from_json(F.regexp_replace(F.regexp_replace(c, r"\bNone\b", "null"), r"\(([^()]*)\)", "[$1]"), CLASS, {"allowSingleQuotes": "true"})


def class_colours(table: DataFrame, column: str = "classification") -> dict[str, str]:
    """#rrggbb by class name: of a name with more than one colour the last in order of text, malformed ones left out. Classes are few."""
    kind = dict(table.dtypes)[column]
    c = classification(column, kind)
    rows = table.select(c["name"].alias("name"), c["color"].alias("rgb")).where("name is not null and size(rgb) >= 3")
    rows = rows.select("name", F.format_string("#%02x%02x%02x", F.col("rgb")[0].cast("int"), F.col("rgb")[1].cast("int"), F.col("rgb")[2].cast("int")).alias("colour"))
    return {r["name"]: r["colour"] for r in rows.groupBy("name").agg(F.max("colour").alias("colour")).collect()}


def read_hd_cells(spark: SparkSession, folder: str, sample: str | None = None, segmentation: str = "graphclust_annotated_cell_segmentations.geojson", h5: str = "filtered_feature_cell_matrix.h5", directory: str = "filtered_feature_cell_matrix", scale: str = "spatial/scalefactors_json.json") -> dict:
    """counts, cells (x, y, vertices, geometry as WKT, classification) and colours of segmented cells."""
    shapes = geojson(spark, segmentation_file(spark, folder, segmentation))
    if "cell_id" not in shapes.columns:
        raise ValueError("the polygons have no cell_id")
    shapes = shapes.withColumn("cell", sc.cell_name(F.col("cell_id")))
    if twice := [r["cell"] for r in shapes.groupBy("cell").count().where("count > 1").limit(5).collect()]:
        raise ValueError(f"polygons with the same id: {twice}")
    counts = counts_of(spark, folder, h5, directory)
    cells = aligned(counts.select("cell").distinct(), shapes, "cell", "polygons")
    centre = sc.centroid(F.col("vertices"))
    cells = cells.withColumn("x", centre["x"]).withColumn("y", centre["y"]).withColumn("geometry", sc.wkt(F.col("vertices")))
    colours = class_colours(cells) if "classification" in cells.columns else {}
    if "classification" in cells.columns:
        cells = cells.withColumn("classification", classification("classification", dict(cells.dtypes)["classification"])["name"])
    pictures, factors = _pictures(spark, folder, scale)
    factors.setdefault("spot_diameter_fullres", factors["fiducial_diameter_fullres"] / 40 if "fiducial_diameter_fullres" in factors else 20.0)
    return {"counts": counts.join(cells.select("cell"), "cell", "left_semi"), "cells": cells, "colours": colours, "images": pictures, "scalefactors": factors, "sample": sample or sample_of(folder)}


def boundaries(table: DataFrame) -> DataFrame:
    """(cell_id, vertices) of a long vertex table (ord, cell_id, vertex_x, vertex_y), in order, three vertices at least."""
    rows = table.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.col("vertex_x").cast("double").alias("x"), F.col("vertex_y").cast("double").alias("y")))).alias("v"))
    return rows.where(F.size("v") >= 3).select("cell_id", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("vertices"))


def _outlines(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame | None:
    if not files.exists(spark, path):
        return None
    rows = spark.read.parquet(path).select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("ord")).join(cells.select("cell_id"), "cell_id", "left_semi")
    return boundaries(rows).where(gm.simple(F.col("vertices")))


def read_xenium_cells(spark: SparkSession, folder: str, sample: str | None = None, h5: str = "cell_feature_matrix.h5", directory: str = "cell_feature_matrix", slices: dict | None = None) -> dict:
    """counts, cells (their known columns, x, y), outlines of cells and nuclei, metadata and scalefactors of a section. slices: arguments of spatial.slices."""
    counts = counts_of(spark, folder, h5, directory)
    if not files.exists(spark, f"{folder}/cells.parquet"):
        raise FileNotFoundError(f"{folder}/cells.parquet is missing")
    table = spark.read.parquet(f"{folder}/cells.parquet")
    known = table.select(F.col("cell_id").cast("string").alias("cell_id"), *(c for c in CELL_COLUMNS if c in table.columns))
    cells = aligned(counts.select(F.col("cell").alias("cell_id")).distinct(), known, "cell_id", "the cells' table")
    cells = cells.withColumn("x", F.col("x_centroid").cast("float").cast("double")).withColumn("y", F.col("y_centroid").cast("float").cast("double"))
    experiment, panel = files.json_file(spark, f"{folder}/experiment.xenium"), files.json_file(spark, f"{folder}/gene_panel.json")
    if slices is not None:
        found = sp.slices(cells.select(F.col("cell_id").alias("id"), "x", "y"), **slices)
        cells = cells.join(found.select(F.col("id").alias("cell_id"), "slice_cluster", "slice_id"), "cell_id")
    factors = {"microns_per_pixel": float(experiment.get("pixel_size", 0.2125)), "tissue_hires_scalef": 1.0, "tissue_lowres_scalef": 1.0}
    return {"counts": counts.join(cells.select(F.col("cell_id").alias("cell")), "cell", "left_semi"), "cells": cells, "polygons": _outlines(spark, f"{folder}/cell_boundaries.parquet", cells), "nuclei": _outlines(spark, f"{folder}/nucleus_boundaries.parquet", cells), "experiment": experiment, "gene_panel": panel, "scalefactors": factors, "sample": sample or sample_of(folder)}


# Bin files of sequencing chips


def gene_expression_text(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, gene, value) of a tab-separated file with # comments, plain or as .gz; the counts' column is MIDCounts or MIDCount."""
    table = spark.read.option("sep", "\t").option("comment", "#").option("header", True).csv(path)
    count = next((c for c in ("MIDCounts", "MIDCount") if c in table.columns), None)
    if not count:
        raise ValueError(f"no counts among {table.columns}")
    return table.select(F.col("x").cast("long"), F.col("y").cast("long"), F.col("geneID").alias("gene"), F.col(count).cast("double").alias("value"))


def _binned(rows: DataFrame, size: int, packed: bool) -> tuple[DataFrame, DataFrame]:
    """Counts (cell, gene, value) and cells (cell, x, y) of square bins. packed: names are the decimal of (bx << 32) | by, else bx_by."""
    name = (F.shiftleft(F.col("bx"), 32).bitwiseOR(F.col("by"))).cast("string") if packed else F.concat_ws("_", "bx", "by")
    summed = rows.groupBy(F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"), "gene").agg(F.sum("value").alias("value")).withColumn("cell", name)
    cells = summed.select("cell", (F.col("bx") * size + size // 2).cast("double").alias("x"), (F.col("by") * size + size // 2).cast("double").alias("y")).distinct()
    return summed.select("cell", "gene", "value"), cells


def _bin_metadata(sample: str, size: int, attributes: dict) -> tuple[dict, dict]:
    nm = int(attributes.get("resolution", 500))
    span = {a: [int(attributes.get(f"min{a.upper()}", 0)), int(attributes.get(f"max{a.upper()}", 0))] for a in "xy"}
    metadata = {"sample_id": sample, "pixel_size_um": nm / 1000, "resolution_nm": nm, "bin_size": size, "bin_level": int(attributes.get("bin_level", 1)), "bin_type": "square_bins", "coordinate_range": span}
    return metadata, {"spot_diameter_fullres": float(size), "tissue_hires_scalef": 1.0, "tissue_lowres_scalef": 1.0}


def stem(path: str) -> str:
    return files.name_of(path).split(".")[0]


def bins_of_text(spark: SparkSession, path: str, size: int, sample: str | None = None) -> dict:
    counts, cells = _binned(gene_expression_text(spark, path), size, False)
    sample = sample or files.name_of(path).removesuffix(".gz").removesuffix(".gem").removesuffix(".tissue")
    metadata, factors = _bin_metadata(sample, size, {})
    return {"counts": counts, "cells": cells, "metadata": metadata, "scalefactors": factors, "sample": sample}


#: Bits of a place within a block: entries and ranges of genes meet block by block.
BLOCK = 6


def named_entries(expression: DataFrame, genes: DataFrame) -> DataFrame:
    """(x, y, gene, value) of entries (ord, x, y, count) in order of genes (gene, offset, count): a join of places with ranges, by the blocks of places that a range touches."""
    g = genes.select("gene", F.col("offset").cast("long").alias("start"), (F.col("offset") + F.col("count")).cast("long").alias("stop")).where("start < stop")
    g = g.withColumn("block", F.explode(F.sequence(F.shiftright("start", BLOCK), F.shiftright(F.col("stop") - 1, BLOCK))))
    rows = expression.withColumn("__block", F.shiftright(F.col("ord").cast("long"), BLOCK))
    rows = rows.join(g, (F.col("__block") == F.col("block")) & (F.col("ord") >= F.col("start")) & (F.col("ord") < F.col("stop")))
    return rows.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "gene", F.col("count").cast("double").alias("value"))


def bins_of_chip(spark: SparkSession, path: str, size: int, sample: str | None = None, by_name: bool = True, image: str | None = None) -> dict:
    """Square bins of a chip's file: tables expression (ord, x, y, count) and gene (gene, offset, count), attributes in attributes.json."""
    genes = hdf5_table(spark, path, "gene")
    if not by_name:
        from pyspark.sql import Window

        genes = genes.withColumn("gene", (F.row_number().over(Window.orderBy("offset")) - 1).cast("string"))  # a row for each gene
    counts, cells = _binned(named_entries(hdf5_table(spark, path, "expression"), genes), size, True)
    sample = sample or stem(path)
    metadata, factors = _bin_metadata(sample, size, files.json_file(spark, f"{path}.attributes.json"))
    return {"counts": counts, "cells": cells, "metadata": metadata, "scalefactors": factors, "sample": sample, "images": tissue_image(spark, files.parent(path), image)}


def read_chip_bins(spark: SparkSession, path: str, size: int = 50, sample: str | None = None, by_name: bool = True, image: str | None = None) -> dict:
    """Bins of a .gef, or of a .gem(.gz) without a .gef beside it."""
    if path.lower().endswith(".gef"):
        return bins_of_chip(spark, path, size, sample, by_name, image)
    if path.lower().endswith((".gem", ".gem.gz")):
        beside = path[: path.lower().rindex(".gem")] + ".gef"
        if files.exists(spark, beside) or files.exists(spark, f"{beside}.expression"):
            return bins_of_chip(spark, beside, size, sample, by_name, image)
        warnings.warn(f"{path} is read as text", stacklevel=2)
        return bins_of_text(spark, path, size, sample)
    raise ValueError(f"{path} is neither .gef nor .gem")


def cell_entries(cells: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, gene, value) of entries (ord, gene, count) by the cells' slices (id, offset, gene_count), of any length."""
    live = cells.where("gene_count > 0")
    places = live.select("id", F.explode(F.sequence(F.col("offset").cast("long"), (F.col("offset") + F.col("gene_count") - 1).cast("long"))).alias("ord"))
    return places.join(entries, "ord").groupBy("id", "gene").agg(F.sum(F.col("count").cast("double")).alias("value"))


def read_chip_cells(spark: SparkSession, path: str, sample: str | None = None, by_name: bool = True, image: str | None = None) -> dict:
    """Cells of a cell bin file: tables cell (id, x, y, offset, area, dnb_count, gene_count, exp_count), border (id, offsets array of (dx, dy)),
    exp (ord, gene_id, count) and gene (gene_id, gene)."""
    path = path if path.lower().endswith(".gef") else cellbin_file(spark, path)
    cells, border, exp, genes = (hdf5_table(spark, path, t) for t in ("cell", "border", "exp", "gene"))
    entries = cell_entries(cells, exp.withColumnRenamed("gene_id", "gene"))
    label = genes.select(F.col("gene_id").alias("gene"), (F.col("gene") if by_name else F.col("gene_id").cast("string")).alias("name"))
    name = F.concat(F.lit("cell_"), F.col("id").cast("string"))
    counts = entries.join(F.broadcast(label), "gene").select(name.alias("cell"), F.col("name").alias("gene"), "value")
    ring = gm.border_polygon(F.col("offsets"), F.col("x"), F.col("y"))
    rows = cells.join(border, "id", "left").withColumn("vertices", ring).withColumn("geometry", sc.wkt(F.col("vertices")))
    rows = rows.select(name.alias("cell"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "area", "dnb_count", "gene_count", "exp_count", "vertices", "geometry")
    median = cells.agg(F.percentile("area", 0.5)).first()[0]
    attributes = files.json_file(spark, f"{path}.attributes.json")
    sample = sample or stem(path)
    metadata, factors = _bin_metadata(sample, 1, attributes)
    metadata["bin_type"] = "cell_bins"
    factors["spot_diameter_fullres"] = 2 * math.sqrt(median) if median else 1.0
    return {"counts": counts, "cells": rows, "metadata": metadata, "scalefactors": factors, "sample": sample, "images": tissue_image(spark, files.parent(path), image)}


# Sinks


def write_annotation(sliced: DataFrame, path: str) -> None:
    """Parquet with exactly cell_id, x_centroid, y_centroid, slice_cluster, slice_id, of spatial.slices()."""
    sliced.select(F.col("id").alias("cell_id"), F.col("x").alias("x_centroid"), F.col("y").alias("y_centroid"), "slice_cluster", "slice_id").write.parquet(path)


def write_dataset(data: dict, folder: str) -> None:
    """The tables of a data set as Parquet, its dicts as JSON lines."""
    for name, value in data.items():
        if isinstance(value, DataFrame):
            value.write.mode("overwrite").parquet(f"{folder}/{name}")
    import json

    spark = next(v for v in data.values() if isinstance(v, DataFrame)).sparkSession
    plain = {k: v for k, v in data.items() if not isinstance(v, DataFrame)}
    spark.createDataFrame([(json.dumps(plain),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_plain")


def read_dataset(spark: SparkSession, folder: str) -> dict:
    import json

    out = {n: spark.read.parquet(f"{folder}/{n}") for n in files.listed(spark, folder) if n != "_plain"}
    return out | json.loads(spark.read.text(f"{folder}/_plain").first()["value"])


def restored(cells: DataFrame) -> DataFrame:
    """cells with vertices from their WKT column `geometry`; those that have vertices stay."""
    return cells if "vertices" in cells.columns else cells.withColumn("vertices", sc.parse_wkt(F.col("geometry")))
