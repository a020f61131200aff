"""Readers on files that the tests write."""

import gzip
import json
import struct

import pytest

from glyphloom.operators import spatial as sp
from glyphloom.sources import files, readers


def write_matrix(folder, entries, genes, cells, zipped=False):
    folder.mkdir(parents=True, exist_ok=True)
    text = "%%MatrixMarket matrix coordinate integer general\n%made by a test\n" + f"{len(genes)} {len(cells)} {len(entries)}\n" + "".join(f"{g} {c} {v}\n" for g, c, v in entries)
    for name, body in (("matrix.mtx", text), ("features.tsv", "".join(f"id{g}\t{g}\tGene Expression\n" for g in genes)), ("barcodes.tsv", "".join(f"{c}\n" for c in cells))):
        if zipped:
            (folder / f"{name}.gz").write_bytes(gzip.compress(body.encode()))
        else:
            (folder / name).write_text(body)


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0) + b"rest"


@pytest.mark.parametrize("zipped", [False, True])
def test_matrix_market(spark, tmp_path, zipped):
    write_matrix(tmp_path / "m", [(1, 1, 5), (2, 1, 1), (2, 3, 3)], ["g1", "g2"], ["c1", "c2", "c3"], zipped)
    assert {tuple(r) for r in readers.matrix_market(spark, str(tmp_path / "m")).collect()} == {("c1", "g1", 5), ("c1", "g2", 1), ("c3", "g2", 3)}
    write_matrix(tmp_path / "one", [(1, 1, 1)], ["g"], ["c"], zipped)  # the entry looks like the line of dimensions
    assert [tuple(r) for r in readers.matrix_market(spark, str(tmp_path / "one")).collect()] == [("c", "g", 1)]
    assert [r.gene_id for r in readers.features(spark, str(tmp_path / "m")).orderBy("ord").collect()] == ["idg1", "idg2"]


def test_numbered_lines_over_splits(spark, tmp_path):
    (tmp_path / "t").write_text("".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.numbered_lines(spark, str(tmp_path / "t"))
        assert rows.rdd.getNumPartitions() > 3 and all(r.line == f"line {r.i}" for r in rows.collect()) and rows.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.fixture
def outs(tmp_path):
    folder = tmp_path / "mouse" / "binned" / "outs"
    write_matrix(folder / "filtered_feature_bc_matrix", [(1, 1, 5), (2, 2, 7)], ["g1", "g2"], ["c1", "c2"])
    (folder / "spatial").mkdir()
    (folder / "spatial/tissue_positions.csv").write_text("barcode\tpxl_row_in_fullres\tpxl_col_in_fullres\nc1\t1\t2\nc2\t3\t4\nc3\t5\t6\n")
    (folder / "spatial/scalefactors_json.json").write_text(json.dumps({"tissue_hires_scalef": 0.5}))
    for n in ("hires", "lowres"):
        (folder / f"spatial/tissue_{n}_image.png").write_bytes(png(30, 20))
    return folder


def test_hd_bins(spark, outs):
    data = readers.read_hd_bin(spark, str(outs))
    assert data["sample"] == "mouse" and data["scalefactors"] == {"tissue_hires_scalef": 0.5}
    assert {r.cell: (r.x, r.y) for r in data["cells"].collect()} == {"c1": (2, 1), "c2": (4, 3)}
    assert {(r.key, r.height, r.width, r.channels) for r in data["images"].collect()} == {("hires", 20, 30, 3), ("lowres", 20, 30, 3)}
    with open(outs / "spatial/tissue_positions.csv", "a") as f:
        f.write("c2\t3\t4\n")
    with pytest.raises(ValueError, match="unique"):
        readers.read_hd_bin(spark, str(outs))
    (outs / "spatial/tissue_positions.csv").write_text("barcode,x,y\nc1,1,2\n")
    with pytest.raises(ValueError, match="no position"):
        readers.read_hd_bin(spark, str(outs))
    (outs / "spatial/tissue_positions.csv").write_text("barcode,x,y\nc1,1,2\nc2,,2\n")
    with pytest.raises(ValueError, match="null"):
        readers.read_hd_bin(spark, str(outs))


def test_staged_matrix_comes_first(spark, outs):
    spark.createDataFrame([("c1", "g9", 2.0), ("c2", "g9", 1.0)], "cell string, gene string, value double").write.parquet(str(outs / "filtered_feature_bc_matrix.h5.matrix"))
    assert {r.gene for r in readers.read_hd_bin(spark, str(outs))["counts"].collect()} == {"g9"}


def test_segmented_cells(spark, tmp_path):
    folder = tmp_path / "s"
    write_matrix(folder / "filtered_feature_cell_matrix", [(1, 1, 5), (1, 2, 2), (1, 3, 1)], ["g"], ["cellid_000000001-1", "cellid_000000002-1", "cellid_000000009-1"])
    square = lambda x: [[[x, 0], [x + 2, 0], [x + 2, 2], [x, 2], [x, 0]]]
    feature = lambda i, name: {"type": "Feature", "properties": {"cell_id": i, "classification": f"{{'name': '{name}', 'color': [255, 0, {i}]}}"}, "geometry": {"type": "Polygon", "coordinates": square(i * 10)}}
    (folder / "cell_segmentations.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(1, "A"), feature(2, "B"), feature(7, "B")]}))
    with pytest.warns(UserWarning):
        data = readers.read_hd_cells(spark, str(folder))
    got = {r.cell_id: r for r in data["cells"].collect()}
    assert set(got) == {1, 2} and (got[1].x, got[1].y, got[2].classification) == (11, 1, "B") and got[1].geometry.startswith("POLYGON ((10.0 0.0")
    assert data["colours"] == {"A": "#ff0001", "B": "#ff0002"} and data["scalefactors"]["spot_diameter_fullres"] == 20 and data["counts"].count() == 2
    with pytest.raises(FileNotFoundError):
        readers.segmentation_file(spark, str(tmp_path))


def test_section_cells(spark, tmp_path):
    folder = tmp_path / "x"
    write_matrix(folder / "cell_feature_matrix", [(1, 1, 5), (1, 2, 2)], ["g"], ["a-1", "b-1"])
    spark.createDataFrame([("a-1", 1.0, 2.0, 9.0), ("b-1", 3.0, 4.0, 8.0), ("z-1", 0.0, 0.0, 0.0)], "cell_id string, x_centroid double, y_centroid double, cell_area double").write.parquet(str(folder / "cells.parquet"))
    ring = [("a-1", x, y) for x, y in [(0, 0), (1, 0), (1, 1)]] + [("b-1", x, y) for x, y in [(0, 0), (2, 2), (2, 0), (0, 2)]]
    spark.createDataFrame([(c, float(x), float(y)) for c, x, y in ring], "cell_id string, vertex_x float, vertex_y float").coalesce(1).write.parquet(str(folder / "cell_boundaries.parquet"))
    (folder / "experiment.xenium").write_text(json.dumps({"pixel_size": 0.25}))
    with pytest.warns(UserWarning):
        data = readers.read_xenium_cells(spark, str(folder), slices={"eps": 5, "min_samples": 1, "min_cells": 1})
    assert {r.cell_id: (r.x, r.y, r.cell_area, r.slice_id) for r in data["cells"].collect()} == {"a-1": (1, 2, 9, "S001"), "b-1": (3, 4, 8, "S001")}
    assert {r.cell_id: [(v.x, v.y) for v in r.vertices] for r in data["polygons"].collect()} == {"a-1": [(0, 0), (1, 0), (1, 1)]}  # b's ring crosses itself
    assert data["nuclei"] is None and data["scalefactors"]["microns_per_pixel"] == 0.25 and data["gene_panel"] == {}


def test_chip_bins(spark, tmp_path):
    path = tmp_path / "chip.tissue.gem.gz"
    path.write_bytes(gzip.compress(b"#FileFormat=x\n#y\ngeneID\tx\ty\tMIDCount\ng1\t1\t2\t3\ng1\t9\t2\t4\ng2\t11\t12\t5\n"))
    with pytest.warns(UserWarning):
        data = readers.read_chip_bins(spark, str(path), 10)
    assert data["sample"] == "chip" and {tuple(r) for r in data["counts"].collect()} == {("0_0", "g1", 7), ("1_1", "g2", 5)}
    assert {tuple(r) for r in data["cells"].collect()} == {("0_0", 5, 5), ("1_1", 15, 15)}
    at = str(tmp_path / "chip.tissue.gef")
    spark.createDataFrame([(0, 1, 2, 3), (1, 9, 2, 4), (2, 11, 12, 5)], "ord long, x int, y int, count int").write.parquet(f"{at}.expression")
    spark.createDataFrame([("g1", 0, 2), ("g0", 2, 0), ("g2", 2, 1)], "gene string, offset int, count int").write.parquet(f"{at}.gene")
    (tmp_path / "chip.tissue.gef.attributes.json").write_text(json.dumps({"resolution": 700, "maxX": 11}))
    data = readers.read_chip_bins(spark, str(path), 10)
    assert {tuple(r) for r in data["counts"].collect()} == {("0", "g1", 7), (str((1 << 32) + 1), "g2", 5)} and data["metadata"]["pixel_size_um"] == 0.7
    with pytest.raises(ValueError):
        readers.read_chip_bins(spark, "x.txt")
    (tmp_path / "bad.gem").write_text("geneID\tx\ty\tn\ng\t1\t1\t1\n")
    with pytest.raises(ValueError, match="counts"):
        readers.gene_expression_text(spark, str(tmp_path / "bad.gem"))


def test_named_entries_by_equal_keys(spark):
    """Ranges of any length, empty, touching or crossing, against loops; entries never meet every range."""
    ranges = [("a", 0, 70), ("b", 70, 0), ("c", 70, 1), ("d", 71, 500), ("e", 100, 30), ("f", 571, 4), ("g", 63, 2), ("h", 3_000_000_000, 3), ("i", 5, -3)]
    places = [*range(600), 2_999_999_999, 3_000_000_000, 3_000_000_002, 3_000_000_003]
    genes = spark.createDataFrame(ranges, "gene string, offset long, count long")
    entries = spark.createDataFrame([(p, p % 9, p % 5, p % 3) for p in places], "ord long, x int, y int, count int")
    got = readers.named_entries(entries, genes)
    assert sorted(map(tuple, got.collect())) == sorted((p % 9, p % 5, g, float(p % 3)) for p in places for g, start, n in ranges if start <= p < start + n)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_chip_cells(spark, tmp_path):
    at = str(tmp_path / "s.cellbin.gef")
    (tmp_path / "s.cellbin.gef").write_bytes(b"")
    spark.createDataFrame([(0, 10, 20, 0, 4, 9, 2, 8), (1, 30, 40, 2, 16, 9, 1, 8)], "id int, x int, y int, offset int, area int, dnb_count int, gene_count int, exp_count int").write.parquet(f"{at}.cell")
    spark.createDataFrame([(0, [{"dx": a, "dy": b} for a, b in [(1, 0), (0, 1), (-1, 0)]]), (1, [{"dx": 32767, "dy": 32767}] * 4)], "id int, offsets array<struct<dx: short, dy: short>>").write.parquet(f"{at}.border")
    spark.createDataFrame([(0, 1, 5), (1, 0, 2), (2, 1, 3)], "ord long, gene_id int, count int").write.parquet(f"{at}.exp")
    spark.createDataFrame([(0, "ga"), (1, "gb")], "gene_id int, gene string").write.parquet(f"{at}.gene")
    data = readers.read_chip_cells(spark, str(tmp_path))
    assert {tuple(r) for r in data["counts"].collect()} == {("cell_0", "gb", 5), ("cell_0", "ga", 2), ("cell_1", "gb", 3)}
    got = {r.cell: r for r in data["cells"].collect()}
    assert len(got["cell_0"].vertices) == 3 and len(got["cell_1"].vertices) == 4 and got["cell_1"].area == 16
    assert abs(data["scalefactors"]["spot_diameter_fullres"] - 2 * 10**0.5) < 1e-9


def test_found_files(spark, tmp_path):
    for n in ("x_mask.tif", "y_regist.tif", "z.tif", "b.gef", "a.tissue.gef"):
        (tmp_path / n).write_bytes(b"")
    assert readers.register_image(spark, str(tmp_path)).endswith("y_regist.tif") and readers.tissue_file(spark, str(tmp_path)).endswith("a.tissue.gef")
    with pytest.warns(UserWarning):
        assert readers.cellbin_file(spark, str(tmp_path)).endswith("a.tissue.gef")
    order = struct.pack("<2sHIH", b"II", 42, 8, 2) + struct.pack("<HHII", 256, 4, 1, 640) + struct.pack("<HHII", 257, 4, 1, 480)
    assert readers.image_size(order) == (480, 640, 1) and readers.image_size(png(3, 2)) == (2, 3, 3)


def test_sinks(spark, tmp_path):
    points = spark.createDataFrame([(i, float(i), 0.0) for i in range(12)], "id long, x double, y double")
    readers.write_annotation(sp.slices(points, 2, 2, 3), str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.columns == ["cell_id", "x_centroid", "y_centroid", "slice_cluster", "slice_id"] and back.count() == 12
    readers.write_dataset({"cells": points, "sample": "s", "scalefactors": {"a": 1.5}}, str(tmp_path / "d"))
    data = readers.read_dataset(spark, str(tmp_path / "d"))
    assert data["cells"].count() == 12 and data["sample"] == "s" and data["scalefactors"] == {"a": 1.5}
    cells = spark.createDataFrame([("a", "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "cell string, geometry string")
    assert len(readers.restored(cells).first().vertices) == 3
