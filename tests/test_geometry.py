"""Polygons, regions and plot frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import scalars as sc
from glyphloom.operators import frames as fr
from glyphloom.operators import geometry as gm
from glyphloom.operators import regions as rg

RING = "id int, vertices array<struct<x: double, y: double>>"


def rings(spark, *shapes):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in s]) for i, s in enumerate(shapes)], RING)


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, np.roll(ring, -1, 0), strict=True))) / 2


def test_hulls_hold_all_points_and_no_more():
    r = np.random.default_rng(1)
    for points in (r.integers(0, 9, (40, 2)), r.normal(size=(5, 2)), np.array([[0, 0], [1, 1], [3, 3]]), np.array([[2.0, 2.0]])):
        h = gm.hull(points)
        assert {tuple(p) for p in h} <= {tuple(map(float, p)) for p in points}
        if len(h) > 2:
            for a, b in zip(h, np.roll(h, -1, 0), strict=True):
                assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= -1e-9 for p in points)
    assert math.isclose(area(gm.cell_polygon(np.array([[5, 5]]), 1.5)), 9)
    flat = gm.cell_polygon(np.array([[0, 0], [4, 0], [9, 0]]), 2.0)
    assert math.isclose(area(flat), 36 + math.pi * 4, rel_tol=0.02)


def test_cells_of_bins(spark):
    r = random.Random(2)
    bins = [(f"b{x}_{y}", r.choice([0, 1, 2, 3]), float(x), float(y)) for x in range(8) for y in range(8)]
    counts = [(b[0], f"g{k}", float(r.randint(1, 5))) for b in bins for k in range(3)]
    cells, sums = gm.cells_of_bins(spark.createDataFrame(bins, "bin string, label int, x double, y double"), spark.createDataFrame(counts, "bin string, gene string, value double"), 2.0, 1.0)
    got = {x.object_id: x for x in cells.collect()}
    assert set(got) == {b[1] for b in bins if b[1]}
    for label, x in got.items():
        own = [b for b in bins if b[1] == label]
        assert x.cell == f"cellid_{label:09d}-1" and x.bin_count == len(own) and math.isclose(x.x, sum(b[2] for b in own) / len(own))
        want = gm.cell_polygon(np.array([b[2:] for b in own]), 1.0)
        assert math.isclose(area(np.array([(v.x, v.y) for v in x.vertices])), area(want), rel_tol=1e-9)
    label = {b[0]: b[1] for b in bins}
    want = {}
    for b, g, v in counts:
        if label[b]:
            want[f"cellid_{label[b]:09d}-1", g] = want.get((f"cellid_{label[b]:09d}-1", g), 0) + v
    assert {(x.cell, x.gene): x.value for x in sums.collect()} == want
    assert math.isclose(gm.spot_diameter(3.0, cells), 3 * math.sqrt(sum(x.bin_count for x in got.values()) / len(got)))


def test_validity_contact_and_bounds(spark):
    square, bow, far, inner, line = [(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 4), (4, 0), (0, 4)], [(9, 9), (10, 9), (10, 10)], [(1, 1), (2, 1), (2, 2)], [(0, 0), (1, 1), (2, 2)]
    corner, nan = [(4, 4), (6, 4), (6, 6)], [(0, 0), (float("nan"), 1), (2, 2)]
    df = rings(spark, square, bow, far, inner, line, corner, nan)
    assert [x.ok for x in df.orderBy("id").select(gm.simple(F.col("vertices")).alias("ok")).collect()][:6] == [True, False, True, True, False, True]
    one = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in square))
    assert [x.ok for x in df.where("id < 6").orderBy("id").select(gm.intersects(F.col("vertices"), one).alias("ok")).collect()] == [True, True, False, True, True, True]
    assert [x.ok for x in df.orderBy("id").select(gm.valid_bounds(F.col("vertices")).alias("ok")).collect()] == [True] * 6 + [False]
    assert gm.drawable(df)[1] and not gm.drawable(df.where("id < 6"))[1]
    offsets = spark.createDataFrame([(0, [{"dx": a, "dy": b} for a, b in [(1, 0), (0, 1), (-1, -1), (32767, 32767)]]), (1, [{"dx": 32767, "dy": 32767}])], "id int, o array<struct<dx: short, dy: short>>")
    got = [[(v.x, v.y) for v in x.r] for x in offsets.orderBy("id").select(gm.border_polygon(F.col("o"), F.lit(10), F.lit(20)).alias("r")).collect()]
    assert got[0] == [(11, 20), (10, 21), (9, 19)] and set(got[1]) == {(5, 15), (15, 15), (15, 25), (5, 25)}


def test_geometries_follow_the_cells(spark):
    shapes = spark.createDataFrame([(c, [{"x": 0.0, "y": 0.0}]) for c in "abc"], "cell_id string, vertices array<struct<x: double, y: double>>")
    obs = spark.createDataFrame([("c", 0), ("a", 1)], "cell_id string, ord int")
    assert [x.cell_id for x in gm.kept_geometries(shapes, obs).orderBy("ord").collect()] == ["c", "a"]
    assert gm.kept_geometries(shapes, obs.withColumn("cell_id", F.lit("z"))).count() == 3
    cells = spark.createDataFrame([("a", None), ("d", "POLYGON ((0 0, 1 0, 1 1, 0 0))"), ("e", "junk")], "cell_id string, geometry string")
    assert {x.cell_id: x.vertices and len(x.vertices) for x in gm.geometry_of(cells, shapes).collect()} == {"a": 1, "d": 3, "e": None}


def test_regions(spark):
    s = rg.RegionSet().add(rg.rectangle(4, 4, 0, 0)).add(rg.ellipse(2, 2, 8, 8))
    assert [n for n, _ in s.regions] == ["ROI_1", "ROI_2"] and len(s.regions[1][1]) == 64
    s = s.rename("ROI_1", "old")
    assert [n for n, _ in s.regions] == ["ROI_2", "old"] and [n for n, _ in s.undo().regions] == ["ROI_2"] and s.clear().regions == ()
    with pytest.raises(KeyError):
        s.rename("none", "x")
    with pytest.raises(KeyError):
        s.add(rg.rectangle(0, 0, 1, 1), "old")
    with pytest.raises(ValueError):
        rg.lasso([(0, 0), (1, 1)])
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 3.0, 3.5), (2, 7.0, 5.0), (3, 0.0, 0.0), (4, 9.0, 9.0)], "cell_id int, x double, y double")
    assert {x.cell_id: x.ROI for x in s.labelled(points).collect()} == {0: "old", 1: "old", 2: "ROI_2", 3: None, 4: None}
    cells = rings(spark, [(-1, -1), (0, -1), (0, 0)], [(20, 20), (21, 20), (21, 21)]).withColumnRenamed("id", "cell_id").unionByName(spark.createDataFrame([(9, None)], "cell_id int, vertices array<struct<x: double, y: double>>"))
    assert rg.mode_of(cells) == "cellbin" and {x.cell_id: x.ROI for x in s.labelled(cells).collect()} == {0: "old", 1: None, 9: None}
    assert rg.selectable(cells, "cellbin").count() == 2 and s.frame(spark).count() == 2 and s.ids(points, "ROI_2").count() >= 1
    with pytest.raises(ValueError):
        rg.mode_of(cells.select("cell_id"))


def test_colours_and_legends(spark):
    obs = spark.createDataFrame([("a", "10", 1.0), ("b", "2", 3.0), ("c", None, None)], "cell_id string, kind string, size double")
    counts = spark.createDataFrame([("a", "g", 4.0)], "cell string, gene string, value double")
    assert fr.categories(obs, "kind") == ["2", "10"] and fr.legend(["2", "10"], ["#111111"]) == {"2": "#111111", "10": "#111111"} and fr.legend(["x"], {"y": "#0"}) == {"x": "gray"}
    with pytest.raises(ValueError):
        fr.legend(["x"], "red")
    rows, legend = fr.painted(fr.coloured(obs, counts, "kind"))
    assert {x.cell_id: x.fill for x in rows.collect()} == {"a": legend["10"], "b": legend["2"], "c": fr.MISSING}
    rows, legend = fr.painted(fr.coloured(obs, counts, "size"))
    assert {x.cell_id: x.share for x in rows.collect()} == {"a": 0.0, "b": 1.0, "c": None} and not legend
    assert {x.cell_id: x.value for x in fr.coloured(obs, counts, "g").collect()} == {"a": 4.0, "b": 0.0, "c": 0.0}
    own = spark.createDataFrame([("a", "#ff0000"), ("b", None)], "cell_id string, value string")
    assert fr.is_hex(own) and not fr.is_hex(obs.select(F.col("kind").alias("value"))) and fr.painted(own)[0].where("fill = '#ff0000'").count() == 1
    assert fr.of_groups(obs, "kind", ["2"]).count() == 1 and fr.library(["x", "y"]) == "x"
    for bad in (lambda: fr.of_groups(obs, "g", ["2"]), lambda: fr.checked_colours(obs, ["g"], ["zzz"]), lambda: fr.library(["x"], "q")):
        with pytest.raises(ValueError):
            bad()


def test_frames(spark):
    shapes = rings(spark, [(0, 0), (2, 0), (2, 2)], [(5, 5), (6, 5), (6, 6)]).withColumnRenamed("id", "cell_id")
    obs = spark.createDataFrame([(0, "a", "u"), (1, "b", "v"), (2, "b", "v")], "cell_id int, kind string, rim string")
    rows, fills, edges = fr.cell_frame(obs, shapes, colour="kind", edge="rim", groups=["b"])
    (x,) = rows.collect()
    assert x.cell_id == 1 and x.wkt.startswith("POLYGON ((5.0 5.0") and x.fill == fills["b"] and x.edge == edges["v"]
    assert fr.frame_extent(shapes) == (0, 0, 6, 6)
    bins = spark.createDataFrame([(i, float(i % 4) * 2, float(i // 4) * 2, i * 1.0) for i in range(16)], "cell_id int, x double, y double, n double")
    rows, _, side = fr.bin_frame(bins, colour="n", crop=(0, 4, 0, 2))
    assert rows.count() == 6 and side == 2.0
    assert fr.image_crop(100, 200, 0.5, (10, 20, 50, 61)) == ((5, 10, 25, 31), (10, 50, 62, 20)) and fr.image_crop(100, 200, 0.5, (900, 900, 950, 950))[0] == (0, 0, 200, 100)
    assert fr.image_crop(100, 200)[1] == (0, 200, 100, 0)


def test_blends(spark):
    r = np.random.default_rng(3)
    y = r.poisson(1.5, (25, 3)).astype(float)
    counts = spark.createDataFrame([(i, f"g{j}", float(y[i, j])) for i in range(25) for j in range(3) if y[i, j]], "cell int, gene string, value double")
    cells = spark.range(25).select(F.col("id").cast("int").alias("cell"))
    got = {x.cell: x.colour for x in fr.blended(counts, cells, ["g0", "g1"], gamma=0.8).collect()}
    low, high = np.percentile(y[:, :2], [1, 99], axis=0)
    share = np.where(high > low, (np.clip(y[:, :2], low, high) - low) / (high - low), 0)
    for i in range(25):
        total = share[i].sum()
        want = "#e0e0e0" if total <= 0 else "#" + "".join(f"{int(np.rint(np.clip(share[i] @ c / total, 0, 1) ** 0.8 * 255)):02x}" for c in ([1, 0], [0, 1], [0, 0]))
        assert got[i] == want, i
    assert set(fr.faceted(counts, cells, ["g2"])) == {"g2"} and fr.faceted(counts, cells, ["g2"])["g2"].count() == 25
    for genes, colours in ((["g0"], None), (["g0", "none"], None), (["g0", "g1"], ["#000000"])):
        with pytest.raises(ValueError):
            fr.blended(counts, cells, genes, colours)
    assert sc.half_size(2, 0.5) == 2.0 and sc.half_size(2, None) == 1.0
