"""Neighbours, graphs, clusters and slices against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.operators import nearest as ne
from glyphloom.operators import spatial as sp


def frame(spark, xy, extra=None, name="batch"):
    rows = [(i, float(x), float(y)) + ((extra[i],) if extra is not None else ()) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "id long, x double, y double" + (f", {name} {'string' if isinstance(extra[0], str) else 'int'}" if extra is not None else ""))


def cloud(seed, n=400):
    """A dense clump, loose points, one place held by many, and an outlier."""
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(0, 1e-3, (n, 2)), r.uniform(-50, 50, (n, 2)), np.repeat([[3.0, 3.0]], 30, 0), [[1e6, -1e6]]])


def brute(q, t, k, same=None, skip=False):
    out = {}
    for i, p in enumerate(q):
        d = [(math.sqrt((p[0] - x[0]) * (p[0] - x[0]) + (p[1] - x[1]) * (p[1] - x[1])), j) for j, x in enumerate(t) if not (skip and i == j) and (same is None or same[i] == same[j])]
        out[i] = sorted(d)[:k]
    return out


@pytest.mark.parametrize("k,skip", [(1, False), (6, True)])
def test_nearest_with_an_outlier_a_clump_and_a_crowded_place(spark, monkeypatch, k, skip):
    monkeypatch.setattr(ne, "LEAST", 64)
    monkeypatch.setattr(ne, "LIMIT", 25)
    xy = cloud(1)
    got = {}
    for r in sp.nearest(frame(spark, xy), frame(spark, xy), k, exclude_self=skip).collect():
        got.setdefault(r.src, []).append((r.place, r.d, r.dst))
    want = brute(xy, xy, k, skip=skip)
    for i in range(len(xy)):
        assert [(d, j) for _, d, j in sorted(got[i])] == want[i], i


def test_nearest_of_vectors(spark, monkeypatch):
    monkeypatch.setattr(ne, "LEAST", 32)
    r = np.random.default_rng(3)
    a, b = r.normal(size=(60, 5)), r.normal(size=(200, 5))
    make = lambda m: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "id long, p array<double>")
    got = {}
    for x in ne.nearest_vectors(make(a), make(b), 4).collect():
        got.setdefault(x.src, {})[x.place] = (x.dst, x.d)
    for i, p in enumerate(a):
        d = np.sqrt(((b - p) ** 2).sum(1))
        assert [got[i][j + 1][0] for j in range(4)] == np.argsort(d, kind="stable")[:4].tolist()
        assert np.allclose([got[i][j + 1][1] for j in range(4)], np.sort(d)[:4])


def test_nearest_of_none_and_of_incomplete(spark):
    some, none = frame(spark, [(1, 2)]), frame(spark, [(1, 2)]).limit(0)
    assert not sp.nearest(some, none).collect() and not sp.nearest(none, some).collect()
    assert not sp.nearest(some, some, 3, exclude_self=True).collect()
    with pytest.raises(ValueError, match="complete"):
        sp.nearest(some, some.withColumn("x", F.lit(float("nan")))).collect()


def test_weights_by_batch_with_a_lone_cell(spark):
    r = np.random.default_rng(4)
    xy = r.uniform(0, 9, (41, 2))
    xy[7] = xy[8]
    batch = [0] * 20 + [1] * 20 + [2]
    got = {}
    for x in sp.kernel_weights(frame(spark, xy, batch), 3, "batch").collect():
        got.setdefault(x.src, {})[x.dst] = x.w
    want = brute(xy, xy, 3, batch, True)
    assert got[40] == {40: 1.0}
    for i in range(40):
        d = want[i]
        radius = max((v for v, _ in d if v > 0), default=1.0)
        raw = {j: math.exp(-((v / radius) ** 2)) for v, j in d}
        assert got[i].keys() == raw.keys() and all(math.isclose(got[i][j], raw[j] / sum(raw.values()), rel_tol=1e-12) for j in raw)


def test_label_distance_units_and_errors(spark):
    r = np.random.default_rng(5)
    xy, label = r.uniform(0, 1000, (60, 2)), ["ab"[i % 5 == 0] for i in range(60)]
    obs = frame(spark, xy, label, "label")
    px = {i: min(math.hypot(*(xy[i] - xy[j])) for j in range(60) if label[j] == "b") for i in range(60)}
    for args, unit in ((dict(mpp=0.5), 0.5), (dict(mpp=0.5, hires_scale=0.25), 2.0), (dict(mpp=0.5, hires_scale=0.25, system="fullres"), 0.5)):
        for x in sp.label_distance(obs, "b", **args).collect():
            assert math.isclose(x.d_px, px[x.id], rel_tol=1e-12, abs_tol=1e-12) and math.isclose(x.d_um, px[x.id] * unit, rel_tol=1e-12, abs_tol=1e-12)
    with pytest.raises(ValueError, match="label"):
        sp.label_distance(obs, "c")
    with pytest.raises(ValueError, match="hires_scale"):
        sp.label_distance(obs, "b", system="hires")


def test_coordinate_systems():
    assert sp.coordinate_system(100, 0.5, None) == sp.coordinate_system(100, 0.5, 0.995) == "fullres"
    assert sp.coordinate_system(20_000, 0.3, 0.8) == "fullres"
    assert sp.coordinate_system(20_000, 0.3, 0.1) == "fullres"
    with pytest.warns(UserWarning):
        assert sp.coordinate_system(1_000, 0.5, 0.25) == "hires"
    with pytest.warns(UserWarning):
        assert sp.coordinate_system(0, 0.5, 0.25) == "fullres"
    assert sp.scale_factors({"microns_per_pixel": 0.3, "regist_target_img_scalef": 0.1}) == (0.3, 0.1)
    with pytest.raises(ValueError):
        sp.scale_factors({})


def dbscan(xy, eps, least):
    d2 = ((xy[:, None] - xy) ** 2).sum(2) <= eps * eps
    core = d2.sum(1) >= least
    name = [i if core[i] else None for i in range(len(xy))]
    moved = True
    while moved:
        moved = False
        for i in np.flatnonzero(core):
            low = min(name[j] for j in np.flatnonzero(d2[i] & core))
            if low < name[i]:
                name[i], moved = low, True
    return [name[i] if core[i] else min((name[j] for j in np.flatnonzero(d2[i] & core)), default=None) for i in range(len(xy))]


@pytest.mark.parametrize("eps,least", [(3.0, 4), (0.9, 3), (8.0, 12)])
def test_density_clusters(spark, eps, least):
    r = np.random.default_rng(6)
    xy = np.concatenate([r.normal(0, 1, (60, 2)), r.normal(9, 2, (60, 2)), r.uniform(-20, 30, (60, 2)), np.repeat([[20.0, -9.0]], 8, 0)])
    got = {x.id: x.cluster for x in sp.density_clusters(frame(spark, xy), eps, least).collect()}
    assert [got[i] for i in range(len(xy))] == dbscan(xy, eps, least)


def test_slices_and_their_summary(spark):
    r = np.random.default_rng(7)
    xy = np.concatenate([r.normal(c, 3, (60, 2)) for c in ((0, 0), (200, 0), (0, 200))] + [[[900, 900]], r.normal(-300, 1, (5, 2))])
    got = sp.slices(frame(spark, xy), 15, 3, 10)
    by = {x.id: (x.slice_cluster, x.slice_id) for x in got.collect()}
    assert {by[i] for i in range(60)} == {(0, "S001")} or {by[i][1] for i in range(60)} <= {"S001", "S002"}
    assert {by[i][1] for i in range(120, 180)} == {"S003"} and by[180] == (-1, "debris") and by[181][1] == "debris" and by[181][0] >= 0
    assert sp.slice_counts(got).first().n_slices == 3 and list(sp.split_by_slice(got)) == ["S001", "S002", "S003"]
    assert {x.slice_id: x.n for x in sp.slice_summary(got).collect()} == {"S001": 60, "S002": 60, "S003": 60}


def test_colonies_and_centroids(spark):
    r = np.random.default_rng(8)
    xy = np.concatenate([r.normal((i * 200, 0), 8, (50, 2)) for i in range(3)] + [r.normal(900, 5, (10, 2))])
    found = sp.colonies(frame(spark, xy), 40, 5, 30)
    n = sp.colony_counts(found).first()
    assert (n.n_colonies, n.n_assigned, n.n_noise_or_small) == (3, 150, 10)
    marked = sp.marked_centroids(found)
    marks = [x for x in marked.collect() if x.centroid_type]
    assert len(marks) == 3
    for x in marks:
        own = xy[(x.id // 50) * 50 : (x.id // 50) * 50 + 50]
        assert x.id % 50 == int(np.argmin(((own - own.mean(0)) ** 2).sum(1)))
    at = xy[[x.id for x in marks]]
    for x in sp.centroid_distance(marked).collect():
        assert math.isclose(x.d, np.sqrt(((at - xy[x.id]) ** 2).sum(1)).min(), abs_tol=1e-9)
    with pytest.raises(ValueError):
        sp.centroid_distance(marked, "none")


@pytest.mark.parametrize("mode", ["cosphi", "regression"])
def test_gradients(spark, mode):
    r = np.random.default_rng(9)
    xy, x = r.uniform(0, 9, (30, 2)), r.poisson(2, (30, 3)).astype(float)
    pts = frame(spark, xy)
    counts = spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(30) for j in range(3) if x[i, j]], "cell long, gene string, value double")
    edges = sp.kernel_weights(pts, 5)
    w = np.zeros((30, 30))
    for e in edges.collect():
        w[e.src, e.dst] = e.w
    got = np.zeros((30, 3))
    for v in sp.neighbourhood_gradient(edges, pts, counts, mode).collect():
        got[v.cell, int(v.gene[1])] = v.value
    for i in range(30):
        nb = np.flatnonzero(w[i])
        dx, dy = (xy[nb] - xy[i]).T
        if mode == "cosphi":
            wc = w[i, nb] * np.cos(np.arctan2(dy, dx))
            want = wc / np.abs(wc).sum() @ x[nb]
        else:
            a = np.stack([np.ones(len(nb)), dx, dy], 1)
            beta = np.linalg.solve(a.T @ a + 1e-6 * np.eye(3), a.T @ x[nb])
            want = np.sqrt(beta[1] ** 2 + beta[2] ** 2)
        assert np.allclose(got[i], want, rtol=1e-6, atol=1e-8)


def test_extent_and_square_size(spark):
    pts = frame(spark, [(x * 4.0, y * 6.0) for x in range(5) for y in range(4)])
    assert tuple(sp.data_extent(pts).first()) == (-0.8, 16.8, -0.9, 18.9)
    assert sp.square_size(pts) == 4.0 and sp.square_size(pts, 16, 0.5) == 32.0 and sp.square_size(pts.limit(1)) == 1.0
