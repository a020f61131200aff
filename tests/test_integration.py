"""Components, anchors, corrections, communities and tests against dense numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.operators import cluster as cl
from glyphloom.operators import embedding as em
from glyphloom.operators import integration as it


def frame(spark, x, prefix="c", batch=None):
    rows = [(f"{prefix}{i:03d}", row.tolist()) + ((batch[i],) if batch is not None else ()) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "cell string, v array<double>" + (", batch string" if batch is not None else "")).repartition(3)


def dense(df):
    rows = sorted((r.cell, r.v) for r in df.collect())
    return np.array([v for _, v in rows])


@pytest.fixture(scope="module")
def cloud():
    r = np.random.default_rng(1)
    return r.normal(size=(60, 8)) @ r.normal(size=(8, 8)) + 3


def test_components_and_projections(spark, cloud):
    df = frame(spark, cloud)
    parts = em.principal(df, 4)
    centred = cloud - cloud.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    sign = np.sign(vt[np.arange(4), np.abs(vt[:4]).argmax(1)])
    assert np.allclose(parts.loadings, vt[:4].T * sign, atol=1e-7) and np.allclose(parts.share, s[:4] ** 2 / (s**2).sum(), atol=1e-9) and np.allclose(parts.mean, cloud.mean(0))
    assert np.allclose(dense(parts.applied(df)), centred @ parts.loadings, atol=1e-9) and np.allclose(dense(parts.applied(df, centre=False)), cloud @ parts.loadings, atol=1e-9)
    scaled = dense(em.by_length(em.by_deviation(df)))
    want = cloud / cloud.std(0)
    assert np.allclose(scaled, want / np.linalg.norm(want, axis=1, keepdims=True))
    assert np.allclose(dense(em.mixed(df, df, 0.3)), np.hstack([cloud * 0.7**0.5, cloud * 0.3**0.5]))
    with pytest.raises(ValueError):
        em.mixed(df, df, 2)


def test_vectors(spark):
    values = spark.createDataFrame([("a", "g2", 3.0), ("b", "g1", 1.0), ("b", "zz", 9.0)], "cell string, gene string, value double")
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "cell string")
    assert {r.cell: r.v for r in em.vectors(values, ["g1", "g2"], cells).collect()} == {"a": [0, 3], "b": [1, 0], "c": [0, 0]}


def nearest(p, q, k):
    d = np.sqrt(((p[:, None] - q) ** 2).sum(2))
    return np.argsort(d, axis=1, kind="stable")[:, :k], np.sort(d, axis=1)[:, :k]


def test_anchors_against_numpy(spark):
    r = np.random.default_rng(2)
    a, b = r.normal(size=(30, 6)), r.normal(size=(24, 6)) + 0.4
    da, db = frame(spark, a, "a"), frame(spark, b, "b")
    pa, pb = em.principal(da, 4), em.principal(db, 4)
    in_a, in_b = it.reciprocal(da, pa, db, pb, 4)

    def space(c, own_a):
        x = np.vstack([(a - pa.mean) @ c.loadings if own_a else a @ c.loadings, b @ c.loadings if own_a else (b - pb.mean) @ c.loadings])
        x = x / x.std(0)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    ra, rb = space(pa, True), space(pb, False)
    assert np.allclose(np.vstack([dense(in_a.where("side = 'a'").drop("side")), dense(in_a.where("side = 'b'").drop("side"))]), ra, atol=1e-9)
    k_anchor, k_score = 4, 7
    ab, _ = nearest(rb[:30], rb[30:], k_score)
    ba, _ = nearest(ra[30:], ra[:30], k_score)
    aa, _ = nearest((a - pa.mean) @ pa.loadings, (a - pa.mean) @ pa.loadings, k_score + 1)
    bb, _ = nearest((b - pb.mean) @ pb.loadings, (b - pb.mean) @ pb.loadings, k_score + 1)
    pairs = [(i, j) for i in range(30) for j in ab[i, :k_anchor] if i in ba[j, :k_anchor]]
    raw = []
    for i, j in pairs:
        ours = set(ab[i, :k_score]) | set(aa[i, :k_score]) | {x + 30 for x in ab[i, :k_score]}
        theirs = set(ba[j, :k_score]) | {x + 30 for x in bb[j, :k_score]}
        raw.append(len(ours & theirs))
    low, high = np.percentile(raw, [1, 90])
    want = {(f"a{i:03d}", f"b{j:03d}"): float(np.clip((s - low) / (high - low), 0, 1)) if high > low else 1.0 for (i, j), s in zip(pairs, raw, strict=True)}
    own_a, own_b = pa.applied(da), pb.applied(db)
    got = {(x.cell1, x.cell2): x.score for x in it.pair_anchors(in_a, in_b, own_a, own_b, k_anchor, k_score).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in got)


def test_correction_against_loops(spark, monkeypatch):
    monkeypatch.setattr(it, "CHUNK", 9)
    r = np.random.default_rng(3)
    a, b = r.normal(size=(25, 5)), r.normal(size=(40, 5)) + 2
    pairs = sorted({(int(r.integers(25)), int(r.integers(40))) for _ in range(30)})
    score = r.uniform(0.1, 1, len(pairs))
    anchors = spark.createDataFrame([(f"a{i:03d}", f"b{j:03d}", float(s)) for (i, j), s in zip(pairs, score, strict=True)], "cell1 string, cell2 string, score double")
    got = dense(it.corrected_pair(frame(spark, a, "a"), frame(spark, b, "b"), anchors, k=6, dims=3))
    both = np.vstack([a, b])
    _, _, vt = np.linalg.svd(both - both.mean(0), full_matrices=False)
    space = (b - both.mean(0)) @ vt[:3].T
    cells = sorted({j for _, j in pairs})
    near, d = nearest(space, space[cells], min(6, len(cells)))
    want = b.copy()
    for q in range(40):
        rows, w = [], []
        for place in range(near.shape[1]):
            for n, (i, j) in enumerate(pairs):
                if j == cells[near[q, place]] and len(rows) < 6:
                    rows.append(b[j] - a[i])
                    w.append(1 - math.exp(-d[q, place] * score[n] / 4))
        if sum(w):
            want[q] -= np.array(w) / sum(w) @ np.array(rows)
    assert np.allclose(got, want, atol=1e-8)
    assert np.allclose(dense(it.corrected_pair(frame(spark, a, "a"), frame(spark, b, "b"), anchors.limit(0))), b)


def test_trees_of_batches():
    d = np.array([[0, 2, 6, 10], [2, 0, 5, 9], [6, 5, 0, 4], [10, 9, 4, 0]], float)
    tree = it.average_linkage(d)
    assert [(a, b, n) for a, b, _, n in tree] == [(0, 1, 2), (2, 3, 2), (4, 5, 4)] and math.isclose(tree[2][2], 7.5)
    assert sorted(it.leaves_of(tree, 6, 4)) == [0, 1, 2, 3] and it.batch_tree(np.ones((1, 1))) == [] and it.batch_tree(np.ones((2, 2))) == [(0, 1)]


def test_integration_brings_batches_together(spark):
    r = np.random.default_rng(4)
    kinds = r.normal(size=(3, 10)) * 4
    own = r.integers(0, 3, 120)
    batch = np.repeat(["x", "y", "z"], 40)
    shift = {"x": np.zeros(10), "y": np.full(10, 1.5), "z": np.full(10, -1.0)}
    x = kinds[own] + r.normal(size=(120, 10)) * 0.3 + np.array([shift[b] for b in batch])
    rows = frame(spark, x, batch=batch.tolist())
    out, anchors, tree = it.integrate(rows, dims=5, k_score=10, k_weight=20)
    fixed = dense(out)
    assert len(tree) == 2 and anchors.count() % 2 == 0 and fixed.shape == x.shape

    def gap(v):
        return np.mean([np.linalg.norm(v[(own == k) & (batch == a)].mean(0) - v[(own == k) & (batch == "x")].mean(0)) for k in range(3) for a in "yz"])

    assert gap(fixed) < 0.4 * gap(x)
    learned, _ = it.integrated(rows.where("batch <> 'z'"), anchors.where("dataset1 <> 'z' and dataset2 <> 'z'"), method="trees", components=3, trees=3)
    assert learned.count() == 80
    with pytest.raises(ValueError):
        it.integrated(rows, anchors, method="none")
    with pytest.raises(ValueError, match="finite"):
        it.integrate(rows.withColumn("v", F.array_append("v", F.lit(float("nan")))))


def test_telling_features(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(80, 5))
    x[40:, 3] += 5
    assert it.telling_features(frame(spark, x, batch=["x"] * 40 + ["y"] * 40), list("abcde"), 1, trees=3) == ["d"]


def test_harmonised(spark):
    r = np.random.default_rng(6)
    kind, batch = r.integers(0, 2, 200), np.where(np.arange(200) % 2, "x", "y")
    x = np.array([[6, 0, 0], [0, 6, 0]])[kind] + r.normal(size=(200, 3)) * 0.4 + np.where(batch[:, None] == "x", [[0, 0, 2.0]], 0)
    got = dense(em.harmonised(frame(spark, x, batch=batch.tolist()), clusters=4).select("cell", "v"))
    gap = lambda v: np.linalg.norm(v[batch == "x"].mean(0) - v[batch == "y"].mean(0))
    assert gap(got) < 0.5 * gap(x) and np.linalg.norm(got[kind == 0].mean(0) - got[kind == 1].mean(0)) > 4


def test_communities_of_cliques():
    src, dst = zip(*[(10 * g + i, 10 * g + j) for g in range(6) for i in range(10) for j in range(i)], strict=True)
    src, dst = np.array([*src, *(10 * g for g in range(5))]), np.array([*dst, *(10 * g + 10 for g in range(5))])
    label = cl.communities(60, src, dst, np.ones(len(src)))
    assert len(set(label)) == 6 and all(len(set(label[10 * g : 10 * g + 10])) == 1 for g in range(6))
    assert cl.modularity(60, src, dst, np.ones(len(src)), label) > 0.75


def test_communities_of_edges_on_executors(spark, monkeypatch):
    """The same as of arrays on the driver, with weights whose sums are exact."""
    r = np.random.default_rng(11)
    src, dst = r.integers(0, 300, 1500), r.integers(0, 300, 1500)
    dst = np.where(r.random(1500) < 0.8, src // 30 * 30 + dst % 30, dst)
    w = r.integers(1, 9, 1500) / 8
    want = cl.communities(300, src, dst, w)
    monkeypatch.setattr(cl, "PIECE", 64, raising=False)
    rows = spark.createDataFrame([(int(a), int(b), float(x) / 2) for a, b, x in zip([*src, *dst], [*dst, *src], [*w, *w], strict=True)], "a long, b long, w double")
    for most in (0, 1000):
        monkeypatch.setattr(cl, "DRIVER", most, raising=False)
        edges = cl.edges_of(300, rows)
        assert isinstance(edges, cl.SpreadEdges) and edges.table.count() == 5
        assert (cl.communities_of(edges) == want).all()


def test_the_driver_gets_no_graph(spark, monkeypatch):
    """Arrays over cells, but no table of their edges or of their distances to medoids."""
    seen = []
    for name in ("toArrow", "toPandas"):
        whole = getattr(type(spark.range(0)), name)
        monkeypatch.setattr(type(spark.range(0)), name, lambda self, whole=whole: (seen.append(len(out := whole(self))), out)[1])
    monkeypatch.setattr(cl, "DRIVER", 100, raising=False)
    r = np.random.default_rng(12)
    own = np.repeat(np.arange(3), 60)
    df = frame(spark, np.eye(3)[own] * 20 + r.normal(size=(180, 3)))
    got = {x.cell: x.cluster for x in cl.clustered(df, 8, 0.3).collect()}
    assert max(seen) <= 180 and all(len({got[f"c{i:03d}"] for i in np.flatnonzero(own == k)}) == 1 for k in range(3))
    monkeypatch.setattr(cl, "DISTANCES", 7, raising=False)
    labels = cl.clustered(df, 8, 0.3, sketch=90)
    assert max(seen) <= 180 and labels.count() == 180 and len({x.cluster for x in labels.collect()}) >= 3


def test_clusters_and_medoids(spark):
    r = np.random.default_rng(7)
    own = np.repeat(np.arange(3), 30)
    x = np.eye(3)[own] * 12 + r.normal(size=(90, 3))
    df = frame(spark, x)
    labels = cl.clustered(df, 8, 0.3)
    got = {r_.cell: r_.cluster for r_ in labels.collect()}
    groups = [{got[f"c{i:03d}"] for i in range(90) if own[i] == k} for k in range(3)]
    assert len(set().union(*groups)) == 3 and all(len(g) == 1 for g in groups)
    best = {m.cluster: m.cell for m in cl.medoids(df, labels, block=7).collect()}
    for k in range(3):
        mine = np.flatnonzero(own == k)
        total = np.sqrt(((x[mine, None] - x[mine]) ** 2).sum(2)).sum(1)
        assert best[groups[k].copy().pop()] == f"c{mine[np.argmin(total)]:03d}"
    assert {r_.cell: r_.cluster for r_ in cl.clustered(df, 8, 0.3, sketch=45).collect()}.keys() == got.keys()
    assert {r_.cell: r_.cluster for r_ in cl.assigned(df, df, labels).collect()} == got


def test_rank_sums_against_loops(spark):
    r = np.random.default_rng(8)
    y = r.poisson(1.2, (50, 4)).astype(float)
    y[:20, 2] += 4
    own = ["p"] * 20 + ["q"] * 18 + ["r"] * 12
    counts = spark.createDataFrame([(f"c{i:02d}", f"g{j}", float(y[i, j])) for i in range(50) for j in range(4) if y[i, j]], "cell string, gene string, value double")
    labels = spark.createDataFrame([(f"c{i:02d}", own[i]) for i in range(50)], "cell string, cluster string")
    pairs = [("p", "q"), ("q", "r")]
    got = {(x.a, x.b, x.gene): x.p for x in cl.rank_sums(counts, labels, pairs).collect()}
    differ = dict.fromkeys(pairs, 0)
    for a, b in pairs:
        ps = []
        for j in range(4):
            u, v = y[[i for i in range(50) if own[i] == a], j], y[[i for i in range(50) if own[i] == b], j]
            both = np.concatenate([u, v])
            rank = [(both < t).sum() + ((both == t).sum() + 1) / 2 for t in u]
            z = (sum(rank) - len(u) * (len(both) + 1) / 2) / math.sqrt(len(u) * len(v) * (len(both) + 1) / 12)
            ps.append(math.erfc(abs(z) / math.sqrt(2)))
            assert math.isclose(got[a, b, f"g{j}"], ps[-1], rel_tol=1e-9)
        differ[a, b] = int((cl.adjusted(np.array(ps)) < 0.05).sum())
    assert cl.differing_genes(counts, labels, pairs) == differ and differ["p", "q"] >= 1 and differ["q", "r"] == 0
    merged, about = cl.merged_clusters(counts, labels, spark.createDataFrame([(f"c{i:02d}", [float("pqr".index(own[i])), 0.1 * i]) for i in range(50)], "cell string, v array<double>"))
    assert about == {"skipped": False, "clusters": 3, "merged": 2} and {x.cluster for x in merged.where("cell >= 'c20'").collect()} == {"q"}
    with pytest.warns(UserWarning):
        assert cl.merged_clusters(counts, labels, spark.createDataFrame([(f"c{i:02d}", [1.0 * i]) for i in range(50)], "cell string, v array<double>"), max_tests=1)[1]["skipped"]


def test_rings_are_told_apart(spark):
    r = np.random.default_rng(9)
    n = 36
    turn = np.concatenate([np.arange(n) / n, np.arange(n) / n]) * 2 * math.pi
    radius = np.repeat([1.0, 2.5], n)
    y = r.poisson(2, (2 * n, 20)).astype(float)
    y[:n, :5] += 12
    y[n:, 5:10] += 12
    points = spark.createDataFrame([(i, float(radius[i] * math.cos(turn[i])), float(radius[i] * math.sin(turn[i])), "AB"[i % 2]) for i in range(2 * n)], "id long, x double, y double, batch string")
    counts = spark.createDataFrame([(i, f"g{j:02d}", float(y[i, j])) for i in range(2 * n) for j in range(20) if y[i, j]], "cell long, gene string, value double")
    got = {x.cell: (x.celltype, x.domain) for x in cl.spatial_clusters(counts, points.drop("batch"), k_spatial=4, k_expr=8, n=5, resolution=0.5).collect()}
    assert len(got) == 2 * n and {got[i][0] for i in range(n)}.isdisjoint({got[i][0] for i in range(n, 2 * n)})
    apart = cl.spatial_clusters(counts, points, "celltype", k_spatial=4, k_expr=5, n=5, batch="batch", integrate="separate")
    assert {x.celltype[:2] for x in apart.collect()} == {"A_", "B_"} and apart.count() == 2 * n
    with pytest.raises(ValueError):
        cl.spatial_clusters(counts, points, "other")
    with pytest.raises(ValueError):
        cl.spatial_clusters(counts, points, integrate="joint")


def test_highly_variable(spark):
    r = np.random.default_rng(10)
    y = r.poisson(r.uniform(1, 6, 40), (120, 40)).astype(float)
    y[:, 7] = r.poisson(r.choice([0.5, 9], 120))
    counts = spark.createDataFrame([(i, f"g{j:02d}", float(y[i, j])) for i in range(120) for j in range(40) if y[i, j]], "cell int, gene string, value double")
    cells = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(120)], "cell int, batch string")
    assert cl.highly_variable(counts, cells, 3)[0] == "g07" and cl.highly_variable(counts, cells, 3, "batch")[0] == "g07"
