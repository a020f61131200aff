"""Clusters of cells: graphs in embeddings, communities, medoids, rank-sum tests, merging, and the spatial clustering that joins them.

Tables: embedding (cell, v array<double>), labels (cell, cluster as text), edges (src, dst, w).
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import counts as ct
from . import embedding as em
from . import spatial as sp
from .integration import average_linkage, leaves_of
from .nearest import matrix, nearest_vectors
from .ranks import numbered
from .shared import discard, kept

#: Cells beyond which a sketch of SKETCH cells is clustered and the others join the nearest medoid. The driver holds arrays over that many cells at most.
SKETCH = 500_000
#: Edges that the driver holds at most; more are kept by executors, in pieces of PIECE nodes.
DRIVER, PIECE = 1 << 19, 1 << 14
#: Distances to medoids that a task holds at once.
DISTANCES = 1 << 17


def neighbour_count(n: int, given: int | None = None) -> int:
    if given is not None:
        return max(2, int(given))
    return 2 if n <= 1 else max(15, math.floor(math.log2(n)))


def embedding_graph(embedding: DataFrame, k: int) -> DataFrame:
    """(src, dst, w): exp(-(d / r)^2) to the k nearest in the embedding, r a cell's distance to its k-th (1 where that is 0)."""
    points = embedding.select(F.col("cell").alias("id"), F.col("v").alias("p"))
    edges = nearest_vectors(points, points, k, exclude_self=True)
    from pyspark.sql import Window

    r = F.max("d").over(Window.partitionBy("src"))
    scale = F.when(r > 0, r).otherwise(1.0)
    return edges.select("src", "dst", F.exp(-(F.col("d") / scale) * (F.col("d") / scale)).alias("w"))


# Communities


class Edges:
    """Edges (a, b, w) of nodes 0 to n - 1, each in both directions, as arrays."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        self.n, self.arrays = n, (a, b, w)

    def each(self, f: Callable, *state) -> list[tuple[np.ndarray, np.ndarray]]:
        """f(a, b, w, *state) of every piece, two arrays, in order of nodes. A piece has all edges of its nodes."""
        return [f(*self.arrays, *state)]

    def merged(self, own: np.ndarray) -> Edges | SpreadEdges:
        """The edges between the groups `own` of nodes; those within a group stay as loops."""
        a, b, w = self.arrays
        return Edges(int(own.max(initial=-1)) + 1, own[a], own[b], w)


class SpreadEdges:
    """The same as a kept table of pieces of PIECE nodes: the driver holds arrays over nodes, executors those over edges."""

    def __init__(self, n: int, edges: DataFrame):
        def packed(t: pa.Table) -> pa.Table:
            t = t.sort_by([("a", "ascending"), ("b", "ascending"), ("w", "ascending")])
            columns = [t.column(c).to_numpy().astype(kind).tobytes() for c, kind in _KINDS]
            return pa.table({"piece": pa.array([t.column("piece")[0].as_py()], pa.int64()), **{c: pa.array([x], pa.binary()) for (c, _), x in zip(_KINDS, columns, strict=True)}})

        rows = edges.withColumn("piece", F.floor(F.col("a") / PIECE).cast("long"))
        self.n, self.table = n, kept(rows.groupBy("piece").applyInArrow(packed, "piece long, a binary, b binary, w binary"), "edges")

    def _mapped(self, made: Callable[[int, tuple], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for i in range(x.num_rows):
                    yield from made(x.column("piece")[i].as_py(), tuple(np.frombuffer(x.column(c)[i].as_buffer(), kind) for c, kind in _KINDS))

        return self.table.mapInArrow(run, schema)

    def each(self, f: Callable, *state) -> list[tuple[np.ndarray, np.ndarray]]:
        held = self.table.sparkSession.sparkContext.broadcast(state)

        def made(piece: int, arrays: tuple) -> Iterator[pa.RecordBatch]:
            x, y = f(*arrays, *held.value)
            yield pa.record_batch([pa.array([piece]), pa.array([x.astype(np.int64).tobytes()]), pa.array([y.astype(np.float64).tobytes()])], ["piece", "x", "y"])

        found = self._mapped(made, "piece long, x binary, y binary").collect()  # two numbers for each node at most
        held.destroy()
        return [(np.frombuffer(r["x"], np.int64), np.frombuffer(r["y"], np.float64)) for r in sorted(found, key=lambda r: r["piece"])]

    def merged(self, own: np.ndarray) -> Edges | SpreadEdges:
        n = int(own.max(initial=-1)) + 1
        held = self.table.sparkSession.sparkContext.broadcast(own)

        def made(_: int, arrays: tuple) -> Iterator[pa.RecordBatch]:
            a, b, w = arrays
            pair, at = np.unique(held.value[a].astype(np.int64) * n + held.value[b], return_inverse=True)
            x = pa.record_batch([pa.array(pair // n), pa.array(pair % n), pa.array(np.bincount(at, w, len(pair)))], ["a", "b", "w"])
            yield from (x.slice(i, 100_000) for i in range(0, len(pair), 100_000))

        parts = kept(self._mapped(made, "a long, b long, w double"), "merged")
        summed = F.array_sort(F.collect_list("w"))  # of as many parts as pieces at most; in order, so sums are the same each time
        out = edges_of(n, parts.groupBy("a", "b").agg(F.aggregate(summed, F.lit(0.0), lambda x, y: x + y).alias("w")))
        held.destroy()
        discard(parts, self.table)
        return out


_KINDS = (("a", np.int32), ("b", np.int32), ("w", np.float64))


def edges_of(n: int, edges: DataFrame) -> Edges | SpreadEdges:
    """edges (a, b, w) in both directions: arrays on the driver up to DRIVER of them."""
    held = kept(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "w"), "pairs")
    if held.count() > DRIVER:
        out = SpreadEdges(n, held)
    else:
        t = held.toArrow().sort_by([("a", "ascending"), ("b", "ascending"), ("w", "ascending")])
        out = Edges(n, *(t.column(c).to_numpy() for c in "abw"))
    discard(held)
    return out


def communities(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float = 1.0, rounds: int = 2, seed: int = 0) -> np.ndarray:
    """communities_of() of edges that are given once."""
    return communities_of(Edges(n, np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w]) / 2), resolution, rounds, seed)


def communities_of(edges: Edges | SpreadEdges, resolution: float = 1.0, rounds: int = 2, seed: int = 0) -> np.ndarray:
    """A community of each node by modularity: local moves of all nodes at once, parts split into what is connected, then the same on the graph of
    communities. Communities are numbered by size, the largest first."""
    rng = np.random.default_rng(seed)
    own = np.arange(edges.n)
    for _ in range(rounds * 10):
        found = _connected(edges, _moved(edges, resolution, rng))
        names, found = np.unique(found, return_inverse=True)
        if len(names) == edges.n:
            break
        own = found[own]
        edges = edges.merged(found)
    if isinstance(edges, SpreadEdges):
        discard(edges.table)
    _, own, count = np.unique(own, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), int)
    rank[np.lexsort((np.arange(len(count)), -count))] = np.arange(len(count))
    return rank[own]


def _degrees(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    node, at = np.unique(a, return_inverse=True)
    return node, np.bincount(at, w, len(node))


def _better(a: np.ndarray, b: np.ndarray, w: np.ndarray, label: np.ndarray, degree: np.ndarray, strength: np.ndarray, total: float, resolution: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that gain by a move, and the neighbouring communities of largest gain."""
    n, out = len(label), a != b
    pair, at = np.unique(a[out].astype(np.int64) * n + label[b[out]], return_inverse=True)
    link = np.bincount(at, w[out], len(pair))
    node, to = pair // n, pair % n
    same = to == label[node]
    gain = link - resolution * degree[node] * (strength[to] - np.where(same, degree[node], 0)) / total
    order = np.lexsort((to, -gain, node))
    first = order[np.append(True, node[order][1:] != node[order][:-1])] if len(order) else order
    who = node[first]
    stay = -resolution * degree[who] * (strength[label[who]] - degree[who]) / total
    stay[np.searchsorted(who, node[same])] = gain[same]
    better = gain[first] > stay + 1e-12
    return who[better], to[first][better]


def _moved(edges: Edges | SpreadEdges, resolution: float, rng: np.random.Generator, sweeps: int = 20) -> np.ndarray:
    """Labels after sweeps in which a random half of the nodes move at a time to the neighbouring community of largest gain."""
    n, label, degree = edges.n, np.arange(edges.n), np.zeros(edges.n)
    for node, sums in edges.each(_degrees):
        degree[node] = sums
    total = degree.sum()
    for sweep in range(sweeps):
        strength = np.bincount(label, degree, n)
        found = edges.each(_better, label, degree, strength, total, resolution)
        who, where = (np.concatenate([x[i] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1))
        chosen = rng.random(len(who)) < (0.5 if sweep < sweeps - 1 else 0.25)
        if not len(who):
            break
        label[who[chosen]] = where[chosen]
    return label


def _smaller(a: np.ndarray, b: np.ndarray, w: np.ndarray, label: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with a neighbour of their label that has a smaller name, and the smallest of these."""
    inside = label[a] == label[b]
    a, near = a[inside], name[b[inside]]
    less = near < name[a]
    node, at = np.unique(a[less], return_inverse=True)
    least = np.full(len(node), len(name))
    np.minimum.at(least, at, near[less])
    return node, least


def _connected(edges: Edges | SpreadEdges, label: np.ndarray) -> np.ndarray:
    """Labels split into what is connected within them, named by the smallest node."""
    name = np.arange(edges.n)
    while True:
        new = name.copy()
        for node, least in edges.each(_smaller, label, name):
            new[node] = least
        if (new == name).all():
            return name
        while (new[new] != new).any():
            new = new[new]
        name = new


def modularity(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, label: np.ndarray, resolution: float = 1.0) -> float:
    total = 2 * w.sum()
    degree = np.bincount(src, w, n) + np.bincount(dst, w, n)
    inside = 2 * w[label[src] == label[dst]].sum()
    strength = np.bincount(label, degree)
    return float(inside / total - resolution * (strength**2).sum() / total**2)


def clustered(embedding: DataFrame, k: int | None = 50, resolution: float = 1.0, sketch: int = SKETCH, seed: int = 0) -> DataFrame:
    """(cell, cluster): communities of the neighbour graph. Beyond `sketch` cells a sample of that size, by a hash, is clustered, and the others join the nearest medoid."""
    n = embedding.count()
    part = embedding
    if n > sketch:
        part = kept(embedding.orderBy(F.xxhash64(F.col("cell").cast("string"), F.lit(seed)), "cell").limit(sketch), "sketch")
    near = embedding_graph(part, neighbour_count(min(n, sketch), k))
    places = kept(numbered(part.select("cell"), "cell"), "places")
    at = lambda c, name: places.select(F.col("cell").alias(c), F.col("ord").alias(name))
    pairs = kept(near.join(at("src", "a"), "src").join(at("dst", "b"), "dst").select("a", "b", (F.col("w") / 2).alias("w")), "graph")
    edges = edges_of(min(n, sketch), pairs.union(pairs.select("b", "a", "w")))
    discard(pairs)
    label = communities_of(edges, resolution, seed=seed).astype(np.int32)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("cell"), pa.array(label[b.column("ord").to_numpy()].astype(str), pa.string())], ["cell", "cluster"])

    found = places.mapInArrow(labelled, T.StructType([T.StructField("cell", embedding.schema["cell"].dataType), T.StructField("cluster", T.StringType())]))
    return found if n <= sketch else assigned(embedding, part, found)


# Medoids


def cluster_order(names: Sequence[str]) -> list[str]:
    return sorted(names, key=lambda c: (len(c), c))


def medoids(embedding: DataFrame, labels: DataFrame, block: int = 2000) -> DataFrame:
    """(cluster, cell, v): of each cluster the member with the least summed distance to the others, the smallest cell of equals.

    Members meet block by block: each two blocks of a cluster make a group, which returns a sum for each member.
    """
    rows = labels.select("cell", "cluster").join(embedding.select("cell", "v"), "cell")
    sizes = rows.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = kept(rows.join(F.broadcast(sizes), "cluster").withColumn("block", F.pmod(F.xxhash64("cell"), F.col("blocks")).cast("int")), "blocks")
    every = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ask = every.select("cluster", F.col("block").alias("x"), F.col("other").alias("y"), "cell", "v")
    have = every.select("cluster", F.col("other").alias("x"), F.col("block").alias("y"), "v")

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return pa.table({"cluster": a.column("cluster"), "cell": a.column("cell"), "d": pa.array([], pa.float64())})
        dims = len(a.column("v")[0])
        p, q = matrix(a.column("v"), dims), matrix(b.column("v"), dims) if b.num_rows else np.zeros((0, dims))
        d = np.zeros(len(p))
        for i in range(0, len(p), 256):
            gap = p[i : i + 256, None] - q
            d[i : i + 256] = np.sqrt((gap * gap).sum(2)).sum(1)
        return pa.table({"cluster": a.column("cluster"), "cell": a.column("cell"), "d": pa.array(d)})

    kind = embedding.schema["cell"].dataType.simpleString()
    keys = ["cluster", "x", "y"]
    total = ask.groupBy(*keys).cogroup(have.groupBy(*keys)).applyInArrow(lambda a, b: sums(a, b), f"cluster string, cell {kind}, d double").groupBy("cluster", "cell").agg(F.sum("d").alias("d"))
    best = total.groupBy("cluster").agg(F.min(F.struct(F.round("d", 9).alias("d"), "cell")).alias("b")).select("cluster", F.col("b.cell").alias("cell"))
    return best.join(embedding.select("cell", "v"), "cell").select("cluster", "cell", "v")


def assigned(embedding: DataFrame, sketch: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, cluster) of the cluster whose medoid is nearest, the first of equals in order of (length, name)."""
    rows = medoids(sketch, labels).collect()  # a row for each cluster
    rows.sort(key=lambda r: (len(r["cluster"]), r["cluster"]))
    names, centres = np.array([r["cluster"] for r in rows], object), np.array([r["v"] for r in rows])
    step = max(1, DISTANCES // len(rows))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = matrix(b.column("v"), centres.shape[1])
            best = np.zeros(len(p), np.int64)
            for i in range(0, len(p), step):
                d = np.zeros((len(p[i : i + step]), len(centres)))
                for c in range(centres.shape[1]):
                    gap = p[i : i + step, c, None] - centres[:, c]
                    gap *= gap
                    d += gap
                best[i : i + step] = d.argmin(1)
            yield pa.record_batch([b.column("cell"), pa.array(names[best], pa.string())], ["cell", "cluster"])

    return embedding.select("cell", "v").mapInArrow(join, f"cell {embedding.schema['cell'].dataType.simpleString()}, cluster string")


# Rank-sum tests and merging


def two_sided(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2)) for v in np.ravel(z)]).reshape(np.shape(z))


def adjusted(p: np.ndarray) -> np.ndarray:
    """Benjamini-Hochberg."""
    p = np.asarray(p, float)
    order = np.argsort(p)
    scaled = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(1, np.minimum.accumulate(scaled[::-1])[::-1])
    return out


def rank_sums(counts: DataFrame, labels: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, gene, z, p): Wilcoxon's rank-sum test (normal approximation, ties by average rank) of each gene in two clusters, absent entries as zeros.

    A gene's stored entries are one group; they are sorted once and ranked for each pair.
    """
    sizes = {r["cluster"]: r["n"] for r in labels.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # clusters
    names = list(sizes)
    code = {c: i for i, c in enumerate(names)}
    wanted = [(a, b) for a, b in pairs if a in sizes and b in sizes]
    rows = counts.where("value <> 0").join(labels.select("cell", "cluster"), "cell").select("gene", "cluster", F.col("value").cast("double").alias("value"))

    def test(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("value")
        value, own = part["value"].to_numpy(), part["cluster"].map(code).to_numpy()
        out = []
        for a, b in wanted:
            of = (own == code[a]) | (own == code[b])
            v, is_a = value[of], own[of] == code[a]
            n, m = sizes[a], sizes[b]
            zeros = n + m - len(v)
            zeros_a = n - int(is_a.sum())
            low = int(np.searchsorted(v, 0.0))  # entries below zero come before the zeros
            first, last = np.searchsorted(v, v, "left"), np.searchsorted(v, v, "right")
            rank = (first + last + 1) / 2 + np.where(np.arange(len(v)) >= low, zeros, 0)
            total = rank[is_a].sum() + zeros_a * (low + (zeros + 1) / 2)
            spread = math.sqrt(n * m * (n + m + 1) / 12)
            out.append((a, b, (total - n * (n + m + 1) / 2) / spread if spread else 0.0))
        z = np.array([x[2] for x in out])
        return pd.DataFrame({"a": [x[0] for x in out], "b": [x[1] for x in out], "gene": part["gene"].iloc[0], "z": z, "p": two_sided(z)})

    if not wanted:
        return counts.sparkSession.createDataFrame([], "a string, b string, gene string, z double, p double")
    return rows.groupBy("gene").applyInPandas(test, "a string, b string, gene string, z double, p double")


def differing_genes(counts: DataFrame, labels: DataFrame, pairs: Sequence[tuple[str, str]], limit: float = 0.05) -> dict[tuple[str, str], int]:
    """How many genes of each pair have an adjusted p below the limit. Genes without any entry have p = 1."""
    n_genes = counts.select("gene").distinct().count()
    out = dict.fromkeys(pairs, 0)
    found = rank_sums(counts, labels, pairs)
    # the limit holds for the i-th smallest p if p * n / i is below it, for this or a larger i
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("p"))
    below = found.withColumn("i", place).where(F.col("p") * n_genes / F.col("i") < limit).groupBy("a", "b").agg(F.max("i").alias("n"))
    for r in below.collect():  # a row for each pair of clusters
        out[r["a"], r["b"]] = r["n"]
    return out


def merged_clusters(counts: DataFrame, labels: DataFrame, embedding: DataFrame, limit: float = 0.05, max_tests: int | None = 2000) -> tuple[DataFrame, dict]:
    """(cell, cluster) with clusters merged that no gene tells apart, and what was done. Pairs are those that meet at a merge of the medoids' tree."""
    rows = sorted(medoids(embedding, labels).collect(), key=lambda r: (len(r["cluster"]), r["cluster"]))
    names = [r["cluster"] for r in rows]
    n = len(names)
    tests = n * (n - 1) // 2
    if n < 2 or (max_tests is not None and tests > max_tests):
        if n >= 2:
            warnings.warn(f"{tests} tests are more than {max_tests}: clusters stay as they are", stacklevel=2)
        return labels, {"skipped": n >= 2, "clusters": n, "merged": n}
    v = np.array([r["v"] for r in rows])
    tree = average_linkage(np.sqrt(((v[:, None] - v) ** 2).sum(2)))
    pairs = [(names[i], names[j]) for a, b, *_ in tree for i in leaves_of(tree, a, n) for j in leaves_of(tree, b, n)]
    differ = differing_genes(counts, labels, pairs, limit)
    root = {c: c for c in names}

    def find(c: str) -> str:
        while root[c] != c:
            c = root[c]
        return c

    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y and not differ[a, b]:
            root[y] = x
    final = {c: find(c) for c in names}
    table = F.create_map(*(F.lit(x) for pair in final.items() for x in pair))
    return labels.select("cell", F.element_at(table, F.col("cluster")).alias("cluster")), {"skipped": False, "clusters": n, "merged": len(set(final.values()))}


# Genes and features


def highly_variable(counts: DataFrame, cells: DataFrame, n: int = 2000, batch: str | None = None, span: float = 0.3) -> list[str]:
    """The n genes of largest standardised variance: a local quadratic regression of log10 variance on log10 mean gives the deviation, by which values are divided
    and cut at the root of the number of cells. With batches, genes are ordered by the median of their ranks in the batches where they are among the n,
    then by the number of such batches."""
    keyed = cells.select("cell", (F.col(batch).cast("string") if batch else F.lit("")).alias("b"))
    size = {r["b"]: r["n"] for r in keyed.groupBy("b").agg(F.count("*").alias("n")).collect()}
    rows = counts.join(keyed, "cell")
    sums = rows.groupBy("b", "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")).toPandas()  # genes times batches
    fits = []
    for b, t in sums.groupby("b"):
        m = size[b]
        mean, var = t["s"] / m, (t["ss"] - t["s"] ** 2 / m) / max(1, m - 1)
        live = (var > 0).to_numpy()
        x, y = np.log10(mean[live]).to_numpy(), np.log10(var[live]).to_numpy()
        fits.append(pd.DataFrame({"b": b, "gene": t["gene"][live], "mean": mean[live], "sd": np.sqrt(10 ** local_quadratic(x, y, span)), "limit": math.sqrt(m), "n": m}))
    table = pd.concat(fits)
    small = F.broadcast(counts.sparkSession.createDataFrame(table))
    cut = F.least("value", F.col("mean") + F.col("sd") * F.col("limit"))
    clipped = rows.join(small, ["b", "gene"]).groupBy("b", "gene").agg(F.sum(cut).alias("s"), F.sum(cut * cut).alias("ss"), F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.first("n").alias("n")).toPandas()
    clipped["score"] = (clipped["n"] * clipped["mean"] ** 2 + clipped["ss"] - 2 * clipped["s"] * clipped["mean"]) / ((clipped["n"] - 1) * clipped["sd"] ** 2)
    clipped = clipped.sort_values(["b", "score", "gene"], ascending=[True, False, True])
    clipped["rank"] = clipped.groupby("b").cumcount()
    top = clipped[clipped["rank"] < n].groupby("gene").agg(rank=("rank", "median"), lists=("rank", "size")).reset_index()
    return list(top.sort_values(["rank", "lists", "gene"], ascending=[True, False, True])["gene"][:n])


def local_quadratic(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """At each x a quadratic fitted to the nearest share of points with tricube weights."""
    m = max(4, min(len(x), math.ceil(span * len(x))))
    out = np.empty(len(x))
    for i, at in enumerate(x):
        d = np.abs(x - at)
        near = np.argpartition(d, min(m, len(x)) - 1)[:m]
        h = max(d[near].max(), 1e-9)
        w = np.sqrt(np.maximum((1 - (d[near] / (h * 1.0001)) ** 3) ** 3, 1e-9))
        u = x[near] - at
        a = np.column_stack([np.ones(len(u)), u, u * u])
        out[i] = np.linalg.lstsq(a * w[:, None], y[near] * w, rcond=None)[0][0]
    return out


def preprocessed(counts: DataFrame, cells: DataFrame, n_top: int = 2000, batch: str | None = None, normalise: bool = True, by_batch: bool = True, scale_by_batch: bool = False, limit: float = 10.0) -> DataFrame:
    """counts normalised to 10,000 and log1p (unless done before), of the highly variable genes where there are more than n_top, over their deviation (per batch if asked for)."""
    values = ct.normalised(counts) if normalise else counts
    if values.select("gene").distinct().count() > n_top:
        genes = highly_variable(values, cells, n_top, batch if by_batch else None)
        values = values.join(F.broadcast(values.sparkSession.createDataFrame([(g,) for g in genes], "gene string")), "gene", "left_semi")
    if not (batch and scale_by_batch):
        return ct.scaled(values, cells.count(), limit)
    out = None
    for r in cells.groupBy(batch).count().collect():  # batches
        own = values.join(cells.where(F.col(batch) == r[batch]).select("cell"), "cell", "left_semi")
        part = ct.scaled(own, r["count"], limit)
        out = part if out is None else out.unionByName(part)
    return out


def yard_embedding(values: DataFrame, features: DataFrame, cells: DataFrame, share: float = 0.2, n: int = 20, batch: str | None = None, harmonise: bool = False) -> dict[str, DataFrame]:
    """identity (components of values), context (components of neighbourhood features) and mixed, all (cell, v). cells: (cell[, batch])."""
    parts = {}
    for name, rows in (("identity", values), ("context", features.select("cell", F.concat_ws(":", "kind", "gene").alias("gene"), "value"))):
        genes = sorted(r["gene"] for r in rows.select("gene").distinct().collect())  # a row for each feature
        wide = kept(em.vectors(rows, genes, cells), name)
        placed = em.principal(wide, n).applied(wide)
        if harmonise and batch:
            placed = em.harmonised(placed.join(cells.select("cell", F.col(batch).alias("batch")), "cell"), "batch").select("cell", "v")
        parts[name] = kept(placed, name)
    return parts | {"mixed": em.mixed(parts["identity"], parts["context"], share)}


def spatial_clusters(counts: DataFrame, points: DataFrame, mode: str = "auto", shares: dict[str, float] | None = None, k_spatial: int = 15, k_gradient: int | None = None, k_expr: int | None = 50, gradient: str | None = None, n: int = 20, resolution: float = 1.0, batch: str | None = None, integrate: str = "none", preprocess: bool = True, n_top: int = 2000, merge: bool = False, limit: float = 0.05, max_tests: int | None = 2000, seed: int = 0) -> DataFrame:
    """(cell, celltype and/or domain): clusters of cells by their own and their neighbours' expression. points: (id, x, y[, batch]).

    mode 'celltype' weighs neighbours by 0.2, 'domain' by 0.8, 'auto' gives both from one set of features. integrate: 'none', 'separate' (each batch by itself, its
    name before the labels) or 'joint' (components corrected for batches).
    """
    shares = {"celltype": 0.2, "domain": 0.8} | (shares or {})
    modes = ["celltype", "domain"] if mode == "auto" else [mode]
    if set(modes) - set(shares):
        raise ValueError(f"unknown mode {mode}")
    if integrate not in ("none", "separate", "joint"):
        raise ValueError(f"unknown integration {integrate}")
    if integrate != "none" and not batch:
        raise ValueError(f"integration {integrate} needs a batch")
    if integrate == "separate":
        out = None
        for b in sorted(str(r[0]) for r in points.select(F.col(batch).cast("string")).distinct().collect()):
            own = points.where(F.col(batch).cast("string") == b)
            part = spatial_clusters(counts.join(own.select(F.col("id").alias("cell")), "cell", "left_semi"), own.drop(batch), mode, shares, k_spatial, k_gradient, k_expr, gradient, n, resolution, None, "none", preprocess, n_top, merge, limit, max_tests, seed)
            part = part.select("cell", *(F.concat_ws("_", F.lit(b), m).alias(m) for m in modes))
            out = part if out is None else out.unionByName(part)
        return out
    cells = points.select(F.col("id").alias("cell"), *([batch] if batch else []))
    values = kept(preprocessed(counts, cells, n_top, batch), "values") if preprocess else counts
    features = kept(sp.neighbourhood_features(points, values, k_spatial, batch, gradient, k_gradient), "features")
    parts = yard_embedding(values, features, cells, 0.5, n, batch, integrate == "joint")
    out = cells.select("cell")
    for m in modes:
        mixed = kept(em.mixed(parts["identity"], parts["context"], shares[m]), "mixed")
        labels = clustered(mixed, k_expr, resolution, seed=seed)
        if merge:
            labels, _ = merged_clusters(values, labels, mixed, limit, max_tests)
        out = out.join(labels.withColumnRenamed("cluster", m), "cell")
    return out
