"""Integration of batches: features, reciprocal components, scored anchors, weighted corrections along a tree of batches.

rows: (batch, cell, v array<double>) of the same features in the same order. Cells are unique over batches; batches are few.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import embedding as em
from .counts import integration_features
from .nearest import matrix, nearest_vectors
from .relations import anchor_similarity, mirrored, normalised_scores
from .shared import kept

#: Cells of the query that are corrected in one group.
CHUNK = 512


# Features and residuals


def selected_features(lists: DataFrame, n: int = 2000, given: Sequence[str] | None = None, universe: DataFrame | None = None) -> list[str]:
    """n features for all batches: the given ones, else those of most lists (list, rank, gene), ties by median rank. universe: (gene) of those that may be chosen."""
    if given is not None:
        return list(given)[:n]
    rows = lists if universe is None else lists.join(universe.select("gene"), "gene", "left_semi")
    return [r["gene"] for r in integration_features(rows, n).select("gene").collect()]


def telling_features(rows: DataFrame, features: Sequence[str], n: int, trees: int = 20, depth: int = 5, seed: int = 0) -> list[str]:
    """The n features by which a forest tells the batches apart best. rows: (batch, cell, v). Other learners rank features in another order."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    table = rows.select(F.col("batch").cast("string").alias("batch"), array_to_vector("v").alias("features"))
    model = StringIndexer(inputCol="batch", outputCol="label", stringOrderType="alphabetAsc").fit(table)
    learner = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed) if len(model.labels) == 2 else RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    weight = learner.fit(model.transform(table)).featureImportances.toArray()
    order = np.lexsort((np.arange(len(features)), -weight))
    return [features[i] for i in order[:n]]


def prepared(values: DataFrame, cells: DataFrame, features: Sequence[str], cached: DataFrame | None = None) -> DataFrame:
    """(batch, cell, v) of the features. values: (batch, cell, gene, value) of clipped residuals, centred here per batch and gene; cached ones are taken as they are."""
    centre = values.groupBy("batch", "gene").agg(F.avg("value").alias("m"))
    fresh = values.join(F.broadcast(centre), ["batch", "gene"]).select("batch", "cell", "gene", (F.col("value") - F.col("m")).alias("value"))
    if cached is not None:
        own = cached.select("batch", "cell", "gene", F.col("value").alias("held"))
        fresh = fresh.join(own, ["batch", "cell", "gene"], "full").select("batch", "cell", "gene", F.coalesce("held", "value").alias("value"))
    return cells.select("batch", "cell").join(em.vectors(fresh, features, cells), "cell").select("batch", "cell", "v")


def overlaid(own: DataFrame, other: DataFrame, cells: DataFrame) -> DataFrame:
    """own (batch, cell, gene, value) with other's values in batches whose cells other has all."""
    missing = cells.select("batch", "cell").join(other.select("cell").distinct(), "cell", "left_anti").select("batch").distinct()
    whole = other.join(cells.select("cell", "batch"), "cell").join(F.broadcast(missing), "batch", "left_anti").select("batch", "cell", "gene", F.col("value").alias("held"))
    return own.join(whole, ["batch", "cell", "gene"], "left").select("batch", "cell", "gene", F.coalesce("held", "value").alias("value"))


# Anchors


def batch_components(rows: DataFrame, dims: int = 30) -> dict[str, em.Components]:
    labels = sorted(str(r[0]) for r in rows.select(F.col("batch").cast("string")).distinct().collect())
    return {b: em.principal(rows.where(F.col("batch").cast("string") == b), dims) for b in labels}


def reciprocal(a: DataFrame, of_a: em.Components, b: DataFrame, of_b: em.Components, dims: int = 30, normalise: bool = True) -> tuple[DataFrame, DataFrame]:
    """(side, cell, v) of both batches in a's space and in b's: own cells by their components, the other's by uncentred projection.

    Components are divided by their deviation over both batches, then vectors by their length.
    """
    k = min(dims, of_a.loadings.shape[1], of_b.loadings.shape[1])
    cut = {n: em.Components(c.loadings[:, :k], c.mean, c.share) for n, c in (("a", of_a), ("b", of_b))}
    side = lambda df, x: df.select(F.lit(x).alias("side"), "cell", "v")
    out = []
    for own in ("a", "b"):
        space = reduce(lambda x, y: x.unionByName(y), [cut[own].applied(side(df, x), centre=x == own) for df, x in ((a, "a"), (b, "b"))])
        if normalise:
            space = em.by_length(em.by_deviation(kept(space, "space")))
        out.append(kept(space, "space"))
    return out[0], out[1]


def neighbour_lists(points: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(cell, near): the k nearest targets' cells in order. points, targets: (cell, v)."""
    found = nearest_vectors(points.select(F.col("cell").alias("id"), F.col("v").alias("p")), targets.select(F.col("cell").alias("id"), F.col("v").alias("p")), k)
    return found.groupBy(F.col("src").alias("cell")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "dst"))), lambda x: x["dst"]).alias("near"))


def pair_anchors(in_a: DataFrame, in_b: DataFrame, own_a: DataFrame, own_b: DataFrame, k_anchor: int = 5, k_score: int = 30, collide: bool = True) -> DataFrame:
    """(cell1, cell2, score) of mutual nearest neighbours, by how many of their neighbours agree.

    in_a, in_b: reciprocal(). Cells of a look for those of b in b's space and the reverse. Neighbours within a batch are those by its own
    components (own_a, own_b: cell, v), the cell itself included. collide: b's neighbours also count under their place in b as if they were the cells of a in
    that place, as the method that results are compared with has it.
    """
    part = lambda df, x: df.where(F.col("side") == x).select("cell", "v")
    k = max(k_anchor, k_score)
    ab = kept(neighbour_lists(part(in_b, "a"), part(in_b, "b"), k), "ab")
    ba = kept(neighbour_lists(part(in_a, "b"), part(in_a, "a"), k), "ba")
    first = lambda df, a, b: df.select(F.col("cell").alias(a), F.explode(F.slice("near", 1, k_anchor)).alias(b))
    pairs = first(ab, "cell1", "cell2").join(first(ba, "cell2", "cell1"), ["cell1", "cell2"]).distinct()
    if k_score <= 0:
        return pairs.withColumn("score", F.lit(1.0))
    aa, bb = neighbour_lists(own_a, own_a, k + 1), neighbour_lists(own_b, own_b, k + 1)
    top = lambda df, c, n: df.select(F.col("cell").alias(c), F.slice("near", 1, k_score).alias(n))
    joined = pairs.join(top(ab, "cell1", "n_ab"), "cell1").join(top(aa, "cell1", "n_aa"), "cell1").join(top(ba, "cell2", "n_ba"), "cell2").join(top(bb, "cell2", "n_bb"), "cell2")
    ours = F.array_union("n_ab", "n_aa")
    if collide:
        at = lambda df, n: df.select("cell", (F.row_number().over(Window.orderBy("cell")) - 1).alias(n))
        same = at(own_b, "at").withColumnRenamed("cell", "b").join(at(own_a, "at").withColumnRenamed("cell", "a"), "at").select("b", "a")
        more = joined.select("cell1", "cell2", F.explode("n_ab").alias("b")).join(same, "b").groupBy("cell1", "cell2").agg(F.collect_set("a").alias("n_raw"))
        joined = joined.join(more, ["cell1", "cell2"], "left")
        ours = F.array_union(ours, F.coalesce("n_raw", F.array().cast(joined.schema["n_aa"].dataType)))
    score = F.size(F.array_intersect(ours, F.array_union("n_ba", "n_bb"))).cast("double")
    return normalised_scores(kept(joined.select("cell1", "cell2", score.alias("score")), "scores"))


def all_anchors(rows: DataFrame, dims: int = 30, k_anchor: int = 5, k_score: int = 30, normalise: bool = True, collide: bool = True) -> DataFrame:
    """Anchors (cell1, cell2, score, dataset1, dataset2) of every two batches, in both directions."""
    parts = batch_components(rows, dims)
    labels, out = list(parts), []
    own = {b: kept(rows.where(F.col("batch").cast("string") == b).select("cell", "v"), "batch") for b in labels}
    inner = {b: kept(parts[b].applied(own[b]), "components") for b in labels}
    for i, a in enumerate(labels):
        for b in labels[i + 1 :]:
            in_a, in_b = reciprocal(own[a], parts[a], own[b], parts[b], dims, normalise)
            found = pair_anchors(in_a, in_b, inner[a], inner[b], k_anchor, k_score, collide)
            out.append(found.select("cell1", "cell2", "score", F.lit(a).alias("dataset1"), F.lit(b).alias("dataset2")))
    if not out:
        raise ValueError("one batch has no anchors")
    anchors = kept(reduce(lambda x, y: x.unionByName(y), out), "anchors")
    if not anchors.take(1):
        raise ValueError("no anchors between any two batches")
    return mirrored(anchors)


# Corrections


def anchor_weights(near: DataFrame, anchors: DataFrame, k: int = 100, sd: float = 1.0) -> DataFrame:
    """(cell, anchor, w) of each cell's first k anchors in order of its neighbours: 1 - exp(-d * score / (2 / sd)^2), summing to 1 (0 where all are 0).

    near: (cell, neighbour, d, place); anchors: (anchor, cell2, score).
    """
    met = near.join(anchors.select("anchor", F.col("cell2").alias("neighbour"), "score"), "neighbour")
    met = met.withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("place", "anchor"))).where(F.col("nth") <= k)
    raw = 1 - F.exp(-F.col("d") * F.col("score") / (2.0 / max(sd, 1e-9)) ** 2)
    total = F.sum("raw").over(Window.partitionBy("cell"))
    return met.withColumn("raw", raw).withColumn("w", F.when(total > 0, F.col("raw") / total).otherwise(0.0)).select("cell", "anchor", "w")


def corrected_pair(reference: DataFrame, query: DataFrame, anchors: DataFrame, k: int = 100, sd: float = 1.0, dims: int = 30) -> DataFrame:
    """query (cell, v) moved towards reference (cell, v): minus the weighted differences of the anchors near each cell, in the components of both.

    anchors: (cell1 of reference, cell2 of query, score). Cells without an anchor near, and all of them without any anchor, stay.
    """
    numbered = anchors.select("cell1", "cell2", "score").withColumn("anchor", F.row_number().over(Window.orderBy("cell1", "cell2")).cast("long")) if anchors.take(1) else None
    if numbered is None:
        return query
    numbered = kept(numbered, "anchors")
    both = reference.select("cell", "v").unionByName(query.select("cell", "v"))
    space = kept(em.principal(both, dims).applied(query.select("cell", "v")), "space")
    targets = space.join(numbered.select(F.col("cell2").alias("cell")).distinct(), "cell", "left_semi")
    near = nearest_vectors(space.select(F.col("cell").alias("id"), F.col("v").alias("p")), targets.select(F.col("cell").alias("id"), F.col("v").alias("p")), k)
    weights = kept(anchor_weights(near.select(F.col("src").alias("cell"), F.col("dst").alias("neighbour"), "d", "place"), numbered, k, sd), "weights")
    one = reference.select(F.col("cell").alias("cell1"), F.col("v").alias("a"))
    two = query.select(F.col("cell").alias("cell2"), F.col("v").alias("b"))
    deltas = kept(numbered.join(one, "cell1").join(two, "cell2").select("anchor", F.zip_with("b", "a", lambda x, y: x - y).alias("delta")), "deltas")
    return moved(query, weights, deltas)


def moved(query: DataFrame, weights: DataFrame, deltas: DataFrame) -> DataFrame:
    """query (cell, v) minus the sums of weights (cell, anchor, w) times deltas (anchor, delta). A group of cells gets each difference that it needs once."""
    chunks = max(1, query.count() // CHUNK)
    of = lambda df: df.withColumn("chunk", F.pmod(F.xxhash64("cell"), F.lit(chunks)))
    own = of(query.select("cell", "v").join(weights.groupBy("cell").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("w").alias("ws")), "cell", "left"))
    needed = of(weights).select("chunk", "anchor").distinct().join(deltas, "anchor").select("chunk", "anchor", "delta")

    def move(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return pa.table({"cell": a.column("cell"), "v": a.column("v")})
        dims = len(a.column("v")[0])
        v = matrix(a.column("v"), dims).copy()
        if b.num_rows:
            names, d = b.column("anchor").to_numpy(), matrix(b.column("delta"), dims)
            order = np.argsort(names)
            names, d = names[order], d[order]
            for i, (anchors, ws) in enumerate(zip(a.column("anchors").to_pylist(), a.column("ws").to_pylist(), strict=True)):
                if anchors:
                    v[i] -= np.array(ws) @ d[np.searchsorted(names, anchors)]
        return pa.table({"cell": a.column("cell"), "v": pa.array(list(v), pa.list_(pa.float64()))})

    kind = query.schema["cell"].dataType.simpleString()
    return own.groupBy("chunk").cogroup(needed.groupBy("chunk")).applyInArrow(lambda a, b: move(a, b), f"cell {kind}, v array<double>")


def learned_pair(reference: DataFrame, query: DataFrame, anchors: DataFrame, components: int = 20, trees: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """query plus the difference that boosted trees predict for each cell from its components; they learn the anchors' differences (query minus reference).

    Added, not taken away, as in the method that results are compared with; under two anchors their mean difference is added.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    one = reference.select(F.col("cell").alias("cell1"), F.col("v").alias("a"))
    two = query.select(F.col("cell").alias("cell2"), F.col("v").alias("b"))
    deltas = kept(anchors.join(one, "cell1").join(two, "cell2").select(F.col("cell2").alias("cell"), F.zip_with("b", "a", lambda x, y: x - y).alias("v")), "deltas")
    n = deltas.count()
    if n < 2:
        only = deltas.first()
        return query if only is None else query.withColumn("v", F.zip_with("v", F.array(*map(F.lit, only["v"])), lambda x, y: x + y))
    parts = em.principal(deltas, components)
    space = em.principal(query, components)
    places = kept(space.applied(query.select("cell", "v")), "places")
    train = kept(parts.applied(deltas).select("cell", F.col("v").alias("y")).join(places, "cell").select(array_to_vector("v").alias("x"), "y"), "train")
    out = places.select("cell", array_to_vector("v").alias("x"))
    k = parts.loadings.shape[1]
    for i in range(k):
        model = GBTRegressor(featuresCol="x", labelCol="label", predictionCol=f"p{i}", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(train.select("x", F.col("y")[i].alias("label")))
        out = model.transform(out)
    predicted = out.select("cell", F.array(*(F.col(f"p{i}") for i in range(k))).alias("v"))
    change = em.multiplied(predicted, parts.loadings.T, np.zeros(k)).select("cell", F.col("v").alias("d"))
    mean = F.array(*(F.lit(float(x)) for x in parts.mean))
    return query.join(change, "cell").select("cell", F.zip_with("v", F.zip_with("d", mean, lambda x, y: x + y), lambda x, y: x + y).alias("v"))


def average_linkage(distances: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(left, right, distance, size) of each merge; merges are numbered after the leaves. For few things: distances is a full matrix."""
    d = np.array(distances, float)
    np.fill_diagonal(d, np.inf)
    name, size, out = list(range(len(d))), [1] * len(d), []
    while len(name) > 1:
        i, j = divmod(int(np.argmin(d)), len(d))
        i, j = min(i, j), max(i, j)
        low, high = sorted((name[i], name[j]))
        out.append((low, high, float(d[i, j]), size[i] + size[j]))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        name[i], size[i] = len(distances) + len(out) - 1, size[i] + size[j]
        del name[j], size[j]
    return out


def leaves_of(tree: Sequence[tuple[int, int, float, int]], node: int, n: int) -> list[int]:
    return [node] if node < n else [x for child in tree[node - n][:2] for x in leaves_of(tree, child, n)]


def batch_tree(similarity: np.ndarray) -> list[tuple[int, int]]:
    """The order in which batches are merged, most similar first."""
    n = len(similarity)
    if n <= 1:
        return []
    return [(0, 1)] if n == 2 else [(a, b) for a, b, *_ in average_linkage(1 / np.maximum(similarity, 1e-9))]


def pair_of_clusters(anchors: DataFrame, reference: DataFrame, query: DataFrame) -> DataFrame:
    """Anchors from a cell of reference to one of query, whichever way they were found; mirrored anchors give each pair twice."""
    a, b = reference.select(F.col("cell").alias("r")), query.select(F.col("cell").alias("q"))
    ways = [anchors.select(F.col(f"cell{i}").alias("cell1"), F.col(f"cell{j}").alias("cell2"), "score") for i, j in ((1, 2), (2, 1))]
    return ways[0].unionByName(ways[1]).join(a, F.col("cell1") == F.col("r"), "left_semi").join(b, F.col("cell2") == F.col("q"), "left_semi")


def integrated(rows: DataFrame, anchors: DataFrame, k: int = 100, sd: float = 1.0, dims: int = 30, preserve_order: bool = False, method: str = "weights", **learner) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(batch, cell, v) of all batches, merged along a tree of anchor similarity, and the tree. The larger side is the reference unless preserve_order.

    method: 'weights' or 'trees' (learned_pair, which takes `learner`). Each merge is written; a lost executor repeats one merge at most.
    """
    if method not in ("weights", "trees"):
        raise ValueError(f"unknown method {method}")
    sizes = {str(r["batch"]): r["n"] for r in rows.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    labels = sorted(sizes)
    frame = rows.sparkSession.createDataFrame([(b, n) for b, n in sizes.items()], "dataset string, n long")
    similarity = np.zeros((len(labels), len(labels)))
    for r in anchor_similarity(anchors, frame).collect():
        i, j = labels.index(r["d1"]), labels.index(r["d2"])
        similarity[i, j] = similarity[j, i] = r["similarity"]
    tree = batch_tree(similarity)
    held = {i: (rows.where(F.col("batch").cast("string") == b).select("cell", "v"), sizes[b]) for i, b in enumerate(labels)}
    for step, (left, right) in enumerate(tree):
        (a, n), (b, m) = held.pop(left), held.pop(right)
        if m > n and not preserve_order:
            a, b = b, a
        met = pair_of_clusters(anchors, a, b)
        fixed = corrected_pair(a, b, met, k, sd, dims) if method == "weights" else learned_pair(a, b, met, **learner)
        held[len(labels) + step] = (kept(a.unionByName(fixed.select("cell", "v")), "merged"), n + m)
    (out, _) = held.popitem()[1]
    return rows.select("batch", "cell").join(out, "cell").select("batch", "cell", "v"), tree


def integrate(rows: DataFrame, dims: int = 30, k_anchor: int = 5, k_score: int = 30, k_weight: int = 100, sd: float = 1.0, normalise: bool = True, preserve_order: bool = False, method: str = "weights", **learner) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """Integrated rows (batch, cell, v), the anchors and the tree."""
    if bad := rows.where(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).count():
        raise ValueError(f"{bad} cells with values that aren't finite")
    anchors = kept(all_anchors(rows, dims, k_anchor, k_score, normalise), "anchors")
    out, tree = integrated(rows, anchors, k_weight, sd, dims, preserve_order, method, **learner)
    return out, anchors, tree


def integrate_counts(counts: DataFrame, cells: DataFrame, batch: str, n_features: int = 2000, features: Sequence[str] | None = None, settings=None, n_top: int = 3000, **how) -> tuple[DataFrame, list[str]]:
    """From counts (cell, gene, value) and cells (cell, batch) to integrated vectors: a model for each batch, common features, residuals, integration.

    Residuals are clipped at the root of (largest batch / 30) and centred per batch.
    """
    from . import sct

    sizes = cells.groupBy(batch).count().agg(F.max("count")).first()[0]
    clip = sct.residual_clip(sizes)
    assays, _, _ = sct.per_batch(counts, cells, batch, settings or sct.Settings(flavour="v2"), n_top, clip=clip)
    universe = sct.shared_genes(counts.sparkSession.createDataFrame([(b, g) for b, a in assays.items() for g in a.fit.model.index], "batch string, gene string"), len(assays))
    chosen = selected_features(sct.ranked_features(assays), n_features, features, universe)
    parts = [sct.residuals(a.fit, chosen, clip=clip).select(F.lit(b).alias("batch"), "cell", "gene", F.col("r").alias("value")) for b, a in assays.items()]
    labelled = cells.select("cell", F.col(batch).cast("string").alias("batch"))
    rows = kept(prepared(reduce(lambda x, y: x.unionByName(y), parts), labelled, chosen), "prepared")
    return integrate(rows, **how)[0], chosen
