"""Alignment joins, set measures, anchors and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import average_ranks, quantiles
from .shared import kept


def checked_left_join(obs: DataFrame, positions: DataFrame, key: str) -> DataFrame:
    """Left join by a key that must be unique in positions and found for every row of obs."""
    if positions.groupBy(key).count().where("count > 1").take(1):
        raise ValueError(f"{key} is not unique")
    if missing := [r[key] for r in obs.join(positions, key, "left_anti").select(key).limit(5).collect()]:
        raise ValueError(f"no position for {missing}")
    return obs.join(positions, key, "left")


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes and Jaccard of two one-column sets; 1 if both are empty."""
    key = a.columns[0]
    both = a.distinct().withColumn("in_a", F.lit(1)).join(b.distinct().withColumn("in_b", F.lit(1)), key, "full")
    rows = both.agg(F.count("*").alias("either"), F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("both"))
    return rows.select("either", "both", F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(1.0).alias("jaccard"))


def mutual_pairs(ab: DataFrame, ba: DataFrame) -> DataFrame:
    """(a, b) where each is among the other's neighbours. ab, ba: (src, dst)."""
    return ab.select(F.col("src").alias("a"), F.col("dst").alias("b")).intersect(ba.select(F.col("dst").alias("a"), F.col("src").alias("b")))


def mirrored(anchors: DataFrame) -> DataFrame:
    swap = {"cell1": "cell2", "cell2": "cell1", "dataset1": "dataset2", "dataset2": "dataset1"}
    return anchors.unionByName(anchors.select(*(F.col(swap.get(c, c)).alias(c) for c in anchors.columns)))


def anchor_similarity(anchors: DataFrame, sizes: DataFrame) -> DataFrame:
    """(d1, d2, similarity): anchors between two datasets, both directions, over the smaller size. sizes: (dataset, n)."""
    pairs = anchors.groupBy(F.least("dataset1", "dataset2").alias("d1"), F.greatest("dataset1", "dataset2").alias("d2")).agg(F.count("*").alias("n"))
    joined = pairs.join(sizes.select(F.col("dataset").alias("d1"), F.col("n").alias("n1")), "d1").join(sizes.select(F.col("dataset").alias("d2"), F.col("n").alias("n2")), "d2")
    return joined.select("d1", "d2", (F.col("n") / F.least("n1", "n2")).alias("similarity"))


def normalised_scores(anchors: DataFrame, score: str = "score") -> DataFrame:
    """Scores between their 1st and 90th percentile, clipped to 0 to 1; 1 where these are equal."""
    low, high = quantiles(anchors, score, [0.01, 0.9])
    if low is None or high <= low:
        return anchors.withColumn(score, F.lit(1.0))
    return anchors.withColumn(score, F.least(F.greatest((F.col(score) - low) / (high - low), F.lit(0.0)), F.lit(1.0)))


def distribution(values: DataFrame, value: str) -> DataFrame:
    """n, least, q25, median, mean, q75, most of the numbers; no row without any."""
    rows = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    q25, median, q75 = quantiles(values, value, [0.25, 0.5, 0.75])
    return rows.where("n > 0").select("n", "least", F.lit(q25).cast("double").alias("q25"), F.lit(median).cast("double").alias("median"), "mean", F.lit(q75).cast("double").alias("q75"), "most")


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def correlation(pairs: DataFrame, a: str = "va", b: str = "vb", ranks: bool = False) -> float | None:
    """Pearson's (or, of ranks, Spearman's) correlation over rows finite on both sides; none under three rows."""
    rows = pairs.where(_finite(a) & _finite(b)).select(a, b)
    if ranks:
        rows = average_ranks(average_ranks(rows, a, "__a"), b, "__b").select(F.col("__a").alias(a), F.col("__b").alias(b))
    r = rows.agg(F.count("*").alias("n"), F.corr(a, b).alias("r")).first()
    return None if r["n"] < 3 else r["r"]


def compared(a: DataFrame, b: DataFrame, key: str, log10: bool = False) -> DataFrame:
    """n, correlation, median and largest difference of two series (key, value) on their common keys; log10 of values of 1e-9 at least."""
    value = F.log10(F.greatest("value", F.lit(1e-9))) if log10 else F.col("value")
    joined = a.select(key, value.alias("va")).join(b.select(key, value.alias("vb")), key).withColumn("gap", F.abs(F.col("va") - F.col("vb")))
    both = joined.where(_finite("va") & _finite("vb"))
    (median,) = quantiles(both, "gap", [0.5])
    return both.agg(F.count("*").alias("n"), F.when(F.count("*") > 2, F.corr("va", "vb")).alias("corr"), F.lit(median).cast("double").alias("median_gap"), F.max("gap").alias("max_gap"))


def compared_models(a: DataFrame, b: DataFrame, columns: tuple[str, ...] = ("theta", "intercept", "slope")) -> DataFrame:
    """(parameter, n, corr, median_gap, max_gap, inf_a, inf_b, inf_both) of two gene tables; infinite values are counted and left out."""
    out = None
    for c in columns:
        x, y = a.select("gene", F.col(c).alias("value")), b.select("gene", F.col(c).alias("value"))
        inf = F.col("value") == float("inf")
        both = x.where(inf).select("gene").intersect(y.where(inf).select("gene")).count()
        row = compared(x, y, "gene").select(F.lit(c).alias("parameter"), "*", F.lit(x.where(inf).count()).alias("inf_a"), F.lit(y.where(inf).count()).alias("inf_b"), F.lit(both).alias("inf_both"))
        out = row if out is None else out.unionByName(row)
    return out


def compared_matrices(a: DataFrame, b: DataFrame) -> DataFrame:
    """compared() over the entries (cell, gene) that both have."""
    name = F.struct("cell", "gene").alias("k")
    return compared(a.select(name, "value"), b.select(name, "value"), "k")


def gene_correlations(a: DataFrame, b: DataFrame, max_genes: int = 500) -> DataFrame:
    """(genes, median, mean) of the correlations over common cells of the first common genes; genes without spread on a side are skipped."""
    genes = a.select("gene").intersect(b.select("gene")).orderBy("gene").limit(max_genes)
    joined = a.join(F.broadcast(genes), "gene").select("cell", "gene", F.col("value").alias("va")).join(b.select("cell", "gene", F.col("value").alias("vb")), ["cell", "gene"])
    per = joined.groupBy("gene").agg(F.corr("va", "vb").alias("r"), F.stddev_pop("va").alias("sa"), F.stddev_pop("vb").alias("sb")).where("sa > 0 and sb > 0")
    return per.agg(F.count("*").alias("genes"), F.percentile("r", 0.5).alias("median"), F.avg("r").alias("mean"))  # at most max_genes rows


def gene_summary_comparison(a: DataFrame, b: DataFrame, column: str = "residual_variance") -> DataFrame:
    """compared() of a column of two gene tables, with Spearman's correlation."""
    x, y = (kept(t.select("gene", F.col(column).alias("value")), "summary") for t in (a, b))  # else each figure computes them anew
    pairs = x.withColumnRenamed("value", "va").join(y.withColumnRenamed("value", "vb"), "gene")
    return compared(x, y, "gene").withColumn("spearman", F.lit(correlation(pairs, ranks=True)).cast("double"))


def top_jaccard(attributes: DataFrame, given: DataFrame, n: int = 3000) -> DataFrame:
    """Jaccard of the n genes of largest residual variance and a given list of genes."""
    live = attributes.where(F.col("residual_variance").isNotNull() & ~F.isnan("residual_variance"))
    return jaccard(live.orderBy(F.desc("residual_variance"), "gene").limit(n).select("gene"), given.select("gene"))


def list_jaccards(lists: DataFrame) -> DataFrame:
    """(a, b, jaccard) of every two lists (list, gene), a before b."""
    rows = lists.select("list", "gene").distinct()
    size = rows.groupBy("list").agg(F.count("*").alias("n"))
    ids = size.select(F.col("list").alias("a"), F.col("n").alias("na")).join(size.select(F.col("list").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    shared = rows.select(F.col("list").alias("a"), "gene").join(rows.select(F.col("list").alias("b"), "gene"), "gene").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    both = F.coalesce("both", F.lit(0))
    return ids.join(shared, ["a", "b"], "left").select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("jaccard"))


def unordered_pairs(anchors: DataFrame, base: int = 0) -> DataFrame:
    """Distinct unordered pairs (u, v) of (dataset, cell) from anchors (cell1, dataset1, cell2, dataset2); cells count from base."""
    a, b = (F.struct(F.col(f"dataset{i}").cast("string").alias("dataset"), (F.col(f"cell{i}") - base).cast("long").alias("cell")) for i in (1, 2))
    return anchors.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def compared_anchors(a: DataFrame, b: DataFrame, base_a: int = 0, base_b: int = 0) -> DataFrame:
    """(n_a, n_b, shared, jaccard, share_of_a, ratio) of the unordered pairs of two anchor tables."""
    x, y = unordered_pairs(a, base_a).withColumn("in_a", F.lit(1)), unordered_pairs(b, base_b).withColumn("in_b", F.lit(1))
    n = x.join(y, ["u", "v"], "full").agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count(F.col("in_a") + F.col("in_b")).alias("shared"), F.count("*").alias("either"))
    safe = lambda top, bottom: F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))
    return n.select("n_a", "n_b", "shared", F.when(F.col("either") > 0, F.col("shared") / F.col("either")).otherwise(1.0).alias("jaccard"), safe("shared", "n_a").alias("share_of_a"), safe("n_b", "n_a").alias("ratio"))


def batch_sizes(obs: DataFrame, batch: str = "batch") -> DataFrame:
    return obs.groupBy(F.col(batch).alias("batch")).agg(F.count("*").alias("n"))


def batch_offsets(sizes: DataFrame, order: str = "batch") -> DataFrame:
    """sizes (batch, n) with start: the cells of the batches before, in the given order. There are few batches."""
    from pyspark.sql import Window

    return sizes.withColumn("start", F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))


def global_cells(anchors: DataFrame, offsets: DataFrame, base: int = 1) -> DataFrame:
    """anchors with cell1 and cell2 counted over all batches, from cells counted from base in their own dataset. offsets: (batch, n, start)."""
    for i in (1, 2):
        at = F.broadcast(offsets.select(F.col("batch").alias(f"dataset{i}"), F.col("start").alias(f"start{i}")))
        anchors = anchors.join(at, f"dataset{i}").withColumn(f"cell{i}", (F.col(f"cell{i}") - base + F.col(f"start{i}")).cast("long")).drop(f"start{i}")
    return anchors


def local_cells(anchors: DataFrame, offsets: DataFrame) -> DataFrame:
    """The reverse of global_cells: dataset1, cell1, dataset2, cell2 from cells counted over all batches, by the batches' ranges."""
    ranges = offsets.select("batch", "start", (F.col("start") + F.col("n")).alias("stop"))
    out = anchors.drop("dataset1", "dataset2")
    for i in (1, 2):
        r = F.broadcast(ranges.select(*(F.col(c).alias(f"{c}{i}") for c in ranges.columns)))
        out = out.join(r, (F.col(f"cell{i}") >= F.col(f"start{i}")) & (F.col(f"cell{i}") < F.col(f"stop{i}"))).withColumn(f"cell{i}", F.col(f"cell{i}") - F.col(f"start{i}")).withColumnRenamed(f"batch{i}", f"dataset{i}").drop(f"start{i}", f"stop{i}")
    return out


def aligned_to(rows: DataFrame, targets: DataFrame, name: str = "gene") -> DataFrame:
    """rows whose name, or its .N / -N variant, is among targets (gene, ord), under the target's name; the first variant and first row win, others go."""
    from pyspark.sql import Window

    from ..functions.scalars import aliases

    known = targets.select("gene", "ord").withColumn("alias", F.explode(aliases(F.col("gene"))))
    known = known.groupBy("alias").agg(F.min_by("gene", "ord").alias("__target"))
    asked = rows.withColumn("__row", F.monotonically_increasing_id()).select("*", F.posexplode(aliases(F.col(name))).alias("__at", "__alias"))
    hit = asked.join(known, F.col("__alias") == F.col("alias")).withColumn("__n", F.row_number().over(Window.partitionBy("__row").orderBy("__at"))).where("__n = 1")
    return hit.withColumn(name, F.col("__target")).withColumn("__m", F.row_number().over(Window.partitionBy(name).orderBy("__row"))).where("__m = 1").drop("__at", "__alias", "alias", "__target", "__n", "__m", "__row")
