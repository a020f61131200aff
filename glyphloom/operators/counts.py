"""Count matrices as long relations (cell, gene, value): binning, statistics, normalisation, residuals, feature choice."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles

#: Numbers of one dense block of cells and genes that a task holds at once.
BLOCK = 1 << 20


def rebinned(bins: DataFrame, size: int) -> DataFrame:
    """(bx, by, gene, value): sums over square bins. bins: (x, y, gene, value)."""
    return bins.groupBy(F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"), "gene").agg(F.sum("value").alias("value"))


def bin_centres(bins: DataFrame, size: int) -> DataFrame:
    return bins.select(F.concat_ws("_", "bx", "by").alias("cell"), (F.col("bx") * size + size // 2).alias("x"), (F.col("by") * size + size // 2).alias("y"), "gene", "value")


def cells_of_labels(bins: DataFrame) -> DataFrame:
    """(label, gene, value) with label 0 left out."""
    return bins.where("label <> 0").groupBy("label", "gene").agg(F.sum("value").alias("value"))


def label_summary(bins: DataFrame) -> DataFrame:
    return bins.where("label <> 0").groupBy("label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("bins"))


def cell_attributes(counts: DataFrame) -> DataFrame:
    """Per cell: umi, gene, and their logarithms and quotient."""
    rows = counts.groupBy("cell").agg(F.sum("value").alias("umi"), F.count(F.when(F.col("value") > 0, 1)).alias("gene"))
    per = F.col("umi") / F.greatest("gene", F.lit(1))
    return rows.select("cell", "umi", F.log10(F.col("umi") + 1e-9).alias("log_umi"), "gene", F.log10(F.col("gene") + 1e-9).alias("log_gene"), per.alias("umi_per_gene"), F.log10(per + 1e-9).alias("log_umi_per_gene"))


def gene_attributes(counts: DataFrame, n_cells: Column | int, eps: float = 1.0) -> DataFrame:
    """Per gene over all cells, absent entries as zeros: detection rate, geometric mean, mean, variance."""
    n = F.lit(n_cells)
    rows = counts.groupBy("gene").agg(F.count(F.when(F.col("value") >= 0.01, 1)).alias("seen"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.sum(F.log(F.col("value") + eps) - F.log(F.lit(eps))).alias("logs"))
    mean = F.col("s") / n
    return rows.select("gene", (F.col("seen") / n).alias("detection_rate"), (F.exp(F.col("logs") / n + F.log(F.lit(eps))) - eps).alias("gmean"), mean.alias("amean"), (F.col("ss") / n - mean * mean).alias("variance"))


def detected(counts: DataFrame, min_cells: int) -> DataFrame:
    """Genes that at least min_cells cells show."""
    return counts.where("value >= 0.01").groupBy("gene").agg(F.count("*").alias("cells")).where(F.col("cells") >= min_cells)


def normalised(counts: DataFrame, total: float = 1e4) -> DataFrame:
    """ln(1 + value scaled to a total per cell)."""
    return counts.withColumn("value", F.log1p(F.col("value") * total / F.sum("value").over(Window.partitionBy("cell"))))


def nonzero_median(counts: DataFrame) -> DataFrame:
    (median,) = quantiles(counts.where("value <> 0"), "value", [0.5])
    return counts.sparkSession.createDataFrame([(median,)], "median double")


def min_variance(counts: DataFrame, mode: float | str = "umi_median") -> float:
    """A number as it is; 'umi_median' is (median of the non-zero counts / 5) squared."""
    if not isinstance(mode, str):
        return float(mode)
    if mode != "umi_median":
        raise ValueError(f"unknown variance floor {mode}")
    (median,) = quantiles(counts.where("value <> 0"), "value", [0.5])
    return ((median or 0.0) / 5) ** 2


def dense_rows(counts: DataFrame, cells: DataFrame, genes: Sequence[str], f: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], name: str = "value") -> DataFrame:
    """(cell, gene, name): f(cells' rows, their values of the genes) for every cell and gene, absent entries as zeros.

    A cell's stored entries move once, as one row; the dense block is made inside a task, BLOCK numbers at a time. genes: one row for
    each, so they are held on the driver and sent with the task.
    """
    spark, names = counts.sparkSession, list(genes)
    index = spark.createDataFrame([(g, i) for i, g in enumerate(names)], "gene string, gi int")
    packed = counts.join(F.broadcast(index), "gene").groupBy("cell").agg(F.collect_list(F.struct("gi", F.col("value").cast("double").alias("v"))).alias("stored"))
    kind = cells.schema["cell"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, column = max(1, BLOCK // max(1, len(names))), pa.array(names, pa.string())
        for whole in batches:
            for at in range(0, len(whole), step):
                b = whole.slice(at, step)
                y = np.zeros((len(b), len(names)))
                stored = b.column("stored")
                flat = stored.flatten()
                if len(flat):
                    of = np.repeat(np.arange(len(b)), np.nan_to_num(stored.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                    y[of, flat.field("gi").to_numpy()] = flat.field("v").to_numpy()
                out = f(b, y)
                row = pa.array(np.repeat(np.arange(len(b)), len(names)))
                yield pa.record_batch([b.column("cell").take(row), column.take(pa.array(np.tile(np.arange(len(names)), len(b)))), pa.array(out.ravel())], ["cell", "gene", name])

    if not names:
        return spark.createDataFrame([], f"cell {kind}, gene string, {name} double")
    return cells.join(packed, "cell", "left").mapInArrow(rows, f"cell {kind}, gene string, {name} double")


def pearson_residual(y: Column, mu: Column, theta: Column, min_var: float | Column = float("-inf")) -> Column:
    """(y - mu) over the root of the model's variance; a theta of infinity is Poisson."""
    var = F.when(theta == F.lit(float("inf")), mu).otherwise(mu + mu * mu / theta)
    return (y - mu) / F.sqrt(F.greatest(var, F.lit(min_var)))


def deviance_residual(y: Column, mu: Column, theta: Column) -> Column:
    first = F.when(y > 0, y * F.log(y / mu)).otherwise(0.0)
    second = F.when(theta == F.lit(float("inf")), y - mu).otherwise((y + theta) * F.log((y + theta) / (mu + theta)))
    return F.signum(y - mu) * F.sqrt(F.greatest(2 * (first - second), F.lit(0.0)))


def residuals(counts: DataFrame, model: DataFrame, cells: DataFrame, clip: float | None = None, min_var: float = float("-inf")) -> DataFrame:
    """(cell, gene, r) for every gene of the model and every cell. model: (gene, theta, intercept, slope), a row for each gene; cells: (cell, log_umi)."""
    m = model.select("gene", "theta", "intercept", "slope").toPandas().sort_values("gene")
    theta, intercept, slope = (m[c].to_numpy(float) for c in ("theta", "intercept", "slope"))

    def block(b: pa.RecordBatch, y: np.ndarray) -> np.ndarray:
        mu = np.exp(intercept + slope * b.column("log_umi").to_numpy()[:, None])
        r = (y - mu) / np.sqrt(np.maximum(np.where(np.isinf(theta), mu, mu + mu * mu / theta), min_var))
        return np.clip(r, -clip, clip) if clip else r

    return dense_rows(counts, cells.select("cell", "log_umi"), m["gene"].tolist(), block, "r")


def residual_moments(counts: DataFrame, model: DataFrame, cells: DataFrame, clip: float | None = None, min_var: float = float("-inf")) -> DataFrame:
    """(gene, residual_mean, residual_variance) over all cells without the grid of genes and cells.

    The residual of an absent entry depends on the gene and the cell's log_umi alone: its sums run over distinct log_umi, and
    stored entries add what they differ by.
    """
    cells = cells.select("cell", "log_umi")
    model = F.broadcast(model.select("gene", "theta", "intercept", "slope"))  # a row for each gene

    def r(y: Column) -> Column:
        v = pearson_residual(y, F.exp(F.col("intercept") + F.col("slope") * F.col("log_umi")), F.col("theta"), min_var)
        return F.least(F.greatest(v, F.lit(-clip)), F.lit(clip)) if clip else v

    alike = cells.groupBy("log_umi").agg(F.count("*").alias("cells"))
    zero = r(F.lit(0.0))
    base = alike.crossJoin(model).groupBy("gene").agg(F.sum("cells").alias("n"), F.sum(F.col("cells") * zero).alias("s"), F.sum(F.col("cells") * zero * zero).alias("ss"))
    stored = r(F.col("value").cast("double"))
    own = counts.join(cells, "cell").join(model, "gene").groupBy("gene").agg(F.sum(stored - zero).alias("ds"), F.sum(stored * stored - zero * zero).alias("dss"))
    s, ss = F.col("s") + F.coalesce("ds", F.lit(0.0)), F.col("ss") + F.coalesce("dss", F.lit(0.0))
    return base.join(own, "gene", "left").select("gene", (s / F.col("n")).alias("residual_mean"), F.when(F.col("n") > 1, F.greatest((ss - s * s / F.col("n")) / (F.col("n") - 1), F.lit(0.0))).alias("residual_variance"))


def residual_variance(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gene").agg(F.var_samp("r").alias("residual_variance"))


def top_features(genes: DataFrame, n: int | None, threshold: float = 1.3) -> DataFrame:
    """The n genes of largest residual variance, or all of at least the threshold."""
    live = genes.where(F.col("residual_variance").isNotNull() & ~F.isnan("residual_variance"))
    return live.orderBy(F.desc("residual_variance"), "gene").limit(n) if n else live.where(F.col("residual_variance") >= threshold)


def integration_features(lists: DataFrame, n: int) -> DataFrame:
    """(gene, lists, median_rank) of the n genes that most lists hold, ties by median rank, then name. lists: (list, rank, gene)."""
    return lists.groupBy("gene").agg(F.countDistinct("list").alias("lists"), F.percentile("rank", 0.5).alias("median_rank")).orderBy(F.desc("lists"), "median_rank", "gene").limit(n)


def gene_moments(counts: DataFrame, n_cells: int) -> DataFrame:
    """(gene, mean, sd) over all cells, absent entries as zeros; sd with ddof 1, and 1 without spread."""
    rows = counts.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    n = F.lit(float(n_cells))
    var = (F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1)
    return rows.select("gene", (F.col("s") / n).alias("mean"), F.when(var > 0, F.sqrt(var)).otherwise(1.0).alias("sd"))


def scaled(counts: DataFrame, n_cells: int, limit: float = 10.0) -> DataFrame:
    """Stored entries over their gene's sd among all cells, at most the limit: the sparse form, which doesn't centre."""
    return counts.join(F.broadcast(gene_moments(counts, n_cells)), "gene").select("cell", "gene", F.least(F.col("value") / F.col("sd"), F.lit(limit)).alias("value"))


def scaled_dense(counts: DataFrame, cells: DataFrame, limit: float = 10.0) -> DataFrame:
    """(cell, gene, value) for every cell and gene: centred, over the gene's sd, within the limit on both sides."""
    m = gene_moments(counts, cells.count()).toPandas().sort_values("gene")  # a row for each gene
    mean, sd = m["mean"].to_numpy(float), m["sd"].to_numpy(float)
    return dense_rows(counts, cells.select("cell"), m["gene"].tolist(), lambda b, y: np.clip((y - mean) / sd, -limit, limit))


def percentile_scaled(counts: DataFrame, n_cells: int, low: float, high: float) -> DataFrame:
    """Stored entries clipped to two percentiles of the gene over all cells, absent ones as zeros, and scaled to 0 to 1; 0 where the two are equal.

    An absent entry has (0 clipped - low) / (high - low): the column `zero` of each row tells it.
    """
    zeros = counts.groupBy("gene").agg((F.lit(n_cells) - F.count("*")).alias("times"), F.lit(0.0).alias("value"))
    all_ = counts.select("gene", F.lit(1).cast("long").alias("times"), F.col("value").cast("double").alias("value")).unionByName(zeros.where("times > 0").select("gene", F.col("times").cast("long").alias("times"), "value"))
    cut = all_.groupBy("gene").agg(F.percentile("value", low, F.col("times")).alias("lo"), F.percentile("value", high, F.col("times")).alias("hi"))

    def share(v: Column) -> Column:
        return F.when(F.col("hi") > F.col("lo"), (F.least(F.greatest(v, F.col("lo")), F.col("hi")) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)

    return counts.join(F.broadcast(cut), "gene").select("cell", "gene", share(F.col("value")).alias("value"), share(F.lit(0.0)).alias("zero"))


def quality_metrics(counts: DataFrame, top: tuple[int, ...] = (50, 100, 200, 500)) -> DataFrame:
    """Per cell: total_counts, n_genes_by_counts, their log1p, and the percentage of the total in its `top` largest genes."""
    place = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("value"), "gene"))
    shares = [F.sum(F.when(F.col("place") <= n, F.col("value"))).alias(f"top{n}") for n in top]
    rows = counts.where("value <> 0").withColumn("place", place).groupBy("cell").agg(F.sum("value").alias("total_counts"), F.count("*").alias("n_genes_by_counts"), *shares)
    return rows.select("cell", "total_counts", "n_genes_by_counts", F.log1p("total_counts").alias("log1p_total_counts"), F.log1p("n_genes_by_counts").alias("log1p_n_genes_by_counts"), *((F.col(f"top{n}") * 100 / F.col("total_counts")).alias(f"pct_counts_in_top_{n}_genes") for n in top))


def gene_quality(counts: DataFrame, n_cells: int) -> DataFrame:
    """Per gene: n_cells_by_counts, total_counts, mean_counts, pct_dropout_by_counts and log1p of total and mean."""
    rows = counts.where("value <> 0").groupBy("gene").agg(F.count("*").alias("n_cells_by_counts"), F.sum("value").alias("total_counts"))
    mean = F.col("total_counts") / n_cells
    return rows.select("gene", "n_cells_by_counts", "total_counts", mean.alias("mean_counts"), F.log1p("total_counts").alias("log1p_total_counts"), F.log1p(mean).alias("log1p_mean_counts"), (100 * (1 - F.col("n_cells_by_counts") / n_cells)).alias("pct_dropout_by_counts"))
