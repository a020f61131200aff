"""Variance stabilisation of counts: per-gene regressions on a sample, smoothing over genes, residuals and corrected counts.

Tables: counts (cell, gene, value), cells (cell, covariates). Models are pandas tables with one row for each gene (theta and one
column for each term), which the driver holds; cells and counts stay distributed. Fits see a bounded sample of cells (n_cells) and
genes (n_genes).
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import countmodel as cm
from ..functions.rsample import RSample
from . import counts as ct
from .ranks import numbered, quantiles

SEED = 1448145
#: The default number of sampled cells, and the one that flavour v2 puts in its place.
N_CELLS, N_CELLS_V2 = 5000, 2000
#: Covariates that counts themselves give.
COVARIATES = ("umi", "log_umi", "gene", "log_gene", "umi_per_gene", "log_umi_per_gene")


@dataclass(frozen=True)
class Settings:
    latent: tuple[str, ...] = ("log_umi",)
    batch: str | None = None
    nonreg: tuple[str, ...] = ()
    n_cells: int = N_CELLS
    n_genes: int | None = 2000
    min_cells: int = 5
    method: str = "poisson"
    flavour: str | None = None
    exclude_poisson: bool = False
    fixed_slope: bool = False
    min_variance: float | str = -math.inf
    dispersion: str = "od_factor"
    bandwidth: float = 3.0
    gmean_eps: float = 1.0
    residual: str = "pearson"
    regularise: bool = True
    clip: float | None = None
    seed: int = SEED
    draws: str = "hash"  # or "r": R's sample(), over cells and genes in order of their names


def with_flavour(s: Settings) -> Settings:
    """Flavour v2: offset fits, no Poisson genes in the smoothing, a fixed slope, a variance floor, fewer cells."""
    if s.flavour is None:
        return s
    if s.flavour != "v2":
        raise ValueError(f"unknown flavour {s.flavour}")
    if s.method == "nb_offset":
        raise ValueError("flavour v2 has its own offset method")
    return replace(s, method="offset", exclude_poisson=True, fixed_slope=True, min_variance="umi_median" if s.min_variance == -math.inf else s.min_variance, n_cells=N_CELLS_V2 if s.n_cells in (None, N_CELLS) else s.n_cells)


@dataclass
class Fit:
    """What vst() found. model: the regularised parameters of every gene; step1: the fits of the sampled genes, with `outlier`."""

    settings: Settings
    model: pd.DataFrame
    step1: pd.DataFrame | None
    genes: pd.DataFrame  # gene, log_gmean, amean, variance, detection_rate
    cells: DataFrame  # cell, design array<double>, log_umi
    counts: DataFrame  # of the kept genes
    terms: list[str]
    n_cells: int
    clip: float
    min_variance: float
    sample: list = field(default_factory=list)


# Covariates and designs


def formula(latent: Sequence[str] = ("log_umi",), batch: str | None = None) -> str:
    terms = " + ".join(latent)
    return f"y ~ ({terms}):{batch} + {batch} - 1" if batch else f"y ~ {terms}"


def cell_covariates(counts: DataFrame, cells: DataFrame | None, settings: Settings) -> DataFrame:
    """cells with every covariate that the settings name; those of COVARIATES that are missing come from the counts. A null or an infinite one is an error."""
    needed = [*settings.latent, *settings.nonreg, *([settings.batch] if settings.batch else [])]
    own = ct.cell_attributes(counts)
    base = own.select("cell") if cells is None else cells
    missing = [c for c in dict.fromkeys([*needed, "log_umi"]) if c not in base.columns]
    if unknown := [c for c in missing if c not in COVARIATES]:
        raise ValueError(f"unknown covariates {unknown}")
    if missing:
        sums = own.select("cell", *missing)
        base = base.join(sums, "cell", "left").fillna(0.0 if cells is None else -9.0, [c for c in missing if c.startswith("log_")]).fillna(0, [c for c in missing if not c.startswith("log_")])
    numeric = [c for c in needed if c != settings.batch]
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == math.inf) for c in numeric], F.lit(False))
    if settings.batch:
        bad = bad | F.col(settings.batch).isNull()
    if base.where(bad).take(1):
        raise ValueError(f"null or infinite covariates among {needed}")
    return base


def design(cells: DataFrame, settings: Settings, extra: Sequence[str] = ()) -> tuple[list[str], Column]:
    """Names and values of the regression's columns: an intercept and the covariates, or both for each batch."""
    latent = list(settings.latent)
    if not settings.batch:
        names, values = ["Intercept", *latent], [F.lit(1.0), *(F.col(c).cast("double") for c in latent)]
    else:
        levels = sorted(str(r[0]) for r in cells.select(F.col(settings.batch).cast("string")).distinct().collect())  # batches are few
        names, values = [], []
        for b in levels:
            own = F.col(settings.batch).cast("string") == b
            names += [f"{settings.batch}[{b}]", *(f"{c}:{settings.batch}[{b}]" for c in latent)]
            values += [F.when(own, 1.0).otherwise(0.0), *(F.when(own, F.col(c).cast("double")).otherwise(0.0) for c in latent)]
    for c in extra:
        names.append(f"nonreg:{c}")
        values.append(F.col(c).cast("double"))
    return names, F.array(*values)


# The sample


def generator(s: Settings) -> RSample | None:
    """The stream of draws that cells and then genes are taken from; none for draws by hashes, which need no order."""
    if s.draws not in ("hash", "r"):
        raise ValueError(f"unknown draws {s.draws}")
    return RSample(s.seed) if s.draws == "r" else None


def sampled_cells(cells: DataFrame, n: int | None, seed: int, stream: RSample | None = None) -> list:
    """n cells in order of a hash with the seed: the same for the same cells, whatever their order. With a stream, R's draws from the cells in order."""
    n = n or N_CELLS
    if stream is not None:
        total = cells.count()
        if n >= total:
            return [r["cell"] for r in cells.select("cell").orderBy("cell").collect()]  # n at most
        drawn = stream.places(total, n)
        order = {p: k for k, p in enumerate(drawn)}
        wanted = cells.sparkSession.createDataFrame([(p,) for p in drawn], "ord long")
        rows = numbered(cells.select("cell"), "cell").join(F.broadcast(wanted), "ord").collect()
        return [r["cell"] for r in sorted(rows, key=lambda r: order[r["ord"]])]
    rows = cells.select("cell", F.xxhash64(F.col("cell").cast("string"), F.lit(seed)).alias("at"))
    return [r["cell"] for r in rows.orderBy("at", "cell").limit(n).collect()]


def sampled_genes(log_gmean: pd.Series, n: int | None, seed: int, stream: RSample | None = None) -> list[str]:
    """n genes without replacement, each with a weight of one over the density of its mean."""
    if not n or n >= len(log_gmean):
        return list(log_gmean.index)
    x = log_gmean.to_numpy(float)
    weight = 1 / (cm.density(x, x) + cm.EPS)
    if stream is not None:
        return [log_gmean.index[i] for i in stream.weighted(weight, n)]
    key = -np.log(np.random.default_rng(seed).random(len(x))) / weight  # the smallest keys are such a sample
    return list(log_gmean.index[np.argsort(key, kind="stable")[:n]])


def gene_table(counts: DataFrame, n_cells: int, settings: Settings) -> pd.DataFrame:
    """One row for each gene that min_cells cells show: log10 of the geometric mean, mean, variance, detection rate."""
    seen = ct.detected(counts, settings.min_cells).select("gene")
    rows = ct.gene_attributes(counts.join(seen, "gene", "left_semi"), n_cells, settings.gmean_eps).toPandas().set_index("gene").sort_index()
    rows["log_gmean"] = np.log10(np.maximum(rows["gmean"], 1e-9))
    return rows


# Fits


def fitted(counts: DataFrame, genes: Sequence[str], cells: Sequence, matrix: np.ndarray, terms: Sequence[str], method: str) -> pd.DataFrame:
    """theta and coefficients of each gene's regression over the sampled cells. matrix: their designs, in the order of cells.

    Genes go to tasks with their stored entries only; a task fits its genes all at once. method: 'poisson', 'offset' or 'nb_offset'.
    """
    spark = counts.sparkSession
    if method not in ("poisson", "offset", "nb_offset", "glmGamPoi_offset"):
        raise ValueError(f"unknown method {method}")
    kind = counts.schema["cell"].dataType
    from pyspark.sql import types as T

    place = spark.createDataFrame([(c, i) for i, c in enumerate(cells)], T.StructType([T.StructField("cell", kind), T.StructField("at", T.IntegerType())]))
    wanted = spark.createDataFrame([(g,) for g in genes], "gene string")
    rows = counts.join(F.broadcast(wanted), "gene").join(F.broadcast(place), "cell").groupBy("gene").agg(F.collect_list(F.struct("at", F.col("value").cast("double").alias("v"))).alias("stored"))
    names = list(terms)
    if method != "poisson" and "log_umi" not in names:
        raise ValueError("an offset fit needs log_umi")

    def fit(batches):
        for whole in batches:
            step = max(1, ct.BLOCK // max(1, len(matrix)))
            for a in range(0, len(whole), step):
                b = whole.slice(a, step)
                y = np.zeros((len(b), len(matrix)))
                stored = b.column("stored")
                flat = stored.flatten()
                y[np.repeat(np.arange(len(b)), stored.value_lengths().to_numpy()), flat.field("at").to_numpy()] = flat.field("v").to_numpy()
                if method == "poisson":
                    beta, mu = cm.poisson_fits(matrix, y)
                else:
                    offset = matrix[:, names.index("log_umi")] * cm.LN10
                    b0, mu = cm.offset_fits(offset, y)
                    beta = np.zeros((len(b), len(names)))
                    beta[:, names.index("Intercept")], beta[:, names.index("log_umi")] = b0, cm.LN10
                theta = cm.theta_ml(y, mu)
                yield pa.record_batch([b.column("gene"), pa.array(theta), pa.array(list(beta), pa.list_(pa.float64()))], ["gene", "theta", "coef"])

    found = rows.mapInArrow(fit, "gene string, theta double, coef array<double>").toPandas().set_index("gene").sort_index()
    out = pd.DataFrame(np.array(found["coef"].tolist()).reshape(len(found), len(names)), index=found.index, columns=names)
    out.insert(0, "theta", found["theta"].to_numpy(float))
    valid = np.isfinite(out[names]).all(axis=1) & out["theta"].notna()
    if not valid.all():
        warnings.warn(f"{(~valid).sum()} genes without a fit are left out", stacklevel=2)
    return out[valid]


def with_suspicious(step1: pd.DataFrame, genes: pd.DataFrame) -> pd.DataFrame:
    """An infinite theta where the moments' estimate is under a thousandth of the fitted one."""
    own = genes.loc[step1.index]
    with np.errstate(all="ignore"):
        ratio = own["amean"] ** 2 / (own["variance"] - own["amean"]) / step1["theta"]
    return step1.assign(theta=np.where(np.isfinite(ratio) & (ratio < 1e-3), np.inf, step1["theta"]))


def poisson_genes(genes: pd.DataFrame, mean_cell_sum: float, terms: Sequence[str]) -> pd.DataFrame:
    """Genes without overdispersion or with a mean under 0.001, with the parameters of an offset model."""
    own = genes[(genes["variance"] - genes["amean"] <= 0) | (genes["amean"] < 1e-3)]
    out = pd.DataFrame(0.0, index=own.index, columns=["theta", *terms])
    out["theta"] = np.inf
    if "Intercept" in out:
        out["Intercept"] = np.log(np.maximum(own["amean"], 1e-9)) - math.log(max(mean_cell_sum, 1e-9))
    if "log_umi" in out:
        out["log_umi"] = cm.LN10
    return out


def dispersion_of(theta: np.ndarray, log_gmean: np.ndarray, how: str) -> np.ndarray:
    with np.errstate(all="ignore"):
        if how == "theta":
            out = np.log10(theta)
        elif how == "od_factor":
            out = np.log10(1 + 10**log_gmean / theta)
        else:
            raise ValueError(f"unknown dispersion {how}")
    return np.where(np.isfinite(theta), out, 0.0)


def before_smoothing(step1: pd.DataFrame, genes: pd.DataFrame, settings: Settings, poisson: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series, np.ndarray, float]:
    """What is smoothed: the parameters of genes that are neither outliers nor Poisson, which were outliers, their means, and the bandwidth."""
    x = genes.loc[step1.index, "log_gmean"].to_numpy(float)
    table = step1.drop(columns="theta").assign(dispersion=dispersion_of(step1["theta"].to_numpy(float), x, settings.dispersion))
    out = reduce(np.logical_or, [cm.outliers(table[c].to_numpy(float), x) for c in table])
    if settings.exclude_poisson:
        out = out | ~np.isfinite(step1["theta"].to_numpy(float))
    keep = ~out
    if settings.exclude_poisson:
        keep = keep & ~table.index.isin(poisson.index)
    return table[keep], pd.Series(out, index=step1.index), x[keep], cm.bandwidth_sj(x[keep]) * settings.bandwidth


def regularised(step1: pd.DataFrame, genes: pd.DataFrame, settings: Settings, mean_cell_sum: float, batch_means: dict[str, tuple[pd.Series, pd.Series]] | None = None) -> tuple[pd.DataFrame, pd.Series]:
    """Parameters of every gene: kernel regressions of the sampled genes' parameters over the log geometric mean, and the outliers.

    batch_means: for each batch the log geometric means of the sampled genes in its sampled cells, and of all genes in its cells.
    """
    if batch_means:
        settings = replace(settings, exclude_poisson=False, fixed_slope=False)
    terms = [c for c in step1 if c != "theta"]
    poisson = poisson_genes(genes, mean_cell_sum, terms) if settings.exclude_poisson else pd.DataFrame(index=genes.index[:0])
    table, out, x, bw = before_smoothing(step1, genes, settings, poisson)
    at = np.clip(genes["log_gmean"].to_numpy(float), x.min(), x.max())
    fit = pd.DataFrame({c: cm.smoothed(x, table[c].to_numpy(float), at, bw) for c in ("dispersion", *(() if batch_means else terms))}, index=genes.index)
    for b, (low, all_) in (batch_means or {}).items():
        low = low.replace(-np.inf, low[np.isfinite(low)].min() if np.isfinite(low).any() else x.min())
        place = np.maximum(all_.reindex(genes.index).to_numpy(float), low.reindex(genes.index).fillna(x.min()).to_numpy(float))
        for c in terms:
            if f"{settings.batch}[{b}]" in c:
                fit[c] = cm.smoothed(low.reindex(table.index).to_numpy(float), table[c].to_numpy(float), place, bw)
    with np.errstate(all="ignore"):
        theta = 10 ** fit["dispersion"] if settings.dispersion == "theta" else 10 ** genes["log_gmean"] / (10 ** fit["dispersion"] - 1)
    fit = fit[terms].assign(theta=theta)
    if settings.exclude_poisson:
        fit.loc[poisson.index, [*terms, "theta"]] = poisson[[*terms, "theta"]]
    if settings.fixed_slope and "log_umi" in fit:
        fit["log_umi"] = cm.LN10
    return fit[["theta", *terms]], out


# Residuals


def _mu(matrix: np.ndarray, model: pd.DataFrame, terms: Sequence[str]) -> np.ndarray:
    return np.exp(matrix @ model[list(terms)].to_numpy(float).T)


def _residual(y: np.ndarray, mu: np.ndarray, theta: np.ndarray, kind: str, floor: float) -> np.ndarray:
    if kind == "deviance":
        with np.errstate(all="ignore"):
            first = np.where(y > 0, y * np.log(y / np.maximum(mu, 1e-9)), 0.0)
            second = np.where(np.isinf(theta), y - mu, (y + theta) * np.log((y + theta) / (mu + theta)))
        return np.sign(y - mu) * np.sqrt(np.maximum(2 * (first - second), 0))
    if kind != "pearson":
        raise ValueError(f"unknown residual {kind}")
    with np.errstate(all="ignore"):
        return (y - mu) / np.sqrt(np.maximum(np.where(np.isinf(theta), mu, mu + mu * mu / theta), floor))


def residuals(fit: Fit, genes: Sequence[str] | None = None, kind: str | None = None, clip: float | tuple[float, float] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """(cell, gene, r) of the genes that the model has, unclipped unless clip is given."""
    model = fit.model if genes is None else fit.model.loc[[g for g in genes if g in fit.model.index]]
    theta, terms, kind, floor = model["theta"].to_numpy(float), fit.terms, kind or fit.settings.residual, fit.min_variance
    low, high = clip if isinstance(clip, tuple) else (-clip, clip) if clip is not None else (-math.inf, math.inf)

    def block(b: pa.RecordBatch, y: np.ndarray) -> np.ndarray:
        matrix = b.column("design").flatten().to_numpy().reshape(len(b), -1)
        return np.clip(_residual(y, _mu(matrix, model, terms), theta, kind, floor), low, high)

    return ct.dense_rows(counts if counts is not None else fit.counts, fit.cells.select("cell", "design"), model.index.tolist(), block, "r")


def residual_summary(fit: Fit, kind: str | None = None, clip: float | None = None) -> pd.DataFrame:
    """residual_mean and residual_variance of each gene, without the grid: by sums over distinct designs and stored entries."""
    spark, kind, clip = fit.counts.sparkSession, kind or fit.settings.residual, fit.clip if clip is None else clip
    if kind == "none":
        return pd.DataFrame({"residual_mean": np.nan, "residual_variance": np.nan}, index=fit.model.index)
    table = F.broadcast(spark.createDataFrame([(g, float(t), [float(v) for v in row]) for g, t, row in zip(fit.model.index, fit.model["theta"], fit.model[fit.terms].to_numpy(float), strict=True)], "gene string, theta double, coef array<double>"))
    mu = F.exp(F.aggregate(F.zip_with("coef", "design", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))

    def r(y: Column) -> Column:
        v = ct.pearson_residual(y, mu, F.col("theta"), fit.min_variance) if kind == "pearson" else ct.deviance_residual(y, mu, F.col("theta"))
        return F.least(F.greatest(v, F.lit(-clip)), F.lit(clip))

    zero, stored = r(F.lit(0.0)), r(F.col("value").cast("double"))
    alike = fit.cells.groupBy("design").agg(F.count("*").alias("cells"))
    base = alike.crossJoin(table).groupBy("gene").agg(F.sum(F.col("cells") * zero).alias("s"), F.sum(F.col("cells") * zero * zero).alias("ss"))
    own = fit.counts.join(fit.cells, "cell").join(table, "gene").groupBy("gene").agg(F.sum(stored - zero).alias("ds"), F.sum(stored * stored - zero * zero).alias("dss"))
    rows = base.join(own, "gene", "left").fillna(0.0, ["ds", "dss"]).toPandas().set_index("gene").reindex(fit.model.index)
    s, ss, n = rows["s"] + rows["ds"], rows["ss"] + rows["dss"], fit.n_cells
    return pd.DataFrame({"residual_mean": s / n, "residual_variance": np.maximum((ss - s * s / n) / max(1, n - 1), 0)})


def gene_attributes(fit: Fit) -> pd.DataFrame:
    rows = fit.genes.loc[fit.model.index]
    return pd.concat([rows[["detection_rate"]], (10 ** rows["log_gmean"]).rename("gmean"), rows[["amean", "variance"]], residual_summary(fit)], axis=1)


def corrected(fit: Fit, genes: Sequence[str] | None = None, rounded: bool = True) -> DataFrame:
    """(cell, gene, value) without zeros: the count that a cell of median depth would have at the same (clipped) residual."""
    model = fit.model if genes is None else fit.model.loc[list(genes)]
    terms, theta, floor, clip = fit.terms, model["theta"].to_numpy(float), fit.min_variance, fit.clip
    (median,) = quantiles(fit.cells, "log_umi", [0.5])
    has_depth, by_batch = "log_umi" in fit.settings.latent, bool(fit.settings.batch)
    own = [i for i, t in enumerate(terms) if t.split(":")[0] == "log_umi"]

    def block(b: pa.RecordBatch, y: np.ndarray) -> np.ndarray:
        matrix = b.column("design").flatten().to_numpy().reshape(len(b), -1).copy()
        r = np.clip(_residual(y, _mu(matrix, model, terms), theta, "pearson", floor), -clip, clip)
        if has_depth:
            for i in own:
                matrix[:, i] = np.where(matrix[:, i] != 0, median, 0) if by_batch else median
        mu = _mu(matrix, model, terms)
        with np.errstate(all="ignore"):
            v = mu + r * np.sqrt(mu + np.where(np.isinf(theta), 0, mu * mu / theta))
        return np.maximum(np.rint(v) if rounded else v, 0)

    return ct.dense_rows(fit.counts, fit.cells.select("cell", "design"), model.index.tolist(), block).where("value <> 0")


# The model


def vst(counts: DataFrame, cells: DataFrame | None = None, settings: Settings | None = None, cells_step1: Sequence | None = None, genes_step1: Sequence[str] | None = None, step1: pd.DataFrame | None = None, model: pd.DataFrame | None = None, log_gmean: pd.Series | None = None) -> Fit:
    """Fits, smooths and describes a count model. step1 or model, tables of parameters by gene, stand in for the fits or for all of it."""
    if step1 is not None and model is not None:
        raise ValueError("give step1 or model, not both")
    s = with_flavour(settings or Settings())
    counts = counts.select("cell", F.col("gene").cast("string").alias("gene"), F.col("value").cast("double").alias("value")).where("value <> 0")
    covariates = cell_covariates(counts, cells, s)
    n = covariates.count()
    floor = ct.min_variance(counts, s.min_variance)
    genes = gene_table(counts, n, s)
    if log_gmean is not None:
        genes = genes[genes.index.isin(log_gmean.index)].assign(log_gmean=log_gmean)
    terms, value = design(covariates, s)
    own = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(g,) for g in genes.index], "gene string")), "gene", "left_semi")
    placed = covariates.select("cell", value.alias("design"), F.col("log_umi").cast("double").alias("log_umi"), *([F.col(s.batch).cast("string").alias("batch")] if s.batch else []), *(F.col(c).cast("double").alias(f"nonreg_{c}") for c in s.nonreg))
    out = None
    sample: list = []
    stream = generator(s)
    if model is not None:
        model = with_plain_names(model).dropna(how="all")
        genes = genes[genes.index.isin(model.index)]
        model = model.loc[genes.index]
    else:
        sample = [r["cell"] for r in placed.where(F.col("cell").isin(list(cells_step1))).select("cell").collect()] if cells_step1 is not None else sampled_cells(placed, s.n_cells, s.seed, stream)
        if not sample:
            raise ValueError("no sampled cell is among the cells")
        if step1 is None:
            chosen = _step1_genes(own, genes, sample, s, genes_step1, stream)
            rows = placed.join(F.broadcast(_frame_of(counts, sample)), "cell", "left_semi").select("cell", "design").toPandas()
            rows = rows.set_index("cell").loc[sample]
            step1 = fitted(own, chosen, sample, np.array(rows["design"].tolist()), terms, s.method)
            if s.exclude_poisson:
                step1 = with_suspicious(step1, genes)
        else:
            step1 = with_plain_names(step1)
            step1 = step1.loc[[g for g in (genes_step1 if genes_step1 is not None else step1.index) if g in step1.index and g in genes.index]]
            step1 = step1[step1["theta"].notna()]
        theta = np.maximum(step1["theta"].to_numpy(float), 1e-7)
        step1 = step1.assign(theta=np.where(np.isfinite(theta), theta, np.inf))[["theta", *terms]]
        if s.regularise:
            mean_sum = own.agg(F.sum("value")).first()[0] / n
            model, out = regularised(step1, genes, s, mean_sum, _batch_means(own, placed, genes, step1, sample, s) if s.batch else None)
            step1 = step1.assign(outlier=out)
        else:
            model = step1.reindex(genes.index)
    fit = Fit(s, model, step1, genes, placed, own, terms, n, s.clip if s.clip is not None else math.sqrt(n / 30), floor, sample)
    return _with_nonregularised(fit) if s.nonreg else fit


def _frame_of(counts: DataFrame, cells: Sequence) -> DataFrame:
    from pyspark.sql import types as T

    return counts.sparkSession.createDataFrame([(c,) for c in cells], T.StructType([T.StructField("cell", counts.schema["cell"].dataType)]))


def _step1_genes(counts: DataFrame, genes: pd.DataFrame, sample: Sequence, s: Settings, given: Sequence[str] | None, stream: RSample | None = None) -> list[str]:
    if given is not None:
        chosen = [g for g in dict.fromkeys(given) if g in genes.index]
        if not chosen:
            raise ValueError("no given gene is among the genes")
        return chosen
    seen = counts.where("value > 0").join(F.broadcast(_frame_of(counts, sample)), "cell", "left_semi").groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") >= s.min_cells)
    keep = genes.index.isin([r["gene"] for r in seen.select("gene").collect()])
    if s.exclude_poisson:
        keep = keep & (genes["variance"] - genes["amean"] > 0).to_numpy()
    return sampled_genes(genes.loc[keep, "log_gmean"], s.n_genes, s.seed, stream)


def _batch_means(counts: DataFrame, cells: DataFrame, genes: pd.DataFrame, step1: pd.DataFrame, sample: Sequence, s: Settings) -> dict[str, tuple[pd.Series, pd.Series]]:
    """Log geometric means of genes by batch, over the sampled and over all cells."""
    sampled = F.broadcast(_frame_of(counts, sample).withColumn("sampled", F.lit(1)))
    of = cells.select("cell", "batch").join(sampled, "cell", "left").withColumn("sampled", F.coalesce("sampled", F.lit(0)))
    n = {r["batch"]: (r["s"], r["n"]) for r in of.groupBy("batch").agg(F.sum("sampled").alias("s"), F.count("*").alias("n")).collect()}
    log = F.log(F.col("value") + s.gmean_eps) - math.log(s.gmean_eps)
    rows = counts.join(of, "cell").groupBy("batch", "gene").agg(F.sum(log * F.col("sampled")).alias("s"), F.sum(log).alias("a")).toPandas()  # genes times batches
    out = {}
    for b, own in rows.groupby("batch"):
        mean = {k: np.log10(np.maximum(np.exp(own.set_index("gene")[k].reindex(genes.index).fillna(0.0) / max(1, m) + math.log(s.gmean_eps)) - s.gmean_eps, 1e-9)) for k, m in zip("sa", n[b], strict=True)}
        out[b] = (mean["s"].reindex(step1.index), mean["a"])
    return out


def _with_nonregularised(fit: Fit) -> Fit:
    """Adds an intercept and coefficients of the covariates that aren't smoothed, each gene fitted with its own mean as offset."""
    s, terms, model = fit.settings, fit.terms, fit.model
    extra = list(s.nonreg)
    cells = fit.cells
    index = pd.Series(np.arange(len(model)), index=model.index)
    every = cells.count()
    if every > s.n_cells:  # a bounded sample of cells, as for the other fits
        cells = cells.join(F.broadcast(_frame_of(fit.counts, fit.sample or sampled_cells(cells, s.n_cells, s.seed))), "cell", "left_semi")
    table = cells.toPandas().reset_index(drop=True)
    matrix, covariates = np.array(table["design"].tolist()), table[[f"nonreg_{c}" for c in extra]].to_numpy(float)
    place = dict(zip(table["cell"], range(len(table)), strict=True))
    full = np.column_stack([np.ones(len(table)), covariates])
    parameters = model[["theta", *terms]].to_numpy(float)

    def fit_one(key, part: pd.DataFrame) -> pd.DataFrame:
        y = np.zeros(len(matrix))
        for c, v in zip(part["cell"], part["value"], strict=True):
            if c in place:
                y[place[c]] = v
        own = parameters[index[key[0]]]
        beta = cm.negative_binomial_fit(full, y, max(own[0], 1e-7), np.log(np.maximum(np.exp(matrix @ own[1:]), 1e-9)))
        return pd.DataFrame({"gene": [key[0]], "coef": [beta.tolist()]})

    found = fit.counts.groupBy("gene").applyInPandas(fit_one, "gene string, coef array<double>").toPandas().set_index("gene")["coef"]
    names = ["nonreg:Intercept", *(f"nonreg:{c}" for c in extra)]
    coef = pd.DataFrame(np.array(found.tolist()), index=found.index, columns=names).reindex(model.index)
    wider = fit.cells.withColumn("design", F.concat("design", F.array(F.lit(1.0), *(F.col(f"nonreg_{c}") for c in extra))))
    return replace(fit, model=pd.concat([model, coef], axis=1), cells=wider, terms=[*terms, *names])


def with_plain_names(table: pd.DataFrame) -> pd.DataFrame:
    """Column names without the brackets that other tools put around an intercept."""
    return table.rename(columns=lambda c: c.strip("()") if c.startswith("(") else c)


def as_log_means(values: pd.Series) -> pd.Series:
    """Means above 5 anywhere are taken as linear, and their log10 is returned."""
    return np.log10(np.maximum(values, 1e-9)) if len(values) and values.max() > 5 else values


# Scaled data and variable genes


def variable_genes(attributes: pd.DataFrame, n: int | None = 3000, threshold: float = 1.3) -> list[str]:
    """The n genes of largest residual variance, ties by name, or all of at least the threshold."""
    v = attributes["residual_variance"].dropna()
    v = v.iloc[np.lexsort((v.index.to_numpy(str), -v.to_numpy(float)))]
    return list(v.index[:n] if n is not None else v.index[v >= threshold])


def regressed(values: DataFrame, cells: DataFrame, covariates: Sequence[str], how: str = "linear") -> DataFrame:
    """(cell, gene, value): what regressions on covariates leave of each gene. values: (cell, gene, value) for every cell and gene.

    'linear' needs sums over cells only: the normal equations are solved gene by gene from aggregates. 'poisson' and 'negbinom' are fitted gene by gene on
    all its cells and give Pearson residuals (standardised logarithms where a fit fails).
    """
    names = list(covariates)
    if missing := [c for c in names if c not in cells.columns]:
        raise ValueError(f"no covariates {missing}")
    x = F.array(F.lit(1.0), *(F.col(c).cast("double") for c in names))
    rows = values.join(cells.select("cell", x.alias("x")), "cell")
    p = len(names) + 1
    if how == "linear":
        sums = cells.select(x.alias("x")).agg(*(F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(p))).first()
        inverse = np.linalg.pinv(np.array(sums, float).reshape(p, p), hermitian=True)
        moments = rows.groupBy("gene").agg(*(F.sum(F.col("x")[i] * F.col("value")).alias(f"m{i}") for i in range(p)))
        beta = moments.select("gene", F.array(*(reduce(lambda a, b: a + b, [F.lit(float(inverse[i, j])) * F.col(f"m{j}") for j in range(p)]) for i in range(p))).alias("beta"))
        fitted_ = F.aggregate(F.zip_with("beta", "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return rows.join(F.broadcast(beta), "gene").select("cell", "gene", (F.col("value") - fitted_).alias("value"))
    if how not in ("poisson", "negbinom"):
        raise ValueError(f"unknown regression {how}")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        matrix, y = np.array(part["x"].tolist()), part["value"].to_numpy(float)
        beta, theta = (cm.poisson_fits(matrix, y[None])[0][0], math.inf) if how == "poisson" else cm.theta_of_fit(matrix, y)
        with np.errstate(all="ignore"):
            mu = np.exp(matrix @ beta)
            r = (y - mu) / np.sqrt(mu + mu * mu / theta)
        if not np.isfinite(r).all():
            log = np.log(y + 1)
            r = (log - log.mean()) / (log.std() or 1.0)
        return pd.DataFrame({"cell": part["cell"], "gene": part["gene"], "value": r})

    kind = values.schema["cell"].dataType.simpleString()
    return rows.groupBy("gene").applyInPandas(fit, f"cell {kind}, gene string, value double")


def scaled(values: DataFrame, centre: bool = True, scale: bool = False, low: float = -math.inf, high: float = math.inf) -> DataFrame:
    """(cell, gene, value) centred per gene, over its deviation (ddof 0; 1 without spread) if scale, then clipped."""
    stats = F.broadcast(values.groupBy("gene").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")))
    v = F.col("value") - (F.col("m") if centre else F.lit(0.0))
    v = v / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0) if scale else v
    return values.join(stats, "gene").select("cell", "gene", F.least(F.greatest(v, F.lit(low)), F.lit(high)).alias("value"))


@dataclass
class Assay:
    """counts and data (log1p) without zeros, scale_data of the variable (or chosen) genes; all (cell, gene, value)."""

    fit: Fit
    counts: DataFrame
    data: DataFrame
    scale_data: DataFrame
    variable: list[str]
    attributes: pd.DataFrame
    how: str


def strategy(reference: object = None, chosen: Sequence[str] | None = None, conserve_memory: bool = False) -> str:
    return "reference.model" if reference is not None else "residual.features" if chosen is not None else "conserve.memory" if conserve_memory else "default"


def sctransform(counts: DataFrame, cells: DataFrame | None = None, settings: Settings | None = None, n_top: int | None = 3000, threshold: float = 1.3, correct: bool = True, centre: bool = True, scale: bool = False, clip: tuple[float, float] | None = None, only_variable: bool = True, chosen: Sequence[str] | None = None, conserve_memory: bool = False, reference: dict | None = None, regress: Sequence[str] = (), regression: str = "linear", **given) -> Assay:
    """Model, corrected counts, log1p and scaled residuals. reference: pack() of another fit, whose parameters are used as they are.

    Residuals of genes that aren't asked for are never made, whatever conserve_memory says. given: as of vst().
    """
    how = strategy(reference, chosen, conserve_memory)
    s = settings or Settings()
    if reference is not None:
        fit = vst(counts, cells, replace(s, **reference["settings"]), model=unpack(reference))
        fit.min_variance = reference["min_variance"]
    else:
        fit = vst(counts, cells, s, **given)
    attributes = gene_attributes(fit)
    if reference is not None:
        variable = [g for g in reference["variable"] or variable_genes(attributes, n_top, threshold) if g in fit.model.index]
    else:
        variable = [g for g in chosen if g in fit.model.index] if chosen is not None else variable_genes(attributes, n_top, threshold)
    corrected_ = corrected(fit) if correct and fit.settings.residual == "pearson" else fit.counts
    genes = variable if only_variable or chosen is not None else list(fit.model.index)
    source = residuals(fit, genes, clip=fit.clip).withColumnRenamed("r", "value")
    if regress:
        if cells is None:
            raise ValueError("regressed covariates need cells")
        if regression != "linear":
            source = ct.dense_rows(fit.counts, fit.cells.select("cell"), genes, lambda b, y: y)
        source = regressed(source, cells, regress, regression)
    low, high = clip if clip is not None else (-math.sqrt(fit.n_cells / 30), math.sqrt(fit.n_cells / 30))
    return Assay(fit, corrected_, corrected_.withColumn("value", F.log1p("value")), scaled(source, centre, scale, low, high), variable, attributes, how)


def residual_clip(n_cells: int) -> tuple[float, float]:
    limit = math.sqrt(max(n_cells, 1) / 30)
    return -limit, limit


def pack(fit: Fit, variable: Sequence[str] | None = None) -> dict:
    """A fit as plain values, for another data set or a file."""
    s = fit.settings
    return {
        "formula": formula(s.latent, s.batch), "settings": {"latent": s.latent, "batch": s.batch, "residual": s.residual}, "min_variance": fit.min_variance, "clip": fit.clip,
        "columns": list(fit.model.columns), "genes": list(fit.model.index), "values": fit.model.to_numpy(float).tolist(), "variable": list(variable) if variable is not None else None,
    }


def unpack(packed: dict) -> pd.DataFrame:
    return pd.DataFrame(packed["values"], index=packed["genes"], columns=packed["columns"])


def per_batch(counts: DataFrame, cells: DataFrame, batch: str, settings: Settings | None = None, n_top: int | None = 3000, clip: tuple[float, float] | None = None, samples: dict[str, dict] | None = None, **given) -> tuple[dict[str, Assay], list[str], DataFrame]:
    """An assay for each batch, the variable genes of all, and (batch, cell, gene, value) of their scaled residuals, 0 where a batch lacks a gene.

    The genes are the union of the batches' in order of name; beyond n_top, those of largest residual variance in any batch. samples: for
    each batch cells_step1 and genes_step1. Batches are few; each runs on all executors.
    """
    labels = sorted(str(r[0]) for r in cells.select(F.col(batch).cast("string")).distinct().collect() if r[0] is not None)
    assays: dict[str, Assay] = {}
    for b in labels:
        own = cells.where(F.col(batch).cast("string") == b)
        assays[b] = sctransform(counts.join(own.select("cell"), "cell", "left_semi"), own, settings, n_top, clip=clip, **{**given, **(samples or {}).get(b, {})})
    genes = sorted({g for a in assays.values() for g in a.variable})
    if n_top is not None and len(genes) > n_top:
        best = pd.concat([a.attributes["residual_variance"] for a in assays.values()]).dropna().groupby(level=0).max()
        genes = list(best.index[np.lexsort((best.index.to_numpy(str), -best.to_numpy(float)))][:n_top])
    spark = counts.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(g,) for g in genes], "gene string"))
    parts = []
    for b, a in assays.items():
        grid = a.fit.cells.select("cell").crossJoin(wanted)
        parts.append(grid.join(a.scale_data, ["cell", "gene"], "left").select(F.lit(b).alias("batch"), "cell", "gene", F.coalesce("value", F.lit(0.0)).alias("value")))
    return assays, genes, reduce(lambda x, y: x.unionByName(y), parts)


def ranked_features(assays: dict[str, Assay]) -> DataFrame:
    """(list, rank, gene) of the batches' variable genes, from 1."""
    spark = next(iter(assays.values())).counts.sparkSession
    return spark.createDataFrame([(b, i, g) for b, a in assays.items() for i, g in enumerate(a.variable, 1)], "list string, rank int, gene string")


def largest_variance(attributes: DataFrame, n: int) -> DataFrame:
    """The n genes of largest residual variance in any batch. attributes: (batch, gene, residual_variance)."""
    best = attributes.groupBy("gene").agg(F.max("residual_variance").alias("residual_variance"))
    return best.orderBy(F.desc("residual_variance"), "gene").limit(n)


def shared_genes(models: DataFrame, n_batches: int) -> DataFrame:
    """Genes that the models (batch, gene) of all batches have."""
    return models.groupBy("gene").agg(F.countDistinct("batch").alias("batches")).where(F.col("batches") == n_batches).select("gene")


