"""Count models: numerics against plain loops, plans against numpy on dense matrices."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphloom.functions import countmodel as cm
from glyphloom.operators import counts as ct
from glyphloom.operators import sct


def test_digamma_and_trigamma():
    assert math.isclose(cm.digamma(np.array([1.0]))[0], -0.5772156649015329, rel_tol=1e-12) and math.isclose(cm.trigamma(np.array([1.0]))[0], math.pi**2 / 6, rel_tol=1e-12)
    x = np.array([1e-3, 0.3, 2.5, 7.9, 8.1, 120.0])
    assert np.allclose(cm.digamma(x + 1) - cm.digamma(x), 1 / x, rtol=1e-12) and np.allclose(cm.trigamma(x) - cm.trigamma(x + 1), 1 / x**2, rtol=1e-10)


def likelihood(y, mu, t):
    return sum(math.lgamma(t + a) - math.lgamma(t) - math.lgamma(a + 1) + t * math.log(t / (t + m)) + a * math.log(m / (t + m)) for a, m in zip(y, mu, strict=True))


def test_theta_is_the_most_likely():
    r = np.random.default_rng(1)
    mu = r.uniform(2, 9, (3, 400))
    y = r.poisson(mu * r.gamma(2.0, 0.5, mu.shape)).astype(float)
    for i, t in enumerate(cm.theta_ml(y, mu)):
        best = likelihood(y[i], mu[i], t)
        assert best >= likelihood(y[i], mu[i], t * 1.02) and best >= likelihood(y[i], mu[i], t / 1.02)


def test_fits_solve_their_equations():
    r = np.random.default_rng(2)
    x = np.column_stack([np.ones(300), r.normal(3, 0.3, 300)])
    y = r.poisson(np.exp(x @ [-2.0, 1.1]), (4, 300)).astype(float)
    beta, mu = cm.poisson_fits(x, y)
    assert np.allclose((y - mu) @ x, 0, atol=1e-6) and np.allclose(beta.mean(0), [-2, 1.1], atol=0.3)
    offset = x[:, 1] * cm.LN10
    b, mu = cm.offset_fits(offset, y)
    assert np.allclose(((y - mu) / (1 + mu)).sum(1), 0, atol=1e-6) and np.allclose(mu, np.exp(b[:, None] + offset))
    beta = cm.negative_binomial_fit(x, y[0], 3.0)
    m = np.exp(x @ beta)
    assert np.allclose(x.T @ ((y[0] - m) / (1 + m / 3)), 0, atol=1e-5)


def test_pairs_and_bandwidth():
    x = np.random.default_rng(3).normal(size=400)
    width, pairs = cm.pair_distances(x, 100)
    cell = [int(v / width) for v in x]
    count = np.zeros(len(pairs))
    for i in range(400):
        for j in range(i):
            count[abs(cell[i] - cell[j])] += 1
    assert (pairs == count).all()
    assert 0.2 < cm.bandwidth_sj(x) < 0.45 and cm.bandwidth_sj(np.ones(9)) == 0.5
    both = np.concatenate([x * 0.1, 5 + x * 0.1])
    assert cm.bandwidth_sj(both) < 0.1 < cm.bandwidth_nrd(both)


def test_density_against_the_sum_of_kernels():
    x = np.random.default_rng(4).gamma(2, 1, 500)
    at, h = np.linspace(0.2, 6, 25), 0.4
    want = [np.exp(-0.5 * ((a - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi)) for a in at]
    assert np.allclose(cm.density(x, at, h), want, rtol=1e-2, atol=1e-4)


@pytest.mark.parametrize("kernel", ["normal", "box"])
def test_smoothing_against_loops(kernel):
    r = np.random.default_rng(5)
    x, at = r.uniform(0, 9, 70), r.uniform(-2, 11, 40)
    y = np.sin(x)
    x[3], bw = np.nan, 1.3
    want = []
    for a in at:
        num = den = 0.0
        for u, v in zip(x, y, strict=True):
            s = bw * 0.3706506
            if kernel == "normal" and abs(u - a) <= 4 * s:
                w = math.exp(-0.5 * ((u - a) / s) ** 2)
            else:
                w = float(kernel == "box" and abs(u - a) <= bw / 2)
            if w:
                num, den = num + w * v, den + w
        want.append(num / den if den else 0.0)
    assert np.allclose(cm.smoothed(x, y, at, bw, kernel), want, rtol=1e-12, atol=1e-13)


def test_outliers():
    r = np.random.default_rng(6)
    x = r.uniform(0, 3, 300)
    y = r.normal(size=300)
    y[[5, 77]] = [60, -60]
    assert set(np.flatnonzero(cm.outliers(y, x))) == {5, 77} and not cm.outliers(y, np.ones(300)).any()
    s = cm.robust_scale_binned(y, x, np.array([0, 1, 2.0]))
    own = (x > 0) & (x <= 1)
    assert np.allclose(s[own], (y[own] - np.median(y[own])) / (1.4826 * np.median(np.abs(y[own] - np.median(y[own])))), rtol=1e-6) and (s[x > 2] == 0).all()


@pytest.fixture(scope="module")
def matrix():
    r = np.random.default_rng(7)
    depth, rate = r.uniform(0.5, 2, (90, 1)), r.gamma(1.0, 1.2, (1, 60)) + 0.2
    y = r.poisson(depth * rate * r.gamma(4, 0.25, (90, 60))).astype(float)
    y[:, 3] = 0
    return y


@pytest.fixture(scope="module")
def long(spark, matrix):
    rows = [(f"c{i:02d}", f"g{j:02d}", float(matrix[i, j])) for i, j in zip(*np.nonzero(matrix), strict=True)]
    return spark.createDataFrame(rows, "cell string, gene string, value double").repartition(3).cache()


def wide(df, name="value"):
    t = df.toPandas()
    return t.pivot(index="cell", columns="gene", values=name).fillna(0.0)


@pytest.mark.parametrize("flavour,method", [(None, "poisson"), ("v2", "offset")])
def test_vst_against_dense_numpy(spark, matrix, long, flavour, method):
    fit = sct.vst(long, settings=sct.Settings(flavour=flavour, min_cells=3, n_genes=40))
    s = fit.settings
    assert s.method == method and "g03" not in fit.model.index and len(fit.step1) <= 40 and np.isfinite(fit.model[fit.terms]).all(axis=None)
    cols = [int(g[1:]) for g in fit.model.index]
    umi = matrix.sum(1)
    x = np.column_stack([np.ones(90), np.log10(umi + 1e-9)])
    mu = np.exp(x @ fit.model[fit.terms].to_numpy().T)
    theta = fit.model["theta"].to_numpy()
    floor = (np.median(matrix[matrix > 0]) / 5) ** 2 if flavour else -np.inf
    r = np.clip((matrix[:, cols] - mu) / np.sqrt(np.maximum(mu + mu**2 / theta, floor)), -math.sqrt(3), math.sqrt(3))
    got = wide(sct.residuals(fit, clip=fit.clip), "r")
    assert np.allclose(got.to_numpy(), r, atol=1e-9) and list(got.columns) == list(fit.model.index)
    about = sct.gene_attributes(fit)
    assert np.allclose(about["residual_variance"], r.var(0, ddof=1), atol=1e-9) and np.allclose(about["residual_mean"], r.mean(0), atol=1e-9)
    assert np.allclose(about["variance"], matrix[:, cols].var(0), atol=1e-9) and np.allclose(about["gmean"], np.exp(np.log1p(matrix[:, cols]).mean(0)) - 1, atol=1e-8)
    at = np.exp(np.column_stack([np.ones(90), np.full(90, np.median(x[:, 1]))]) @ fit.model[fit.terms].to_numpy().T)
    want = np.maximum(np.rint(at + r * np.sqrt(at + at**2 / theta)), 0)
    fixed = wide(sct.corrected(fit)).reindex(index=got.index, columns=got.columns).fillna(0.0)
    assert np.allclose(fixed.to_numpy(), want)
    if flavour:
        assert (fit.model["log_umi"] == cm.LN10).all()


def test_step1_fits_and_smoothing(spark, matrix, long):
    fit = sct.vst(long, settings=sct.Settings(min_cells=3))
    umi = matrix.sum(1)
    x = np.column_stack([np.ones(90), np.log10(umi + 1e-9)])
    for g in list(fit.step1.index)[::7]:
        beta, mu = cm.poisson_fits(x, matrix[:, int(g[1:])][None])
        assert np.allclose(fit.step1.loc[g, fit.terms].to_numpy(float), beta[0], atol=1e-6)
    keep = ~fit.step1["outlier"].to_numpy(bool)
    means = fit.genes["log_gmean"]
    low = means[fit.step1.index][keep].to_numpy()
    bw = cm.bandwidth_sj(low) * 3
    want = cm.smoothed(low, fit.step1["Intercept"].to_numpy()[keep], np.clip(means.to_numpy(), low.min(), low.max()), bw)
    assert np.allclose(fit.model["Intercept"], want)


def test_given_samples_and_parameters(spark, long):
    cells, genes = [f"c{i:02d}" for i in range(40)], [f"g{j:02d}" for j in range(30)]
    s = sct.Settings(min_cells=3, seed=1)
    a = sct.vst(long, settings=s, cells_step1=cells, genes_step1=genes)
    b = sct.vst(long.repartition(5), settings=sct.Settings(min_cells=3, seed=2), cells_step1=cells, genes_step1=genes)
    assert np.allclose(a.model, b.model) and set(a.step1.index) <= set(genes)
    c = sct.vst(long, settings=s, cells_step1=cells, step1=a.step1[["theta", *a.terms]].rename(columns={"Intercept": "(Intercept)"}))
    assert np.allclose(c.model, a.model[c.model.columns])
    again = sct.sctransform(long, settings=s, reference=sct.pack(a, ["g01", "g02"]))
    assert again.variable == ["g01", "g02"] and again.how == "reference.model" and np.allclose(again.fit.model[a.model.columns], a.model)
    drawn = sct.vst(long, settings=sct.Settings(min_cells=3, n_cells=30, n_genes=20, draws="r", seed=42))
    assert len(drawn.sample) == 30 and len(drawn.step1) <= 20 and drawn.sample == sct.sampled_cells(drawn.cells, 30, 42, sct.generator(drawn.settings))
    with pytest.raises(ValueError):
        sct.vst(long, settings=s, step1=a.step1, model=a.model)
    with pytest.raises(ValueError, match="flavour"):
        sct.with_flavour(sct.Settings(flavour="v9"))
    with pytest.raises(ValueError, match="covariates"):
        sct.vst(long, settings=sct.Settings(latent=("depth",)))


def test_assay_and_batches(spark, matrix, long):
    cells = spark.createDataFrame([(f"c{i:02d}", "ab"[i % 2], float(i)) for i in range(90)], "cell string, batch string, age double")
    s = sct.Settings(min_cells=3)
    a = sct.sctransform(long, cells, s, n_top=12, clip=(-9.0, 9.0), regress=["age"])
    scale = wide(a.scale_data)
    assert len(a.variable) == 12 and set(scale.columns) == set(a.variable)
    r = wide(sct.residuals(a.fit, a.variable, clip=a.fit.clip), "r")
    age = np.column_stack([np.ones(90), np.arange(90.0)])
    left = r.to_numpy() - age @ np.linalg.lstsq(age, r.to_numpy(), rcond=None)[0]
    assert np.allclose(scale.to_numpy(), np.clip(left - left.mean(0), -9, 9), atol=1e-8)
    assert np.allclose(wide(a.data).to_numpy(), np.log1p(wide(a.counts).to_numpy()))
    assays, genes, rows = sct.per_batch(long, cells, "batch", s, n_top=10)
    assert set(assays) == {"a", "b"} and len(genes) == 10 and rows.count() == 90 * 10
    best = pd.concat([x.attributes["residual_variance"] for x in assays.values()]).groupby(level=0).max().sort_values(ascending=False)
    assert set(genes) == set(best.index[:10]) or len({g for x in assays.values() for g in x.variable}) <= 10


def test_batches_in_the_formula_and_unsmoothed_covariates(spark, matrix, long):
    cells = spark.createDataFrame([(f"c{i:02d}", "ab"[i % 2], float(i % 7)) for i in range(90)], "cell string, batch string, age double")
    fit = sct.vst(long, cells, sct.Settings(min_cells=3, batch="batch"))
    assert fit.terms == ["batch[a]", "log_umi:batch[a]", "batch[b]", "log_umi:batch[b]"] and np.isfinite(fit.model[fit.terms]).all(axis=None)
    assert sct.formula(("log_umi",), "batch") == "y ~ (log_umi):batch + batch - 1"
    fit = sct.vst(long, cells, sct.Settings(min_cells=3, nonreg=("age",)))
    assert fit.terms[-2:] == ["nonreg:Intercept", "nonreg:age"] and sct.residuals(fit, ["g05"]).count() == 90


@pytest.mark.parametrize("how", ["poisson", "negbinom"])
def test_regressions_of_counts(spark, matrix, how):
    cells = spark.createDataFrame([(i, float(i)) for i in range(90)], "cell int, age double")
    values = spark.createDataFrame([(i, f"g{j}", float(matrix[i, j])) for i in range(90) for j in range(3)], "cell int, gene string, value double")
    got = wide(sct.regressed(values, cells, ["age"], how)).to_numpy()
    x = np.column_stack([np.ones(90), np.arange(90.0)])
    for j in range(3):
        beta, theta = (cm.poisson_fits(x, matrix[:, j][None])[0][0], math.inf) if how == "poisson" else cm.theta_of_fit(x, matrix[:, j])
        mu = np.exp(x @ beta)
        assert np.allclose(got[:, j], (matrix[:, j] - mu) / np.sqrt(mu + mu**2 / theta), atol=1e-7)


def test_deviance_residuals(spark, long, matrix):
    fit = sct.vst(long, settings=sct.Settings(min_cells=3, residual="deviance"))
    r = sct.residuals(fit, ["g05"], clip=fit.clip).toPandas()["r"]
    about = sct.residual_summary(fit)
    assert math.isclose(r.var(ddof=1), about.loc["g05", "residual_variance"], rel_tol=1e-9)


def test_zero_aware_scaling(spark, matrix, long):
    cells = spark.createDataFrame([(f"c{i:02d}",) for i in range(90)], "cell string")
    keep = [j for j in range(60) if matrix[:, j].any()]
    m = matrix[:, keep]
    sd = m.std(0, ddof=1)
    assert np.allclose(wide(ct.scaled_dense(long, cells)).to_numpy(), np.clip((m - m.mean(0)) / sd, -10, 10), atol=1e-9)
    assert np.allclose(wide(ct.scaled(long, 90)).to_numpy(), np.minimum(m / sd, 10), atol=1e-9)
    low, high = np.percentile(m, [2, 98], axis=0)
    want = np.where(high > low, (np.clip(m, low, high) - low) / np.where(high > low, high - low, 1), 0)
    t = ct.percentile_scaled(long, 90, 0.02, 0.98)
    zero = dict(t.select("gene", "zero").distinct().collect())
    got = wide(t)
    got = got.where(wide(long) != 0, pd.Series(zero), axis=1)
    assert np.allclose(got.to_numpy(), want)
    assert long.count() == (matrix > 0).sum() and t.where(F.col("value").isNull()).count() == 0
