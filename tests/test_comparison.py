"""Model exports that the test writes, and the comparisons that read them."""

import json
import math

import numpy as np
import pandas as pd
import pytest

from glyphloom.operators import comparison as cp
from glyphloom.operators import sct
from glyphloom.sources import exports as ex
from tests.test_sources import write_matrix


@pytest.fixture(scope="module")
def counts(spark):
    r = np.random.default_rng(3)
    y = r.poisson(r.uniform(0.5, 2, (70, 1)) * r.gamma(1.5, 1.0, (1, 40)) * r.gamma(4, 0.25, (70, 40)))
    return spark.createDataFrame([(f"c{i:02d}", f"g{j:02d}", float(y[i, j])) for i in range(70) for j in range(40) if y[i, j]], "cell string, gene string, value double").cache()


def write_export(folder, fit, attributes, top):
    folder.mkdir(parents=True)
    fit.step1[["theta", *fit.terms]].rename(columns={"Intercept": "(Intercept)"}).to_csv(folder / "model_pars_step1.csv")
    fit.model.to_csv(folder / "model_pars_fit.csv")
    attributes.to_csv(folder / "gene_attr.csv")
    (folder / "cells_step1.txt").write_text("\n".join(fit.sample) + "\n")
    (folder / "genes_step1.txt").write_text("\n".join(fit.step1.index) + "\n")
    (folder / "top_genes.txt").write_text("\n".join(top))
    (folder / "meta.json").write_text(json.dumps({"bw_adjust": 3}))


def test_suite_on_own_exports(spark, counts, tmp_path):
    fit = sct.vst(counts, settings=sct.Settings(flavour="v2"))
    about = sct.gene_attributes(fit)
    for seed in (1, 2):
        write_export(tmp_path / f"seed_{seed}" / "s", fit, about, sct.variable_genes(about, 10 - seed))
    at = ex.export_folder(str(tmp_path), 1, "s")
    export = ex.load_export(spark, at)
    assert list(export["step1"].columns) == ["theta", "Intercept", "log_umi"] and export["meta"] == {"bw_adjust": 3} and export["genes"] == list(about.index)
    assert np.allclose(export["log_gmean"], np.log10(np.maximum(about["gmean"], 1e-9))) or about["gmean"].max() <= 5
    result = cp.suite(spark, str(tmp_path), [1, 2, 3], ["s"], 1, lambda s: counts, n=9)
    assert result["status"] == "partial" and result["missing"] == [ex.export_folder(str(tmp_path), 3, "s")]
    assert result["stepwise"]["s"]["step1"]["jaccard"] > 0.7 and math.isclose(result["stepwise"]["s"]["fit"]["jaccard"], 1) and result["stepwise"]["s"]["sample"]["theta"]["corr"] > 0.99
    assert result["seeds"]["s"]["between_seeds"]["n"] == 1
    cp.write_report(spark, result, str(tmp_path / "report"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "report/table.rst"), wholetext=True).collect())
    assert ".. list-table:: Stages" in text and "1.0000" in text
    assert json.loads(spark.read.text(str(tmp_path / "report/results.json"), wholetext=True).first().value)["status"] == "partial"
    assert ex.resolve_exports(spark, str(tmp_path), ["s"], 1) == {"s": at} and ex.step1_available(spark, str(tmp_path), ["s"], 1) and not ex.scale_data_available(spark, str(tmp_path), ["s"], 1)
    assert ex.method_of(spark, "auto") == "python" and ex.method_of(spark, "auto", str(tmp_path), 1, ["s"], True) == "r_step1"
    assert set(ex.sampled_lists(spark, str(tmp_path), ["s", "t"], 1)) == {"s"}
    for bad in (lambda: ex.load_export(spark, str(tmp_path)), lambda: ex.resolve_exports(spark, str(tmp_path), ["t"], 1)):
        with pytest.raises(FileNotFoundError):
            bad()
    with pytest.raises(ValueError):
        ex.validate_export(spark, at, "other")


def test_samples(spark, tmp_path):
    write_matrix(tmp_path / "m", [(1, 1, 5), (1, 2, 1), (2, 1, 3), (2, 2, 0), (3, 3, 2)], ["g1", "g2", "g3"], ["a", "b", "c"])
    keep = ex.QualityFilter(min_cells=1, min_genes=2)
    got = ex.load_sample(spark, str(tmp_path / "m"), "s", keep, ["n1", "n2", "n3"])
    assert {tuple(r) for r in got.collect()} == {("s_a", "n1", 5), ("s_a", "n2", 3)}
    both = ex.merged_samples({"s": got, "t": ex.load_sample(spark, str(tmp_path / "m"), "t", ex.QualityFilter(1, 1))}, {"s": ["s_a"], "t": ["t_c"]})
    assert {tuple(r) for r in both.collect()} == {("s", "s_a", "n1", 5), ("s", "s_a", "n2", 3), ("t", "t_c", "g3", 2)}
    with pytest.raises(ValueError):
        ex.load_sample(spark, str(tmp_path / "m"), "s", keep, ["n1"])
    pd.DataFrame({"g1": [1.0, 2.0], "g2": [0.0, 3.0]}, index=["a", "b"]).to_csv(tmp_path / "x.csv")
    assert ex.long_table(spark, str(tmp_path / "x.csv")).count() == 4


def test_integration_steps(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 6)) + np.repeat([[0.0], [1.0]], 20, 0)
    rows = spark.createDataFrame([("ab"[i // 20], f"c{i:02d}", x[i].tolist()) for i in range(40)], "batch string, cell string, v array<double>")
    names = [f"g{k}" for k in range(6)]
    own, anchors, _ = cp.it.integrate(rows, dims=4, k_score=8, k_weight=10)
    theirs = {"features": spark.createDataFrame([(n,) for n in names[:5]], "gene string"), "prepared": cp.long_values(rows, names), "integrated": cp.long_values(own, names), "anchors": anchors}
    out = cp.integration_steps(rows, theirs, names, names, dims=4, k_score=8, k_weight=10)
    assert math.isclose(out["features"], 5 / 6) and math.isclose(out["prepared"]["median"], 1) and out["anchors"]["jaccard"] == 1 and math.isclose(out["integrated"]["mean"], 1)
