"""Comparison of this engine's models and integrations with exported ones: each stage from the exports' inputs, then end to end."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import exports as ex
from ..sources import files
from . import integration as it
from . import relations as rl
from . import sct


def _series(spark: SparkSession, s: pd.Series) -> DataFrame:
    return spark.createDataFrame([(str(k), float(v)) for k, v in s.dropna().items()], "gene string, value double")


def _first(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict() if row else {}


def variable_jaccard(spark: SparkSession, attributes: pd.DataFrame, given: Sequence[str], n: int = 3000) -> float:
    rows = spark.createDataFrame([(str(g), float(v)) for g, v in attributes["residual_variance"].items()], "gene string, residual_variance double")
    return rl.top_jaccard(rows, spark.createDataFrame([(g,) for g in given], "gene string"), n).first()["jaccard"]


def injected(counts: DataFrame, export: dict, stage: str, settings: sct.Settings | None = None) -> sct.Fit:
    """A fit that starts from an export: its sample ('sample'), its first step ('step1') or its smoothed parameters ('fit')."""
    s = settings or sct.Settings(flavour="v2")
    if stage == "fit":
        return sct.vst(counts, settings=s, model=export["fit"], log_gmean=export["log_gmean"])
    sample = {"cells_step1": export["cells_step1"], "genes_step1": export["genes_step1"]}
    if stage == "sample":
        return sct.vst(counts, settings=s, log_gmean=export["log_gmean"], **sample)
    if stage == "step1":
        return sct.vst(counts, settings=s, step1=export["step1"], log_gmean=export["log_gmean"], **sample)
    raise ValueError(f"unknown stage {stage}")


def stepwise(counts: DataFrame, export: dict, top: Sequence[str], residuals: DataFrame | None = None, n: int = 3000) -> dict:
    """For each stage: variable genes, parameters, gene table and residuals against the export's."""
    spark, out = counts.sparkSession, {}
    for stage in ("sample", "step1", "fit"):
        if stage == "fit" and export["fit"] is None:
            continue
        fit = injected(counts, export, stage)
        about = sct.gene_attributes(fit)
        row = {"jaccard": variable_jaccard(spark, about, top, n), "genes": len(about)}
        if stage == "sample":
            row["theta"] = _first(rl.compared(_series(spark, fit.step1["theta"].replace(float("inf"), float("nan"))), _series(spark, export["step1"]["theta"].replace(float("inf"), float("nan"))), "gene", log10=True))
        if export["gene_attributes"] is not None:
            a, b = (t["residual_variance"] for t in (about, export["gene_attributes"]))
            row["variance"] = _first(rl.gene_summary_comparison(*(_series(spark, s).withColumnRenamed("value", "residual_variance") for s in (a, b))))
        if residuals is not None:
            own = sct.residuals(fit, list(top), clip=fit.clip).withColumnRenamed("r", "value")
            row["residuals"] = _first(rl.compared_matrices(own, residuals))
        out[stage] = row
    return out


def seed_spread(spark: SparkSession, lists: dict[int, Sequence[str]], own: Sequence[str], reference: int) -> dict:
    """Jaccards of the exports' variable genes between seeds, and of the own ones with the reference seed's."""
    rows = spark.createDataFrame([(str(s), g) for s, genes in lists.items() for g in genes], "list string, gene string")
    between = rl.list_jaccards(rows).select("jaccard")
    a, b = (spark.createDataFrame([(g,) for g in genes], "gene string") for genes in (own, lists[reference]))
    mine = rl.jaccard(a, b).first()["jaccard"]
    spread = _first(rl.distribution(between, "jaccard"))
    return {"between_seeds": spread, "own": mine, "within_range": bool(spread) and spread["least"] <= mine <= spread["most"], "within_quartiles": bool(spread) and spread["q25"] <= mine <= spread["q75"]}


def suite(spark: SparkSession, root: str, seeds: Sequence[int], samples: Sequence[str], reference: int, load: Callable[[str], DataFrame], n: int = 3000) -> dict:
    """stepwise() of every sample and seed with exports, and the spread over seeds; status 'partial' names what is missing."""
    steps, missing, lists = {}, [], {}
    for sample in samples:
        for seed in seeds:
            at = ex.export_folder(root, seed, sample)
            if not files.exists(spark, f"{at}/model_pars_step1.csv"):
                missing.append(at)
                continue
            export = ex.load_export(spark, at)
            top = files.lines(spark, f"{at}/top_genes.txt") if files.exists(spark, f"{at}/top_genes.txt") else sct.variable_genes(export["gene_attributes"], n)
            lists.setdefault(sample, {})[seed] = top
            if seed == reference:
                steps[sample] = stepwise(load(sample), export, top, n=n)
    spread = {}
    for sample, by_seed in lists.items():
        if reference in by_seed and len(by_seed) > 1:
            fit = sct.vst(load(sample), settings=sct.Settings(flavour="v2"))
            spread[sample] = seed_spread(spark, by_seed, sct.variable_genes(sct.gene_attributes(fit), n), reference)
    return {"status": "partial" if missing else "complete", "missing": missing, "stepwise": steps, "seeds": spread}


def integration_steps(rows: DataFrame, theirs: dict[str, DataFrame], features: Sequence[str], own_features: Sequence[str], dims: int = 30, **how) -> dict:
    """Features, prepared values, anchors and integrated values against the exports'. theirs: 'features' (gene), 'prepared' and 'integrated'
    (cell, gene, value), 'anchors' (cell1, dataset1, cell2, dataset2); rows: (batch, cell, v) over `features`."""
    spark, out = rows.sparkSession, {}
    out["features"] = rl.jaccard(spark.createDataFrame([(g,) for g in own_features], "gene string"), theirs["features"].select("gene")).first()["jaccard"]
    out["prepared"] = _first(rl.gene_correlations(long_values(rows, features), theirs["prepared"]))
    integrated, anchors, _ = it.integrate(rows, dims=dims, **how)
    out["anchors"] = _first(rl.compared_anchors(anchors.withColumn("cell1", F.col("cell1")), theirs["anchors"])) if dict(anchors.dtypes)["cell1"] == "bigint" else _first(named_anchor_comparison(anchors, theirs["anchors"]))
    out["integrated"] = _first(rl.gene_correlations(long_values(integrated, features), theirs["integrated"]))
    return out


def named_anchor_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """compared_anchors() of cells that go by names."""
    pair = lambda df, n: df.select(F.least("cell1", "cell2").alias("u"), F.greatest("cell1", "cell2").alias("v")).distinct().withColumn(n, F.lit(1))
    n = pair(a, "in_a").join(pair(b, "in_b"), ["u", "v"], "full").agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count(F.col("in_a") + F.col("in_b")).alias("shared"), F.count("*").alias("either"))
    return n.select("n_a", "n_b", "shared", F.when(F.col("either") > 0, F.col("shared") / F.col("either")).otherwise(1.0).alias("jaccard"))


def long_values(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(cell, gene, value) of vectors."""
    names = F.array(*map(F.lit, features))
    return rows.select("cell", F.posexplode("v").alias("i", "value")).select("cell", F.get(names, F.col("i")).alias("gene"), "value")


def report(result: dict) -> str:
    """The suite's figures as text tables."""
    steps = [(sample, stage, row["jaccard"], row.get("variance", {}).get("spearman"), row.get("residuals", {}).get("corr")) for sample, by in result["stepwise"].items() for stage, row in by.items()]
    seeds = [(s, r["own"], r["between_seeds"].get("median"), r["between_seeds"].get("least"), r["between_seeds"].get("most"), r["within_range"]) for s, r in result["seeds"].items()]
    return ex.table_text("Stages", ("sample", "stage", "Jaccard", "variance Spearman", "residual correlation"), steps) + "\n" + ex.table_text("Seeds", ("sample", "own", "median", "least", "most", "within"), seeds)


def write_report(spark: SparkSession, result: dict, folder: str) -> None:
    ex.write_json(spark, result, f"{folder}/results.json")
    spark.createDataFrame([(report(result),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/table.rst")
