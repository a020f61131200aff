"""Scans of model exports and of the samples and tables that a comparison reads, and the sinks of its reports.

Exports are small: a row for each gene or sampled cell. They are read on the driver through Spark's file systems.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sct
from . import files
from .readers import matrix_market

#: Files of a fitted export, and of one with the first step alone (fixed names of the format).
REQUIRED = {"r_fit": ("model_pars_fit.csv",), "r_step1": ("model_pars_step1.csv", "cells_step1.txt", "genes_step1.txt")}


@dataclass(frozen=True)
class QualityFilter:
    """Genes of min_cells cells at least, then cells of min_genes genes at least, and of max_genes at most where that is under a million."""

    min_cells: int = 100
    min_genes: int = 50
    max_genes: float = 1e9


def frame(spark: SparkSession, path: str, index: bool = True) -> pd.DataFrame | None:
    """A small CSV with its first column as index; none where there is no file."""
    if not files.exists(spark, path):
        return None
    return pd.read_csv(io.StringIO(files.text(spark, path)), index_col=0 if index else None)


def validate_export(spark: SparkSession, folder: str, backend: str) -> None:
    if backend not in REQUIRED:
        raise ValueError(f"unknown backend {backend}")
    if missing := [n for n in REQUIRED[backend] if not files.exists(spark, f"{folder}/{n}")]:
        raise FileNotFoundError(f"{folder} lacks {missing}")


def means(spark: SparkSession, path: str) -> pd.Series | None:
    """A series by gene: the column gmean, else the first."""
    table = frame(spark, path)
    if table is None:
        return None
    out = table["gmean" if "gmean" in table.columns else table.columns[0]]
    out.index = out.index.astype(str)
    return out


def load_export(spark: SparkSession, folder: str) -> dict:
    """step1 and fit parameters, sampled cells and genes, means, gene table and meta of a folder. step1 and its two lists must be there."""
    validate_export(spark, folder, "r_step1")
    model = lambda n: None if (t := frame(spark, f"{folder}/{n}")) is None else sct.with_plain_names(t)
    attributes = frame(spark, f"{folder}/gene_attr.csv")
    log = lambda s: None if s is None else sct.as_log_means(s)
    log_gmean = log(means(spark, f"{folder}/genes_log_gmean.csv"))
    if log_gmean is None and attributes is not None and "gmean" in attributes.columns:
        log_gmean = sct.as_log_means(attributes["gmean"].rename(index=str))
    genes = files.lines(spark, f"{folder}/genes_vst.txt") if files.exists(spark, f"{folder}/genes_vst.txt") else None
    return {
        "step1": model("model_pars_step1.csv"), "fit": model("model_pars_fit.csv"), "cells_step1": files.lines(spark, f"{folder}/cells_step1.txt"), "genes_step1": files.lines(spark, f"{folder}/genes_step1.txt"),
        "genes": genes if genes is not None or attributes is None else [str(g) for g in attributes.index], "log_gmean": log_gmean, "log_gmean_step1": log(means(spark, f"{folder}/genes_log_gmean_step1.csv")),
        "gene_attributes": attributes, "meta": files.json_file(spark, f"{folder}/meta.json"), "folder": folder,
    }


def export_folder(root: str, seed: int, sample: str) -> str:
    return f"{root}/seed_{seed}/{sample}"


def resolve_exports(spark: SparkSession, root: str, batches: Sequence[str], seed: int | None = None, layout: str = "auto") -> dict[str, str]:
    """The export folder of each batch: <root>/<batch>, or below a seed."""
    layout = ("rpca_benchmark" if seed is not None else "per_batch") if layout == "auto" else layout
    if layout not in ("per_batch", "rpca_benchmark"):
        raise ValueError(f"unknown layout {layout}")
    if layout == "rpca_benchmark" and seed is None:
        raise ValueError("that layout needs a seed")
    out = {b: f"{root}/{b}" if layout == "per_batch" else export_folder(root, seed, b) for b in batches}
    if missing := [p for p in out.values() if not files.exists(spark, p)]:
        raise FileNotFoundError(f"no exports in {missing}")
    return out


def step1_available(spark: SparkSession, root: str, batches: Sequence[str], seed: int) -> bool:
    return all(files.exists(spark, f"{export_folder(root, seed, b)}/{n}") for b in batches for n in REQUIRED["r_step1"])


def scale_data_available(spark: SparkSession, root: str, batches: Sequence[str], seed: int) -> bool:
    return all(files.exists(spark, f"{export_folder(root, seed, b)}/scale_data.csv") for b in batches)


def sampled_lists(spark: SparkSession, root: str, batches: Sequence[str], seed: int) -> dict[str, dict[str, list[str]]]:
    """cells_step1 and genes_step1 of each batch that has them, as sct.per_batch takes them."""
    return {b: {k: files.lines(spark, f"{at}/{k}.txt") for k in ("cells_step1", "genes_step1")} for b in batches if files.exists(spark, f"{(at := export_folder(root, seed, b))}/cells_step1.txt")}


def method_of(spark: SparkSession, method: str, root: str | None = None, seed: int | None = None, batches: Sequence[str] = (), prefer_step1: bool = False) -> str:
    """Which fits are used: the given ones, or for 'auto' the exports' first step if preferred, then own fits."""
    if method not in ("auto", "python", "r_step1", "r_fit"):
        raise ValueError(f"unknown method {method}")
    if method != "auto":
        return method
    return "r_step1" if prefer_step1 and root is not None and seed is not None and step1_available(spark, root, batches, seed) else "python"


def long_table(spark: SparkSession, path: str) -> DataFrame:
    """(cell, gene, value) of a CSV with cells as rows and genes as columns, melted on the executors."""
    wide = spark.read.option("header", True).option("inferSchema", True).csv(path)
    first = wide.columns[0]
    return wide.unpivot(first, wide.columns[1:], "gene", "value").select(F.col(first).cast("string").alias("cell"), "gene", F.col("value").cast("double").alias("value"))


def anchors_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def filtered(counts: DataFrame, params: QualityFilter = QualityFilter()) -> DataFrame:
    """counts of the genes and cells that the filter keeps: genes first."""
    genes = counts.where("value > 0").groupBy("gene").agg(F.count("*").alias("n")).where(F.col("n") >= params.min_cells).select("gene")
    kept = counts.join(F.broadcast(genes), "gene", "left_semi")  # a row for each gene
    cells = kept.where("value > 0").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= params.min_genes)
    cells = cells.where(F.col("n") <= params.max_genes) if params.max_genes < 1e6 else cells
    return kept.join(cells.select("cell"), "cell", "left_semi")


def load_sample(spark: SparkSession, folder: str, sample: str, params: QualityFilter = QualityFilter(), names: Sequence[str] | None = None) -> DataFrame:
    """(cell, gene, value) of a sample's matrix after the filter, cells named <sample>_<barcode>. names: other names of the genes, in their order in the file."""
    counts = matrix_market(spark, folder)
    if names is not None:
        old = [r["gene"] for r in files.numbered_lines(spark, f"{folder}/features.tsv").selectExpr("i", "split(line, '\\t')[1] AS gene").orderBy("i").collect()]
        if len(old) != len(names):
            raise ValueError(f"{len(names)} names for {len(old)} genes")
        counts = counts.join(F.broadcast(spark.createDataFrame(list(zip(old, names, strict=True)), "gene string, new string")), "gene").select("cell", F.col("new").alias("gene"), "value")
    return filtered(counts, params).withColumn("cell", F.concat(F.lit(f"{sample}_"), "cell"))


def merged_samples(samples: dict[str, DataFrame], allowed: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(batch, cell, gene, value) of all samples; with allow-lists only of those cells. Absent genes of a sample need no rows."""
    out = None
    for b, counts in samples.items():
        if allowed is not None:
            counts = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(c,) for c in allowed[b]], "cell string")), "cell", "left_semi")
        part = counts.select(F.lit(b).alias("batch"), "cell", "gene", "value")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_json(spark: SparkSession, payload: dict, path: str) -> None:
    """One JSON value; NaN and infinity become null."""

    def plain(v):
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return None if isinstance(v, float) and not math.isfinite(v) else v

    spark.createDataFrame([(json.dumps(plain(payload), indent=1, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def table_text(title: str, header: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """A plain table with a title, as reStructuredText list-table."""
    show = lambda v: "n/a" if v is None or (isinstance(v, float) and not math.isfinite(v)) else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f".. list-table:: {title}", "   :header-rows: 1", ""]
    for row in [header, *rows]:
        lines += [f"   {'*' if i == 0 else ' '} - {show(v)}" for i, v in enumerate(row)]
    return "\n".join(lines) + "\n"
