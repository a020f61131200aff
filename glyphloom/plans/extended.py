"""More queries of the engine's operators over the driver's tables, with DuckDB SQL. Embeddings stand in for cells' vectors, their labels for clusters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import cluster as cl
from ..operators import counts as ct
from ..operators import embedding as em
from ..operators import frames as fr
from ..operators import geometry as gm
from ..operators import integration as it
from ..operators import nearest as ne
from ..operators import regions as rg
from ..operators import relations as rl
from ..operators import sct
from ..operators import spatial as sp
from ..operators.ranks import numbered
from ..sources import readers
from .registry import CELLS, COUNTS, DENSE, LISTS, RESIDUALS, bins, cells, count_matrix, moment_model, query, ranked_lists, table


def umi(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell").agg(F.sum("value").alias("umi")).select("cell", "umi", F.log10("umi").alias("log_umi"))


def moment_fit(spark, d) -> sct.Fit:
    """The moments' model as a fit: residuals are clipped at 5."""
    counts = count_matrix(spark, d)
    sums = umi(counts)
    model = moment_model(counts, sums).toPandas().set_index("gene").sort_index().rename(columns={"intercept": "Intercept", "slope": "log_umi"})
    placed = sums.select("cell", F.array(F.lit(1.0), "log_umi").alias("design"), "log_umi")
    return sct.Fit(sct.Settings(), model, None, model[[]], placed, counts, ["Intercept", "log_umi"], sums.count(), 5.0, -math.inf)


# Count models


@query(f"WITH {RESIDUALS}, med AS (SELECT median(log_umi) AS m FROM u), c AS (SELECT r.cell, r.gene, exp(intercept + slope * med.m) AS mu, theta, r FROM r JOIN model USING (gene), med) SELECT cell, gene, round_even(mu + r * sqrt(CASE WHEN theta = 'Infinity'::DOUBLE THEN mu ELSE mu + mu * mu / theta END), 0) AS value FROM c WHERE round_even(mu + r * sqrt(CASE WHEN theta = 'Infinity'::DOUBLE THEN mu ELSE mu + mu * mu / theta END), 0) > 0")
def corrected_counts(spark, d):
    return sct.corrected(moment_fit(spark, d))


@query(f"WITH {RESIDUALS} SELECT gene, round(avg(r), 6) + 0.0 AS residual_mean, round(var_samp(r), 6) AS residual_variance FROM r GROUP BY gene")
def residual_moments(spark, d):
    fit = moment_fit(spark, d)
    rows = sct.residual_summary(fit).round(6).reset_index(names="gene")
    return spark.createDataFrame(rows).withColumn("residual_mean", F.col("residual_mean") + 0.0)


@query(f"WITH {RESIDUALS}, m AS (SELECT gene, avg(r) AS m, stddev_pop(r) AS s FROM r GROUP BY gene) SELECT cell, gene, round(greatest(least((r - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 2), -2), 6) + 0.0 AS value FROM r JOIN m USING (gene)")
def scaled_residuals(spark, d):
    rows = sct.residuals(moment_fit(spark, d), clip=5.0).withColumnRenamed("r", "value")
    return sct.scaled(rows, True, True, -2.0, 2.0).withColumn("value", F.round("value", 6) + 0.0)


@query(f"WITH {RESIDUALS}, x AS (SELECT r.*, log_umi FROM r JOIN u USING (cell)), f AS (SELECT gene, regr_slope(r, log_umi) AS b, regr_intercept(r, log_umi) AS a FROM x GROUP BY gene) SELECT cell, gene, round(r - a - b * log_umi, 5) + 0.0 AS value FROM x JOIN f USING (gene)")
def regressed_residuals(spark, d):
    fit = moment_fit(spark, d)
    rows = sct.residuals(fit, clip=5.0).withColumnRenamed("r", "value")
    return sct.regressed(rows, fit.cells.select("cell", "log_umi"), ["log_umi"]).withColumn("value", F.round("value", 5) + 0.0)


@query(f"WITH {COUNTS} SELECT (median(value) / 5) * (median(value) / 5) AS floor FROM counts WHERE value <> 0")
def variance_floor(spark, d):
    return spark.createDataFrame([(ct.min_variance(count_matrix(spark, d)),)], "floor double")


@query(f"WITH {COUNTS}, s AS (SELECT gene, count(*) AS n FROM counts WHERE cell % 2 = 0 AND value > 0 GROUP BY gene HAVING count(*) >= 5), m AS (SELECT gene, sum(value) / (SELECT count(*) FROM customer) AS mean, sum(value * value) / (SELECT count(*) FROM customer) AS sq FROM counts GROUP BY gene) SELECT gene FROM s JOIN m USING (gene) WHERE sq - mean * mean - mean > 0")
def step1_genes(spark, d):
    counts = count_matrix(spark, d)
    settings = sct.Settings(exclude_poisson=True, n_genes=None, min_cells=5)
    sample = [r["c_custkey"] for r in table(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey").collect()]
    genes = sct.gene_table(counts, table(spark, d, "customer").count(), sct.Settings(min_cells=1))
    return spark.createDataFrame([(g,) for g in sct._step1_genes(counts, genes, sample, settings, None)], "gene string")


@query(f"WITH {COUNTS}, b AS (SELECT cell % 3 AS batch, gene, var_samp(value) AS residual_variance FROM counts GROUP BY ALL) SELECT gene, round(max(residual_variance), 6) AS residual_variance FROM b GROUP BY gene ORDER BY max(residual_variance) DESC, gene LIMIT 7")
def largest_variance(spark, d):
    rows = count_matrix(spark, d).groupBy((F.col("cell") % 3).alias("batch"), "gene").agg(F.var_samp("value").alias("residual_variance"))
    return sct.largest_variance(rows, 7).withColumn("residual_variance", F.round("residual_variance", 6))


@query(f"WITH {COUNTS} SELECT gene FROM (SELECT DISTINCT cell % 40 AS batch, gene FROM counts) GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT cell % 40) FROM counts)")
def shared_genes(spark, d):
    rows = count_matrix(spark, d).select((F.col("cell") % 40).alias("batch"), "gene").distinct()
    return sct.shared_genes(rows, rows.select("batch").distinct().count())


# Neighbours


BATCH_NEAR = "near AS (SELECT a.id AS src, b.id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS place FROM cells a JOIN cells b ON a.id <> b.id AND a.batch = b.batch QUALIFY place <= 4)"


@query(f"WITH {CELLS}, {BATCH_NEAR} SELECT src, dst, round(exp(-(d / r) * (d / r)) / sum(exp(-(d / r) * (d / r))) OVER (PARTITION BY src), 9) AS w FROM (SELECT *, coalesce(max(CASE WHEN d > 0 THEN d END) OVER (PARTITION BY src), 1) AS r FROM near)")
def batch_weights(spark, d):
    return sp.kernel_weights(cells(spark, d), 4, "batch").select("src", "dst", F.round("w", 9).alias("w"))


VECTORS = "vectors AS (SELECT vec_id AS cell, embedding::DOUBLE[] AS v, label::VARCHAR AS cluster FROM embeddings)"
GAP = "sqrt(list_sum(list_transform(range(1, 9), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))))"


def vectors(spark, d, dims: int | None = None) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell"), (F.slice(v, 1, dims) if dims else v).alias("v"), F.col("label").cast("string").alias("cluster"))


@query(f"WITH {VECTORS} SELECT a.cell AS src, b.cell AS dst, round({GAP}, 9) AS d, row_number() OVER (PARTITION BY a.cell ORDER BY {GAP}, b.cell) AS place FROM vectors a JOIN vectors b ON a.cell <> b.cell QUALIFY place <= 3")
def vector_neighbours(spark, d):
    p = vectors(spark, d, 8).select(F.col("cell").alias("id"), F.col("v").alias("p"))
    return ne.nearest_vectors(p, p, 3, exclude_self=True).withColumn("d", F.round("d", 9))


PAIR_NEAR = f"ab AS (SELECT a.cell AS c1, b.cell AS c2, row_number() OVER (PARTITION BY a.cell ORDER BY {GAP}, b.cell) AS p FROM vectors a JOIN vectors b ON a.cell % 2 = 0 AND b.cell % 2 = 1 QUALIFY p <= 5), ba AS (SELECT a.cell AS c2, b.cell AS c1, row_number() OVER (PARTITION BY a.cell ORDER BY {GAP}, b.cell) AS p FROM vectors a JOIN vectors b ON a.cell % 2 = 1 AND b.cell % 2 = 0 QUALIFY p <= 5)"


@query(f"WITH {VECTORS}, {PAIR_NEAR} SELECT c1, c2 FROM ab JOIN ba USING (c1, c2)")
def vector_anchors(spark, d):
    v = vectors(spark, d, 8)
    a, b = v.where("cell % 2 = 0"), v.where("cell % 2 = 1")
    pairs = [x.select(F.col("cell").alias(c), F.explode("near").alias(o)) for x, c, o in ((it.neighbour_lists(a, b, 5), "c1", "c2"), (it.neighbour_lists(b, a, 5), "c2", "c1"))]
    return pairs[0].join(pairs[1], ["c1", "c2"]).select("c1", "c2")


@query(f"WITH {VECTORS}, {PAIR_NEAR}, an AS (SELECT c2, row_number() OVER (ORDER BY c1, c2) AS anchor, 0.5 AS score FROM ab JOIN ba USING (c1, c2)), t AS (SELECT DISTINCT c2 AS cell FROM an), nr AS (SELECT a.cell, b.cell AS neighbour, {GAP} AS d, row_number() OVER (PARTITION BY a.cell ORDER BY {GAP}, b.cell) AS place FROM vectors a JOIN vectors b ON a.cell % 2 = 1 AND b.cell IN (SELECT cell FROM t) QUALIFY place <= 6), m AS (SELECT nr.cell, anchor, 1 - exp(-d * score / 4) AS raw, row_number() OVER (PARTITION BY nr.cell ORDER BY place, anchor) AS nth FROM nr JOIN an ON an.c2 = neighbour QUALIFY nth <= 6) SELECT cell, anchor, round(CASE WHEN sum(raw) OVER (PARTITION BY cell) > 0 THEN raw / sum(raw) OVER (PARTITION BY cell) ELSE 0 END, 9) AS w FROM m")
def anchor_weights(spark, d):
    from pyspark.sql import Window

    v = vectors(spark, d, 8)
    anchors = vector_anchors(spark, d).select(F.row_number().over(Window.orderBy("c1", "c2")).cast("long").alias("anchor"), F.col("c2").alias("cell2"), F.lit(0.5).alias("score"))
    p = v.where("cell % 2 = 1").select(F.col("cell").alias("id"), F.col("v").alias("p"))
    targets = p.join(anchors.select(F.col("cell2").alias("id")).distinct(), "id", "left_semi")
    near = ne.nearest_vectors(p, targets, 6).select(F.col("src").alias("cell"), F.col("dst").alias("neighbour"), "d", "place")
    return it.anchor_weights(near, anchors, 6).withColumn("w", F.round("w", 9))


# Vectors


@query(f"WITH {VECTORS}, s AS (SELECT i, stddev_pop(x) AS s FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY i) SELECT cell, s.i - 1 AS i, round(v[s.i] / greatest(s, 1e-12), 6) + 0.0 AS x FROM vectors, s WHERE s.i <= 4")
def vectors_by_deviation(spark, d):
    rows = em.by_deviation(vectors(spark, d).select("cell", "v"))
    return rows.select("cell", F.posexplode(F.slice("v", 1, 4)).alias("i", "x")).withColumn("x", F.round("x", 6) + 0.0)


@query(f"WITH {VECTORS}, m AS (SELECT avg(v[1]) AS m1, avg(v[2]) AS m2 FROM vectors) SELECT cell, round((v[1] - m1) * 0.6 + (v[2] - m2) * 0.8, 9) + 0.0 AS a, round((v[1] - m1) * -0.8 + (v[2] - m2) * 0.6, 9) + 0.0 AS b FROM vectors, m")
def projected_vectors(spark, d):
    v = vectors(spark, d, 2).select("cell", "v")
    mean = v.agg(F.avg(F.col("v")[0]).alias("a"), F.avg(F.col("v")[1]).alias("b")).first()
    rows = em.Components(np.array([[0.6, -0.8], [0.8, 0.6]]), np.array([mean["a"], mean["b"]]), np.ones(2)).applied(v)
    return rows.select("cell", (F.round(F.col("v")[0], 9) + 0.0).alias("a"), (F.round(F.col("v")[1], 9) + 0.0).alias("b"))


@query(f"WITH {VECTORS} SELECT cell, round(v[1] * sqrt(0.7), 9) + 0.0 AS own, round(v[1] * sqrt(0.3), 9) + 0.0 AS context, 2 AS n FROM vectors")
def mixed_vectors(spark, d):
    v = vectors(spark, d, 1).select("cell", "v")
    return em.mixed(v, v, 0.3).select("cell", (F.round(F.col("v")[0], 9) + 0.0).alias("own"), (F.round(F.col("v")[1], 9) + 0.0).alias("context"), F.size("v").alias("n"))


@query(f"WITH {VECTORS}, s AS (SELECT a.cluster, a.cell, round(sum({GAP}), 9) AS d FROM vectors a JOIN vectors b USING (cluster) GROUP BY ALL) SELECT cluster, arg_min(cell, (d, cell)) AS cell FROM s GROUP BY cluster")
def cluster_medoids(spark, d):
    v = vectors(spark, d, 8)
    return cl.medoids(v.select("cell", "v"), v.select("cell", "cluster")).select("cluster", "cell")


@query(f"WITH {COUNTS}, {DENSE}, x AS (SELECT g.gene, g.value, c_mktsegment AS k FROM dense g JOIN customer ON c_custkey = g.cell WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2 AS rk FROM x), s AS (SELECT gene, sum(rk) FILTER (WHERE k = 'BUILDING') AS rs, count(*) FILTER (WHERE k = 'BUILDING') AS n, count(*) FILTER (WHERE k = 'MACHINERY') AS m FROM r GROUP BY gene) SELECT gene, round((rs - n * (n + m + 1) / 2) / sqrt(n * m * (n + m + 1) / 12), 6) + 0.0 AS z FROM s")
def rank_sums(spark, d):
    labels = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("cluster"))
    return cl.rank_sums(count_matrix(spark, d), labels, [("BUILDING", "MACHINERY")]).select("gene", (F.round("z", 6) + 0.0).alias("z"))


# Comparisons


@query(f"WITH {LISTS} SELECT a.list AS a, b.list AS b, count(*) FILTER (WHERE a.gene = b.gene) / (24 - count(*) FILTER (WHERE a.gene = b.gene)) AS jaccard FROM lists a JOIN lists b ON a.list < b.list GROUP BY 1, 2")
def list_jaccards(spark, d):
    return rl.list_jaccards(ranked_lists(spark, d))


ANCHORS = "SELECT o_custkey % 50 AS cell1, 'x' AS dataset1, (o_orderkey % 40) AS cell2, 'y' AS dataset2, o_orderpriority AS p FROM orders"


def anchor_table(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 50).alias("cell1"), F.lit("x").alias("dataset1"), (F.col("o_orderkey") % 40).alias("cell2"), F.lit("y").alias("dataset2"), F.col("o_orderpriority").alias("p"))


@query(f"WITH n AS ({ANCHORS}), a AS (SELECT DISTINCT cell1, cell2 FROM n WHERE p = '1-URGENT'), b AS (SELECT DISTINCT cell1, cell2 FROM n WHERE p = '5-LOW') SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, count(*) AS shared, count(*) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b) - count(*)) AS jaccard, count(*) / (SELECT count(*) FROM a) AS share_of_a, (SELECT count(*) FROM b) / (SELECT count(*) FROM a) AS ratio FROM a JOIN b USING (cell1, cell2)")
def compared_anchors(spark, d):
    n = anchor_table(spark, d)
    return rl.compared_anchors(n.where("p = '1-URGENT'"), n.where("p = '5-LOW'"))


@query(f"WITH n AS ({ANCHORS}) SELECT DISTINCT cell1 AS x, cell2 AS y FROM n")
def unordered_pairs(spark, d):
    return rl.unordered_pairs(anchor_table(spark, d)).select(F.col("u.cell").alias("x"), F.col("v.cell").alias("y"))


@query(f"WITH n AS ({ANCHORS}) SELECT cell1, dataset1, cell2, dataset2, p FROM n UNION ALL SELECT cell2, dataset2, cell1, dataset1, p FROM n")
def mirrored_anchors(spark, d):
    return rl.mirrored(anchor_table(spark, d))


@query("SELECT c_mktsegment AS batch, count(*) AS n, (sum(count(*)) OVER (ORDER BY c_mktsegment) - count(*))::BIGINT AS start FROM customer GROUP BY 1")
def batch_offsets(spark, d):
    return rl.batch_offsets(rl.batch_sizes(table(spark, d, "customer"), "c_mktsegment"))


SIZES = "s AS (SELECT * FROM (VALUES ('x', 50, 0), ('y', 40, 50)) v(batch, n, start))"


def sizes(spark) -> DataFrame:
    return spark.createDataFrame([("x", 50, 0), ("y", 40, 50)], "batch string, n long, start long")


@query(f"WITH n AS ({ANCHORS}) SELECT dataset1, dataset2, cell1, cell2 + 50 AS cell2, p FROM n")
def global_cells(spark, d):
    return rl.global_cells(anchor_table(spark, d), sizes(spark), base=0)


@query(f"WITH n AS ({ANCHORS}) SELECT dataset1, dataset2, cell1, cell2, p FROM n")
def local_cells(spark, d):
    return rl.local_cells(rl.global_cells(anchor_table(spark, d), sizes(spark), base=0), sizes(spark)).select("dataset1", "dataset2", "cell1", "cell2", "p")


@query("SELECT p_partkey, 'G' || p_partkey || '-2' AS gene FROM part WHERE p_partkey % 3 <> 0")
def aligned_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("G"), "p_partkey", F.lit("-2")).alias("gene"))
    rows = p.withColumn("gene", F.regexp_replace("gene", "-2$", ".2"))
    return rl.aligned_to(rows, p.where("p_partkey % 3 <> 0").select("gene", F.col("p_partkey").alias("ord"))).select("p_partkey", "gene")


@query(f"WITH {COUNTS}, a AS (SELECT gene, var_samp(value) AS v FROM counts WHERE cell % 2 = 0 GROUP BY 1), b AS (SELECT gene, var_samp(value) AS v FROM counts WHERE cell % 2 = 1 GROUP BY 1), j AS (SELECT gene, a.v AS va, b.v AS vb, rank() OVER (ORDER BY a.v) + (count(*) OVER (PARTITION BY a.v) - 1) / 2 AS ra, rank() OVER (ORDER BY b.v) + (count(*) OVER (PARTITION BY b.v) - 1) / 2 AS rb FROM a JOIN b USING (gene)) SELECT count(*) AS n, round(corr(va, vb), 9) AS corr, round(median(abs(va - vb)), 6) AS median_gap, round(max(abs(va - vb)), 6) AS max_gap, round(corr(ra, rb), 9) AS spearman FROM j")
def compared_genes(spark, d):
    parts = [count_matrix(spark, d).where(F.col("cell") % 2 == k).groupBy("gene").agg(F.var_samp("value").alias("residual_variance")) for k in (0, 1)]
    rows = rl.gene_summary_comparison(*parts)
    return rows.select("n", F.round("corr", 9).alias("corr"), F.round("median_gap", 6).alias("median_gap"), F.round("max_gap", 6).alias("max_gap"), F.round("spearman", 9).alias("spearman"))


@query(f"WITH {COUNTS}, j AS (SELECT value AS va, value * 2 + cell % 3 AS vb FROM counts) SELECT count(*) AS n, round(corr(va, vb), 9) AS corr, median(abs(va - vb)) AS median_gap, max(abs(va - vb)) AS max_gap FROM j")
def compared_matrices(spark, d):
    c = count_matrix(spark, d)
    return rl.compared_matrices(c, c.withColumn("value", F.col("value") * 2 + F.col("cell") % 3)).withColumn("corr", F.round("corr", 9))


@query(f"WITH {COUNTS}, g AS (SELECT DISTINCT gene FROM counts ORDER BY gene LIMIT 9), r AS (SELECT gene, corr(value, value * 2 + cell % 7) AS r, stddev_pop(value) AS a, stddev_pop(value * 2 + cell % 7) AS b FROM counts JOIN g USING (gene) GROUP BY gene) SELECT count(*) AS genes, round(median(r), 9) AS median, round(avg(r), 9) AS mean FROM r WHERE a > 0 AND b > 0")
def gene_correlations(spark, d):
    c = count_matrix(spark, d)
    rows = rl.gene_correlations(c, c.withColumn("value", F.col("value") * 2 + F.col("cell") % 7), 9)
    return rows.select("genes", F.round("median", 9).alias("median"), F.round("mean", 9).alias("mean"))


@query("WITH m AS (SELECT p_partkey AS gene, CASE WHEN p_size % 5 = 0 THEN 'Infinity'::DOUBLE ELSE p_size END AS a, CASE WHEN p_size % 3 = 0 THEN 'Infinity'::DOUBLE ELSE p_size + p_partkey % 4 END AS b FROM part) SELECT 'theta' AS parameter, count(*) FILTER (WHERE a < 'Infinity'::DOUBLE AND b < 'Infinity'::DOUBLE) AS n, count(*) FILTER (WHERE a = 'Infinity'::DOUBLE) AS inf_a, count(*) FILTER (WHERE b = 'Infinity'::DOUBLE) AS inf_b, count(*) FILTER (WHERE a = 'Infinity'::DOUBLE AND b = 'Infinity'::DOUBLE) AS inf_both FROM m")
def compared_models(spark, d):
    inf = F.lit(math.inf)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.when(F.col("p_size") % 5 == 0, inf).otherwise(F.col("p_size").cast("double")).alias("a"), F.when(F.col("p_size") % 3 == 0, inf).otherwise((F.col("p_size") + F.col("p_partkey") % 4).cast("double")).alias("b"))
    rows = rl.compared_models(p.select("gene", F.col("a").alias("theta")), p.select("gene", F.col("b").alias("theta")), ("theta",))
    return rows.select("parameter", "n", "inf_a", "inf_b", "inf_both")


# Polygons, regions, frames


def squares(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    ring = sc.rectangle(F.col("p_partkey") % 50, F.col("p_size"), F.col("p_partkey") % 50 + 3, F.col("p_size") + F.col("p_partkey") % 4)
    return p.select(F.col("p_partkey").alias("cell_id"), ring.alias("vertices"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))


SQUARES = "sq AS (SELECT p_partkey AS cell_id, p_partkey % 50 AS x0, p_size AS y0, p_partkey % 50 + 3 AS x1, p_size + p_partkey % 4 AS y1, p_brand AS brand, p_retailprice AS price FROM part)"


@query(f"WITH {SQUARES} SELECT cell_id FROM sq WHERE y1 > y0")
def drawable_cells(spark, d):
    rows, _ = gm.drawable(squares(spark, d).unionByName(spark.createDataFrame([(-1, [{"x": math.nan, "y": 0.0}], "", 0.0)], "cell_id long, vertices array<struct<x: double, y: double>>, brand string, price double")))
    return rows.select("cell_id").where("cell_id >= 0")


@query(f"WITH {SQUARES} SELECT cell_id FROM sq WHERE y1 > y0")
def simple_polygons(spark, d):
    return squares(spark, d).where(gm.simple(F.col("vertices"))).select("cell_id")


@query(f"WITH {SQUARES} SELECT cell_id, CASE WHEN x1 >= 30 AND x0 <= 40 AND y1 >= 5 AND y0 <= 20 THEN 'ROI_2' WHEN x1 >= 10 AND x0 <= 25 AND y1 >= 10 AND y0 <= 30 THEN 'ROI_1' END AS ROI FROM sq WHERE y1 > y0")
def polygon_regions(spark, d):
    regions = rg.RegionSet().add(rg.rectangle(10, 10, 25, 30)).add(rg.rectangle(40, 20, 30, 5))
    return regions.labelled(squares(spark, d).where(gm.valid_bounds(F.col("vertices")))).select("cell_id", "ROI")


@query(f"WITH {SQUARES} SELECT min(x0)::DOUBLE AS xmin, min(y0)::DOUBLE AS ymin, max(x1)::DOUBLE AS xmax, max(y1)::DOUBLE AS ymax FROM sq")
def polygon_extent(spark, d):
    return gm.total_bounds(squares(spark, d))


@query(f"WITH {SQUARES}, b AS (SELECT brand, row_number() OVER (ORDER BY length(brand), brand) - 1 AS i FROM (SELECT DISTINCT brand FROM sq)) SELECT cell_id, brand AS value, ['#000001', '#000002', '#000003'][(i % 3 + 1)::INT] AS fill FROM sq JOIN b USING (brand) WHERE y1 > y0 AND brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') AND true")
def painted_cells(spark, d):
    s = squares(spark, d).where(gm.valid_bounds(F.col("vertices")))
    names = fr.categories(s.unionByName(squares(spark, d)), "brand")
    colours = fr.legend(names, ["#000001", "#000002", "#000003"])
    rows, _, _ = fr.cell_frame(s.drop("vertices"), s.select("cell_id", "vertices"), colour="brand", groups=["Brand#11", "Brand#12", "Brand#13", "Brand#21"], palette=colours)
    return rows.select("cell_id", "value", "fill")


@query(f"WITH {CELLS}, b AS (SELECT id AS cell_id, x, y, id % 17 AS n FROM cells WHERE x BETWEEN 0 AND 5000 AND y BETWEEN 10 AND 1000) SELECT cell_id, x, y, n AS value, round((n - (SELECT min(n) FROM b)) / ((SELECT max(n) FROM b) - (SELECT min(n) FROM b)), 9) AS share FROM b")
def bin_shares(spark, d):
    obs = cells(spark, d).select(F.col("id").alias("cell_id"), "x", "y", (F.col("id") % 17).alias("n"))
    rows, _, _ = fr.bin_frame(obs, colour="n", crop=(0, 5000, 10, 1000), binsize=1.0)
    return rows.withColumn("share", F.round("share", 9))


@query(f"WITH {COUNTS}, {DENSE}, q AS (SELECT gene, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM dense GROUP BY gene), s AS (SELECT cell, gene, CASE WHEN hi > lo THEN (least(greatest(value, lo), hi) - lo) / (hi - lo) ELSE 0 END AS s FROM dense JOIN q USING (gene)), w AS (SELECT cell, sum(s) FILTER (WHERE gene = 'Brand#11') AS a, sum(s) FILTER (WHERE gene = 'Brand#12') AS b FROM s WHERE gene IN ('Brand#11', 'Brand#12') GROUP BY cell) SELECT cell, CASE WHEN a + b > 0 THEN '#' || printf('%02x%02x00', round_even(a / (a + b) * 255, 0)::INT, round_even(b / (a + b) * 255, 0)::INT) ELSE '#e0e0e0' END AS colour FROM w")
def blended_genes(spark, d):
    every = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"))
    return fr.blended(count_matrix(spark, d), every, ["Brand#11", "Brand#12"])


@query("SELECT p_partkey, p_brand AS name, printf('#%02x%02x%02x', (p_size % 256)::INT, (p_partkey % 256)::INT, 7) AS colour FROM part")
def parsed_classes(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("{'name': '"), "p_brand", F.lit("', 'color': ("), F.col("p_size") % 256, F.lit(", "), F.col("p_partkey") % 256, F.lit(", 7)}")).alias("classification"))
    c = readers.classification("classification", "string")
    rows = p.select("p_partkey", c["name"].alias("name"), c["color"].alias("rgb"))
    return rows.select("p_partkey", "name", F.format_string("#%02x%02x%02x", F.col("rgb")[0], F.col("rgb")[1], F.col("rgb")[2]).alias("colour"))


# Bins


@query("SELECT 'cellid_' || lpad((o_custkey % 7)::VARCHAR, 9, '0') || '-1' AS cell, o_orderpriority AS gene, count(*) * 2.0 AS value FROM orders WHERE o_custkey % 7 <> 0 GROUP BY o_custkey % 7, o_orderpriority")
def cells_of_bins(spark, d):
    o = table(spark, d, "orders")
    own = o.select(F.col("o_orderkey").alias("bin"), (F.col("o_custkey") % 7).cast("int").alias("label"), F.col("o_custkey").cast("double").alias("x"), F.col("o_orderkey").cast("double").alias("y"))
    _, sums = gm.cells_of_bins(own, o.select(F.col("o_orderkey").alias("bin"), F.col("o_orderpriority").alias("gene"), F.lit(2.0).alias("value")), polygons=False)
    return sums


@query("SELECT (((floor(l_partkey / 8)::BIGINT << 32) | floor(l_suppkey / 8)::BIGINT))::VARCHAR AS cell, l_returnflag AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY ALL")
def packed_bins(spark, d):
    counts, _ = readers._binned(bins(spark, d), 8, True)
    return counts


@query("WITH g AS (SELECT p_partkey AS gene, (p_partkey - 1) * 4 AS start, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 4 END AS n FROM part), e AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, o_custkey AS x FROM orders) SELECT x, o_orderkey AS y, gene::VARCHAR AS gene, 1.0 AS value FROM e JOIN g ON ord >= start AND ord < start + n")
def range_joined_entries(spark, d):
    genes = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("gene"), ((F.col("p_partkey") - 1) * 4).alias("offset"), F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(4).alias("count"))
    orders = numbered(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_orderkey")
    return readers.named_entries(orders.select("ord", F.col("o_custkey").alias("x"), F.col("o_orderkey").alias("y"), F.lit(1.0).alias("count")), genes)


@query("WITH c AS (SELECT c_custkey AS id, (c_custkey - 1) * 3 AS start, c_custkey % 4 AS n FROM customer), e AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, o_orderpriority AS gene, 2 AS count FROM orders) SELECT id, gene, sum(count)::DOUBLE AS value FROM c JOIN e ON ord >= start AND ord < start + n GROUP BY ALL")
def sliced_entries(spark, d):
    from pyspark.sql import Window

    own = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") - 1) * 3).alias("offset"), (F.col("c_custkey") % 4).alias("gene_count"))
    entries = table(spark, d, "orders").select((F.row_number().over(Window.orderBy("o_orderkey")) - 1).cast("long").alias("ord"), F.col("o_orderpriority").alias("gene"), F.lit(2).alias("count"))
    return readers.cell_entries(own, entries)


# Fits, clusters and integration: no SQL states them; tests compare them with numpy


@query()
def fitted_genes(spark, d):
    """Regularised parameters of every gene."""
    counts = count_matrix(spark, d)
    fit = sct.vst(counts.withColumn("value", F.floor("value").cast("double")))
    return spark.createDataFrame(fit.model.reset_index(names="gene"))


@query()
def spatial_clusters(spark, d):
    points = cells(spark, d).select("id", "x", "y")
    return cl.spatial_clusters(count_matrix(spark, d), points, "celltype", k_spatial=6, k_expr=10, n=5)


@query()
def integrated_vectors(spark, d):
    rows = vectors(spark, d, 16).select(F.when(F.col("cell") % 3 == 0, "a").otherwise("b").alias("batch"), "cell", "v")
    out, _, _ = it.integrate(rows, dims=6, k_score=10, k_weight=20)
    return out
