"""Queries of the engine's own operators over the driver's tables, with DuckDB SQL where SQL can express them.

The tables stand in for spatial data: customers are cells at (c_acctbal, c_custkey), labelled by market segment; an order's
customer, a part's brand and a line's quantity are a count matrix; lines are bins at (l_partkey, l_suppkey).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import counts as ct
from ..operators import relations as rl
from ..operators import spatial as sp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COUNTS = "counts AS (SELECT o_custkey AS cell, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
CELLS = "cells AS (SELECT c_custkey AS id, c_acctbal AS x, c_custkey::DOUBLE AS y, c_mktsegment AS label, c_nationkey % 3 AS batch FROM customer)"
NEAR = "near AS (SELECT a.id AS src, b.id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS place FROM cells a JOIN cells b ON a.id <> b.id QUALIFY place <= 6)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"), F.col("c_mktsegment").alias("label"), (F.col("c_nationkey") % 3).alias("batch"))


def count_matrix(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    rows = lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("o_custkey").alias("cell"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


def bins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_returnflag").alias("gene"), F.col("l_quantity").alias("value"))


@query(f"WITH {CELLS} SELECT a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d_px, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) * 0.5 AS d_um FROM cells a CROSS JOIN cells b WHERE b.label = 'BUILDING' GROUP BY a.id")
def label_distance(spark, d):
    return sp.label_distance(cells(spark, d), "BUILDING", mpp=0.5)


@query(f"WITH {CELLS}, {NEAR} SELECT src, dst, d, place FROM near")
def knn_graph(spark, d):
    c = cells(spark, d)
    return sp.nearest(c, c, 6, exclude_self=True)


WEIGHTS = "weights AS (SELECT src, dst, d, exp(-(d / r) * (d / r)) / sum(exp(-(d / r) * (d / r))) OVER (PARTITION BY src) AS w FROM (SELECT *, coalesce(max(CASE WHEN d > 0 THEN d END) OVER (PARTITION BY src), 1) AS r FROM near))"


@query(f"WITH {CELLS}, {NEAR}, {WEIGHTS} SELECT src, dst, round(w, 9) AS w, round(1 - w, 9) AS distance FROM weights")
def spatial_weights(spark, d):
    return sp.kernel_weights(cells(spark, d), 6).select("src", "dst", F.round("w", 9).alias("w"), F.round(1 - F.col("w"), 9).alias("distance"))


@query(f"WITH {CELLS}, {NEAR}, {WEIGHTS}, t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS p FROM weights QUALIFY p <= 3) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 9) AS w FROM t")
def truncated_weights(spark, d):
    return sp.truncated(sp.kernel_weights(cells(spark, d), 6), 3).withColumn("w", F.round("w", 9))


@query(f"WITH {CELLS}, {NEAR}, {WEIGHTS}, {COUNTS} SELECT src AS cell, gene, round(sum(w * value), 6) AS value FROM weights JOIN counts ON dst = cell GROUP BY src, gene")
def neighbourhood_mean(spark, d):
    return sp.neighbourhood_mean(sp.kernel_weights(cells(spark, d), 6), count_matrix(spark, d)).withColumn("value", F.round("value", 6))


DIRECTED = "directed AS (SELECT src, dst, wc / CASE WHEN sum(abs(wc)) OVER (PARTITION BY src) > 0 THEN sum(abs(wc)) OVER (PARTITION BY src) ELSE 1 END AS w FROM (SELECT src, dst, w * cos(atan2(b.y - a.y, b.x - a.x)) AS wc FROM weights JOIN cells a ON a.id = src JOIN cells b ON b.id = dst))"


@query(f"WITH {CELLS}, {NEAR}, {WEIGHTS}, {DIRECTED}, {COUNTS} SELECT src AS cell, gene, round(sum(w * value), 6) + 0.0 AS value FROM directed JOIN counts ON dst = cell GROUP BY src, gene")
def neighbourhood_gradient(spark, d):
    c = cells(spark, d)
    edges = sp.directional_weights(sp.kernel_weights(c, 6), c)
    return sp.neighbourhood_mean(edges, count_matrix(spark, d)).withColumn("value", F.round("value", 6) + 0.0)


@query(f"WITH {CELLS}, m AS (SELECT label AS grp, avg(x) AS mx, avg(y) AS my FROM cells GROUP BY 1) SELECT grp, arg_min(id, (sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), id)) AS id, round(min(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))), 6) AS d FROM cells JOIN m ON label = grp GROUP BY grp")
def central_members(spark, d):
    return sp.central_members(cells(spark, d).withColumnRenamed("label", "grp")).select("grp", "id", F.round("d", 6).alias("d"))


EPS_PAIRS = "e AS (SELECT a.id AS u, b.id AS v FROM cells a JOIN cells b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 250.0 * 250.0), core AS (SELECT u FROM e GROUP BY u HAVING count(*) >= 4), inn AS (SELECT e.u, e.v FROM e JOIN core a ON a.u = e.u JOIN core b ON b.u = e.v), reach AS (SELECT u, u AS root FROM core UNION SELECT inn.v, reach.root FROM reach JOIN inn ON inn.u = reach.u WHERE reach.root < inn.v), own AS (SELECT u, min(root) AS cluster FROM reach GROUP BY u), border AS (SELECT e.u, min(own.cluster) AS cluster FROM e JOIN own ON own.u = e.v GROUP BY e.u), found AS (SELECT id, x, y, coalesce(own.cluster, border.cluster) AS cluster FROM cells LEFT JOIN own ON own.u = id LEFT JOIN border ON border.u = id), num AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS number FROM (SELECT DISTINCT cluster FROM found WHERE cluster IS NOT NULL)), named AS (SELECT cluster, 'S' || lpad((row_number() OVER (ORDER BY avg(y), avg(x), cluster))::VARCHAR, 3, '0') AS slice_id FROM found WHERE cluster IS NOT NULL GROUP BY cluster HAVING count(*) >= 10), sliced AS (SELECT id, x, y, coalesce(number, -1)::INT AS slice_cluster, coalesce(slice_id, 'debris') AS slice_id FROM found LEFT JOIN num USING (cluster) LEFT JOIN named USING (cluster))"


@query(f"WITH RECURSIVE {CELLS}, {EPS_PAIRS} SELECT * FROM sliced")
def slice_clusters(spark, d):
    return sp.slices(cells(spark, d), eps=250.0, min_samples=4, min_cells=10)


@query(f"WITH RECURSIVE {CELLS}, {EPS_PAIRS} SELECT slice_id, count(*) AS n, round_even(min(x), 1) AS x_min, round_even(max(x), 1) AS x_max, round_even(avg(x), 1) AS x_mean, round_even(min(y), 1) AS y_min, round_even(max(y), 1) AS y_max, round_even(avg(y), 1) AS y_mean, round_even(max(x) - min(x), 1) AS x_span, round_even(max(y) - min(y), 1) AS y_span FROM sliced WHERE slice_id <> 'debris' GROUP BY slice_id")
def slice_summary(spark, d):
    return sp.slice_summary(slice_clusters(spark, d))


@query(f"WITH RECURSIVE {CELLS}, {EPS_PAIRS} SELECT id, x, y, CASE WHEN count(*) OVER (PARTITION BY cluster) >= 40 THEN number::VARCHAR END AS colony FROM found LEFT JOIN num USING (cluster)")
def colonies(spark, d):
    return sp.colonies(cells(spark, d), 250.0, 4, 40)


@query(f"WITH {CELLS}, m AS (SELECT label, avg(x) AS mx, avg(y) AS my FROM cells GROUP BY 1), marks AS (SELECT arg_min(c.id, (sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), c.id)) AS id FROM cells c JOIN m USING (label) GROUP BY label) SELECT a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM cells a CROSS JOIN (SELECT * FROM cells JOIN marks USING (id)) b GROUP BY a.id")
def centroid_distance(spark, d):
    return sp.centroid_distance(sp.marked_centroids(cells(spark, d).select("id", "x", "y", F.col("label").alias("colony"))))


@query(f"WITH {CELLS}, {NEAR}, {WEIGHTS}, {COUNTS}, o AS (SELECT src, dst, b.x - a.x AS dx, b.y - a.y AS dy FROM weights JOIN cells a ON a.id = src JOIN cells b ON b.id = dst), s AS (SELECT src, count(*) + 1e-6 AS n, sum(dx) AS x, sum(dy) AS y, sum(dx * dx) + 1e-6 AS xx, sum(dx * dy) AS xy, sum(dy * dy) + 1e-6 AS yy FROM o GROUP BY src), t AS (SELECT src, gene, sum(value) AS t, sum(dx * value) AS tx, sum(dy * value) AS ty FROM o JOIN counts ON dst = cell GROUP BY src, gene), r AS (SELECT t.src AS cell, gene, (-(x * yy - xy * y) * t + (n * yy - y * y) * tx - (n * xy - x * y) * ty) / (n * (xx * yy - xy * xy) - x * (x * yy - xy * y) + y * (x * xy - xx * y)) AS bx, ((x * xy - xx * y) * t - (n * xy - x * y) * tx + (n * xx - x * x) * ty) / (n * (xx * yy - xy * xy) - x * (x * yy - xy * y) + y * (x * xy - xx * y)) AS by_ FROM t JOIN s USING (src)) SELECT cell, gene, round(sqrt(bx * bx + by_ * by_), 5) AS value FROM r")
def neighbourhood_slopes(spark, d):
    c = cells(spark, d)
    return sp.neighbourhood_gradient(sp.kernel_weights(c, 6), c, count_matrix(spark, d), "regression").withColumn("value", F.round("value", 5))


@query(f"WITH {CELLS} SELECT min(x) - (max(x) - min(x)) * 0.05 AS xmin, max(x) + (max(x) - min(x)) * 0.05 AS xmax, min(y) - (max(y) - min(y)) * 0.05 AS ymin, max(y) + (max(y) - min(y)) * 0.05 AS ymax FROM cells")
def data_extent(spark, d):
    return sp.data_extent(cells(spark, d))


@query("WITH g AS (SELECT median(gap) AS m FROM (SELECT x - lag(x) OVER (ORDER BY x) AS gap FROM (SELECT DISTINCT l_partkey AS x FROM lineitem)) WHERE gap > 0 UNION ALL SELECT median(gap) FROM (SELECT y - lag(y) OVER (ORDER BY y) AS gap FROM (SELECT DISTINCT l_suppkey AS y FROM lineitem)) WHERE gap > 0) SELECT min(m)::DOUBLE AS side FROM g")
def square_size(spark, d):
    return spark.createDataFrame([(sp.square_size(bins(spark, d)),)], "side double")


@query("SELECT floor(l_partkey / 16)::BIGINT AS bx, floor(l_suppkey / 16)::BIGINT AS by_, l_returnflag AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY ALL")
def rebinned(spark, d):
    return ct.rebinned(bins(spark, d), 16).withColumnRenamed("by", "by_")


@query("SELECT l_suppkey AS label, l_returnflag AS gene, sum(l_quantity) AS value FROM lineitem WHERE l_suppkey <> 0 GROUP BY ALL")
def label_counts(spark, d):
    return ct.cells_of_labels(bins(spark, d).withColumn("label", F.col("y")))


@query("SELECT l_suppkey AS label, round(avg(l_partkey), 6) AS x, avg(l_suppkey) AS y, count(*) AS bins FROM lineitem WHERE l_suppkey <> 0 GROUP BY 1")
def label_centres(spark, d):
    return ct.label_summary(bins(spark, d).withColumn("label", F.col("y"))).withColumn("x", F.round("x", 6))


@query(f"WITH {COUNTS} SELECT cell, umi, round(log10(umi + 1e-9), 9) AS log_umi, gene, round(log10(gene + 1e-9), 9) AS log_gene, round(umi / greatest(gene, 1), 9) AS umi_per_gene, round(log10(umi / greatest(gene, 1) + 1e-9), 9) AS log_umi_per_gene FROM (SELECT cell, sum(value) AS umi, count(*) FILTER (WHERE value > 0) AS gene FROM counts GROUP BY cell)")
def cell_attributes(spark, d):
    rows = ct.cell_attributes(count_matrix(spark, d))
    return rows.select(*(F.round(c, 9).alias(c) if "_" in c else F.col(c) for c in rows.columns))


N_CELLS = "(SELECT count(*) FROM customer)"


@query(f"WITH {COUNTS} SELECT gene, round(count(*) FILTER (WHERE value >= 0.01) / {N_CELLS}, 9) AS detection_rate, round(exp(sum(ln(value + 1)) / {N_CELLS}) - 1, 9) AS gmean, round(sum(value) / {N_CELLS}, 9) AS amean, round(sum(value * value) / {N_CELLS} - (sum(value) / {N_CELLS}) * (sum(value) / {N_CELLS}), 6) AS variance FROM counts GROUP BY gene")
def gene_attributes(spark, d):
    rows = ct.gene_attributes(count_matrix(spark, d), table(spark, d, "customer").count())
    return rows.select("gene", *(F.round(c, 6 if c == "variance" else 9).alias(c) for c in rows.columns[1:]))


@query(f"WITH {COUNTS} SELECT gene, count(*) AS cells FROM counts WHERE value >= 0.01 GROUP BY gene HAVING count(*) >= 50")
def detected_genes(spark, d):
    return ct.detected(count_matrix(spark, d), 50)


@query(f"WITH {COUNTS} SELECT cell, gene, round(ln(1 + value * 10000 / sum(value) OVER (PARTITION BY cell)), 9) AS value FROM counts")
def normalised_counts(spark, d):
    return ct.normalised(count_matrix(spark, d)).withColumn("value", F.round("value", 9))


@query(f"WITH {COUNTS} SELECT median(value) AS median FROM counts WHERE value <> 0")
def nonzero_median(spark, d):
    return ct.nonzero_median(count_matrix(spark, d))


MODEL = "model AS (SELECT gene, CASE WHEN var <= mean THEN 'Infinity'::DOUBLE ELSE mean * mean / (var - mean) END AS theta, ln(mean) - ln((SELECT avg(umi) FROM u)) AS intercept, ln(10) AS slope FROM (SELECT gene, sum(value) / (SELECT count(*) FROM u) AS mean, sum(value * value) / (SELECT count(*) FROM u) - (sum(value) / (SELECT count(*) FROM u)) * (sum(value) / (SELECT count(*) FROM u)) AS var FROM counts GROUP BY gene))"
RESIDUALS = f"{COUNTS}, u AS (SELECT cell, sum(value) AS umi, log10(sum(value)) AS log_umi FROM counts GROUP BY cell), {MODEL}, r AS (SELECT u.cell, m.gene, greatest(least((coalesce(value, 0) - exp(intercept + slope * log_umi)) / sqrt(CASE WHEN theta = 'Infinity'::DOUBLE THEN exp(intercept + slope * log_umi) ELSE exp(intercept + slope * log_umi) + exp(intercept + slope * log_umi) * exp(intercept + slope * log_umi) / theta END), 5), -5) AS r FROM u CROSS JOIN model m LEFT JOIN counts c ON c.cell = u.cell AND c.gene = m.gene)"


def moment_model(counts: DataFrame, cell_sums: DataFrame) -> DataFrame:
    """(gene, theta, intercept, slope) by moments; a variance within the mean makes theta infinite."""
    at = cell_sums.agg(F.count("*").alias("n"), F.avg("umi").alias("umi")).first()
    n, umi = at["n"], at["umi"]
    rows = counts.groupBy("gene").agg((F.sum("value") / n).alias("mean"), (F.sum(F.col("value") * F.col("value")) / n).alias("square"))
    var = F.col("square") - F.col("mean") * F.col("mean")
    theta = F.when(var <= F.col("mean"), float("inf")).otherwise(F.col("mean") * F.col("mean") / (var - F.col("mean")))
    return rows.select("gene", theta.alias("theta"), (F.log("mean") - F.log(F.lit(umi))).alias("intercept"), F.log(F.lit(10.0)).alias("slope"))


@query(f"WITH {RESIDUALS} SELECT cell, gene, round(r, 6) + 0.0 AS r FROM r")
def pearson_residuals(spark, d):
    counts = count_matrix(spark, d)
    sums = counts.groupBy("cell").agg(F.sum("value").alias("umi"))
    rows = ct.residuals(counts, moment_model(counts, sums), sums.select("cell", F.log10("umi").alias("log_umi")), clip=5.0)
    return rows.withColumn("r", F.round("r", 6) + 0.0)


@query(f"WITH {RESIDUALS} SELECT gene, round(var_samp(r), 6) AS residual_variance FROM r GROUP BY gene ORDER BY var_samp(r) DESC, gene LIMIT 10")
def variable_features(spark, d):
    counts = count_matrix(spark, d)
    sums = counts.groupBy("cell").agg(F.sum("value").alias("umi"))
    rows = ct.residual_moments(counts, moment_model(counts, sums), sums.select("cell", F.log10("umi").alias("log_umi")), clip=5.0)
    return ct.top_features(rows.drop("residual_mean"), 10).withColumn("residual_variance", F.round("residual_variance", 6))


MOMENTS = f"m AS (SELECT gene, sum(value) / {N_CELLS} AS mean, CASE WHEN sum(value * value) - sum(value) * sum(value) / {N_CELLS} > 0 THEN sqrt((sum(value * value) - sum(value) * sum(value) / {N_CELLS}) / ({N_CELLS} - 1)) ELSE 1 END AS sd FROM counts GROUP BY gene)"


@query(f"WITH {COUNTS}, {MOMENTS} SELECT cell, gene, round(least(value / sd, 10), 6) AS value FROM counts JOIN m USING (gene)")
def scaled_counts(spark, d):
    return ct.scaled(count_matrix(spark, d), table(spark, d, "customer").count()).withColumn("value", F.round("value", 6))


@query(f"WITH {COUNTS}, {MOMENTS} SELECT c_custkey AS cell, gene, round(greatest(least((coalesce(value, 0) - mean) / sd, 10), -10), 6) + 0.0 AS value FROM customer CROSS JOIN m LEFT JOIN counts USING (gene) WHERE false UNION ALL SELECT g.cell, g.gene, round(greatest(least((coalesce(value, 0) - mean) / sd, 10), -10), 6) + 0.0 FROM (SELECT c_custkey AS cell, m.* FROM customer CROSS JOIN m) g LEFT JOIN counts c ON c.cell = g.cell AND c.gene = g.gene")
def scaled_and_centred(spark, d):
    every = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"))
    return ct.scaled_dense(count_matrix(spark, d), every).withColumn("value", F.round("value", 6) + 0.0)


DENSE = "dense AS (SELECT c_custkey AS cell, g.gene, coalesce(c.value, 0) AS value FROM customer CROSS JOIN (SELECT DISTINCT gene FROM counts) g LEFT JOIN counts c ON c.cell = c_custkey AND c.gene = g.gene)"


@query(f"WITH {COUNTS}, {DENSE}, q AS (SELECT gene, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM dense GROUP BY gene) SELECT cell, gene, round(CASE WHEN hi > lo THEN (least(greatest(value, lo), hi) - lo) / (hi - lo) ELSE 0 END, 9) AS value, round(CASE WHEN hi > lo THEN (least(greatest(0, lo), hi) - lo) / (hi - lo) ELSE 0 END, 9) AS zero FROM counts JOIN q USING (gene)")
def percentile_scaled(spark, d):
    return ct.percentile_scaled(count_matrix(spark, d), table(spark, d, "customer").count(), 0.02, 0.98).withColumn("value", F.round("value", 9)).withColumn("zero", F.round("zero", 9))


@query(f"WITH {COUNTS}, p AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, gene) AS place FROM counts) SELECT cell, sum(value) AS total_counts, count(*) AS n_genes_by_counts, round(ln(1 + sum(value)), 9) AS log1p_total_counts, round(ln(1 + count(*)), 9) AS log1p_n_genes_by_counts, round(100 * sum(value) FILTER (WHERE place <= 5) / sum(value), 9) AS pct_counts_in_top_5_genes FROM p GROUP BY cell")
def quality_metrics(spark, d):
    rows = ct.quality_metrics(count_matrix(spark, d), (5,))
    return rows.select("cell", "total_counts", "n_genes_by_counts", *(F.round(c, 9).alias(c) for c in rows.columns[3:]))


@query(f"WITH {COUNTS} SELECT gene, count(*) AS n_cells_by_counts, sum(value) AS total_counts, round(sum(value) / {N_CELLS}, 9) AS mean_counts, round(ln(1 + sum(value)), 9) AS log1p_total_counts, round(ln(1 + sum(value) / {N_CELLS}), 9) AS log1p_mean_counts, round(100 * (1 - count(*) / {N_CELLS}), 9) AS pct_dropout_by_counts FROM counts GROUP BY gene")
def gene_quality(spark, d):
    rows = ct.gene_quality(count_matrix(spark, d), table(spark, d, "customer").count())
    return rows.select("gene", "n_cells_by_counts", "total_counts", *(F.round(c, 9).alias(c) for c in rows.columns[3:]))


LISTS = "lists AS (SELECT l_returnflag AS list, p_brand AS gene, row_number() OVER (PARTITION BY l_returnflag ORDER BY sum(l_quantity) DESC, p_brand) AS rank FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 QUALIFY rank <= 12)"


def ranked_lists(spark, d) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_returnflag").alias("list"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("s"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("s"), "gene"))).where("rank <= 12").select("list", "rank", "gene")


@query(f"WITH {LISTS} SELECT gene, count(DISTINCT list) AS lists, median(rank) AS median_rank FROM lists GROUP BY gene ORDER BY 2 DESC, 3, 1 LIMIT 8")
def integration_features(spark, d):
    return ct.integration_features(ranked_lists(spark, d), 8)


@query(f"WITH {LISTS}, a AS (SELECT gene FROM lists WHERE list = 'A'), b AS (SELECT gene FROM lists WHERE list = 'R') SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS jaccard")
def list_jaccard(spark, d):
    lists = ranked_lists(spark, d)
    return rl.jaccard(lists.where("list = 'A'").select("gene"), lists.where("list = 'R'").select("gene")).withColumnRenamed("both", "both_")


@query(f"WITH {CELLS}, ab AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS p FROM cells a JOIN cells b ON a.batch = 0 AND b.batch = 1), ba AS (SELECT a.id AS b, b.id AS a, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS p FROM cells a JOIN cells b ON a.batch = 1 AND b.batch = 0) SELECT ab.a, ab.b FROM ab JOIN ba USING (a, b) WHERE ab.p <= 5 AND ba.p <= 5")
def mutual_neighbours(spark, d):
    c = cells(spark, d)
    a, b = c.where("batch = 0"), c.where("batch = 1")
    return rl.mutual_pairs(sp.nearest(a, b, 5).select("src", "dst"), sp.nearest(b, a, 5).select("src", "dst"))


@query("WITH a AS (SELECT o_custkey % 3 AS dataset1, o_custkey % 2 + 1 AS dataset2 FROM orders WHERE o_custkey % 3 <> o_custkey % 2 + 1), n AS (SELECT c_custkey % 3 AS dataset, count(*) AS n FROM customer GROUP BY 1) SELECT least(dataset1, dataset2) AS d1, greatest(dataset1, dataset2) AS d2, count(*) / least(any_value(x.n), any_value(y.n)) AS similarity FROM a JOIN n x ON x.dataset = least(dataset1, dataset2) JOIN n y ON y.dataset = greatest(dataset1, dataset2) GROUP BY 1, 2")
def anchor_similarity(spark, d):
    o = table(spark, d, "orders")
    anchors = o.select((F.col("o_custkey") % 3).alias("dataset1"), (F.col("o_custkey") % 2 + 1).alias("dataset2")).where("dataset1 <> dataset2")
    return rl.anchor_similarity(anchors, table(spark, d, "customer").groupBy((F.col("c_custkey") % 3).alias("dataset")).agg(F.count("*").alias("n")))


@query("SELECT count(l_quantity) AS n, min(l_extendedprice) AS least, quantile_cont(l_extendedprice, 0.25) AS q25, median(l_extendedprice) AS median, round(avg(l_extendedprice), 6) AS mean, quantile_cont(l_extendedprice, 0.75) AS q75, max(l_extendedprice) AS most FROM lineitem")
def distribution(spark, d):
    return rl.distribution(table(spark, d, "lineitem"), "l_extendedprice").withColumn("mean", F.round("mean", 6))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.9) AS hi FROM orders) SELECT o_orderkey, round(least(greatest((o_totalprice - lo) / (hi - lo), 0), 1), 6) AS score FROM orders, q")
def anchor_scores(spark, d):
    return rl.normalised_scores(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("score"))).withColumn("score", F.round("score", 6))


@query("WITH a AS (SELECT o_custkey AS k, avg(o_totalprice) AS v FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer) SELECT count(*) AS n, round(corr(a.v, b.v), 9) AS corr, round(median(abs(a.v - b.v)), 6) AS median_gap, round(max(abs(a.v - b.v)), 6) AS max_gap FROM a JOIN b USING (k)")
def compared_series(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("value"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    rows = rl.compared(a, b, "k")
    return rows.select("n", F.round("corr", 9).alias("corr"), F.round("median_gap", 6).alias("median_gap"), F.round("max_gap", 6).alias("max_gap"))


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def checked_positions(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return rl.checked_left_join(c, table(spark, d, "nation"), "n_nationkey").select("c_custkey", "c_name", "n_name")


@query("SELECT c_custkey, 'cellid_' || lpad(c_custkey::VARCHAR, 9, '0') || '-1' AS cell FROM customer")
def cell_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", sc.cell_name(F.col("c_custkey")).alias("cell"))


@query("SELECT p_partkey, 2.0 * p_size * p_size AS area, p_partkey + p_size / 2 AS cx, p_size AS cy, p_partkey::DOUBLE AS xmin, p_partkey + p_size::DOUBLE AS xmax FROM part")
def polygon_measures(spark, d):
    p = table(spark, d, "part")
    ring = sc.rectangle(F.col("p_partkey"), F.lit(0), F.col("p_partkey") + F.col("p_size"), 2 * F.col("p_size"))
    rows = p.select("p_partkey", ring.alias("ring"))
    return rows.select("p_partkey", F.round(sc.signed_area(F.col("ring")), 6).alias("area"), F.round(sc.centroid(F.col("ring"))["x"], 3).alias("cx"), F.round(sc.centroid(F.col("ring"))["y"], 3).cast("int").alias("cy"), sc.bounds(F.col("ring"))["xmin"].alias("xmin"), sc.bounds(F.col("ring"))["xmax"].alias("xmax"))


@query(f"WITH {CELLS} SELECT id, CASE WHEN x > 500 AND x < 5000 AND y > 300 AND y < 900 THEN 'b' WHEN x > 0 AND x < 2000 AND y > 100 AND y < 600 THEN 'a' END AS roi FROM cells")
def region_labels(spark, d):
    """Of overlapping regions the last one wins; points on an edge are outside."""
    regions = (("a", (0, 100, 2000, 600)), ("b", (500, 300, 5000, 900)))
    label = F.lit(None).cast("string")
    for name, corners in regions:
        label = F.when(sc.inside(F.col("x"), F.col("y"), sc.rectangle(*map(F.lit, corners))), name).otherwise(label)
    return cells(spark, d).select("id", label.alias("roi"))


@query(f"WITH {CELLS} SELECT id, x, y FROM cells WHERE x BETWEEN 0 AND 3000 AND y BETWEEN 100 AND 700")
def cropped(spark, d):
    return cells(spark, d).where(F.col("x").between(0, 3000) & F.col("y").between(100, 700)).select("id", "x", "y")


@query("SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT vec_id, i - 1 AS i, round(v / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12), 6) + 0.0 AS v FROM (SELECT vec_id, embedding, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)")
def normalised_vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(sc.l2_normalised(F.col("embedding").cast("array<double>"))).alias("i", "v"))
    return rows.withColumn("v", F.round("v", 6) + 0.0)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_distance(spark, sf_dir)
