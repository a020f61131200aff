import math
import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from glyphloom.functions import scalars as sc
from glyphloom.operators import counts as ct
from glyphloom.operators import relations as rl
from glyphloom.plans import extended, registry  # noqa: F401
from glyphloom.sources import readers

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    return sorted(tuple("-" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_polygons(spark):
    ring = sc.rectangle(F.lit(0), F.lit(0), F.lit(4), F.lit(2))
    r = spark.range(1).select(sc.signed_area(ring).alias("a"), sc.centroid(ring).alias("c"), sc.wkt(ring).alias("w"), sc.parse_wkt(sc.wkt(ring)).alias("p"), sc.inside(F.lit(1.0), F.lit(1.0), ring).alias("i"), sc.inside(F.lit(0.0), F.lit(1.0), ring).alias("e")).first()
    assert (r.a, r.c.x, r.c.y, r.i, r.e) == (8, 2, 1, True, False)
    assert r.w == "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 2.0, 0.0 2.0, 0.0 0.0))" and [(p.x, p.y) for p in r.p] == [(0, 0), (4, 0), (4, 2), (0, 2)]


def test_colours(spark):
    r = spark.range(1).select(sc.rgb_to_hex(F.lit(0.0), F.lit(128 / 255), F.lit(1.0)).alias("h"), sc.hex_to_rgb(F.lit("#ff0000")).alias("c")).first()
    assert r.h == "#0080ff" and r.c == [1, 0, 0]


def test_residuals_against_scalar_formulas(spark):
    r = random.Random(3)
    data = [(float(r.randrange(9)), r.uniform(0.1, 9), r.choice([math.inf, r.uniform(0.2, 50)]), r.choice([-math.inf, 2.0])) for _ in range(60)]
    df = spark.createDataFrame(data, "y double, mu double, theta double, floor double")
    rows = df.select("*", ct.pearson_residual(F.col("y"), F.col("mu"), F.col("theta"), F.col("floor")).alias("p"), ct.deviance_residual(F.col("y"), F.col("mu"), F.col("theta")).alias("d")).collect()
    for x in rows:
        assert math.isclose(x.p, (x.y - x.mu) / math.sqrt(max(x.mu + x.mu**2 / x.theta, x.floor)), abs_tol=1e-12)
        if math.isfinite(x.theta):
            inner = (x.y * math.log(x.y / x.mu) if x.y else 0) - (x.y + x.theta) * math.log((x.y + x.theta) / (x.mu + x.theta))
            assert math.isclose(x.d, math.copysign(math.sqrt(max(2 * inner, 0)), x.y - x.mu), abs_tol=1e-9)


def test_integration_features_against_counting(spark):
    r = random.Random(4)
    lists = {i: r.sample([f"g{k:02d}" for k in range(15)], 6) for i in range(5)}
    rank = {}
    for genes in lists.values():
        for k, g in enumerate(genes, 1):
            rank.setdefault(g, []).append(k)
    want = sorted(rank, key=lambda g: (-len(rank[g]), statistics.median(rank[g]), g))[:7]
    df = spark.createDataFrame([(i, k, g) for i, genes in lists.items() for k, g in enumerate(genes, 1)], "list int, rank int, gene string")
    assert [x.gene for x in ct.integration_features(df, 7).collect()] == want


def test_checked_join_refuses(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5)], "k int, v int")
    with pytest.raises(ValueError, match="no position"):
        rl.checked_left_join(a, b, "k")
    with pytest.raises(ValueError, match="not unique"):
        rl.checked_left_join(a, b.union(b), "k")


def test_readers(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n2 3 3\n1 1 5\n2 1 1\n2 3 7\n")
    (tmp_path / "features.tsv").write_text("e1\tg1\tx\ne2\tg2\tx\n")
    (tmp_path / "barcodes.tsv").write_text("c1\nc2\nc3\n")
    assert {tuple(r) for r in readers.matrix_market(spark, str(tmp_path)).collect()} == {("c1", "g1", 5), ("c1", "g2", 1), ("c3", "g2", 7)}
    (tmp_path / "a.gem").write_text("# x\n#y\ngeneID\tx\ty\tMIDCount\ng\t1\t2\t3\n")
    assert [tuple(r) for r in readers.gene_expression_text(spark, str(tmp_path / "a.gem")).collect()] == [(1, 2, "g", 3)]
