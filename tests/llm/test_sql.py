"""Queries of the training-data operators against their registered SQL."""

import duckdb
import pytest

from glyphloom.llm import queries

DATA = "/root/testdata/sf0.01"


def rows(frame):
    return sorted(tuple("-" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
