"""Every registered query is executed; those with SQL are held against it."""

import glob
import math
import os

import duckdb
import pytest

from folioforge.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def sql(folder):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, sql, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in SQL:
        result = sql.execute(SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_filters_reach_the_scan(spark, folder):
    plan = QUERIES["pr4_section_filter"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "EqualTo(paper_id,1)" in pushed and "is_valid" in pushed
    schema = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "embedding_vector" not in schema and "text_content" not in schema
