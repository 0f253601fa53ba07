"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from lorewright.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x != x:
        return None
    if isinstance(x, (bool, str)):
        return x
    try:
        return round(float(x), 6) if math.isfinite(float(x)) else str(x)
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, oracle, name):
    got, want = plans.queries()[name](spark, SF).toPandas(), oracle.sql(plans.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=str)
    assert rows(got) == rows(want) and len(got)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["graph_eigen", "graph_close", "graph_between", "graph_groups", "graph_edge_ids"])
def test_measures_see_customers(spark, name):
    out = plans.queries()[name](spark, SF)
    column = "src" if name == "graph_edge_ids" else "id"
    assert out.where(out[column].like("customer%")).count() == spark.read.parquet(f"{SF}/customer.parquet").count()
