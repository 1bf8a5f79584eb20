"""Every core query with SQL against DuckDB on the smallest tables, where they are there."""

import glob
import os

import duckdb
import pytest

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def _cell(v):
    if v is None or str(v) in ("nan", "NaT", "<NA>", "None"):
        return None
    if isinstance(v, bool):
        return str(v)
    try:
        return round(float(v), 4)
    except (TypeError, ValueError):
        return str(v)


def same(spark, f, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    a, b = f(spark, DIR).toPandas(), con.execute(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda d: sorted((tuple(map(_cell, r)) for r in d[cols].astype(object).itertuples(index=False, name=None)), key=repr)
    assert rows(a) == rows(b)


def core():
    from wordloom.plans import corpus, general, more

    return [(n, c) for c in (general.catalog, corpus.catalog, more.catalog) for n in c.queries]


@pytest.mark.parametrize("name,catalog", core(), ids=[n for n, _ in core()])
def test_query(spark, name, catalog):
    if name in catalog.sql:
        same(spark, catalog.queries[name], catalog.sql[name])
    else:
        catalog.queries[name](spark, DIR).toPandas()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
