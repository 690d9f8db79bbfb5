"""Every query with SQL gives the SQL's rows; every other one runs."""

import glob
import math
import os

import duckdb
import pytest

from loamworks.plans import catalog


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v if isinstance(v, (int, bool, str)) else str(v)


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, small, tables, name):
    got = catalog.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    want = tables.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    assert columns == sorted(names)
    a = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    assert catalog.flagship(spark, small).count() > 0


def test_every_page_has_its_summary(spark, small):
    """The query gives a row for each page; long cards end in dots and pages without cards say so."""
    pages = spark.read.parquet(f"{small}/scraping_result.parquet").count()
    got = catalog.QUERIES["html_summary"](spark, small).collect()
    assert len(got) == pages > 0 and all(r["summary"].startswith("Founded in the year ") for r in got)
    long = "<h2>About us</h2><p>" + " ".join(f"word{i}" for i in range(30)) + "</p>"
    rows = [("a", f"<html><body>{long}</body></html>"), ("b", "<html><body></body></html>")]
    out = {r["url"]: r["summary"] for r in catalog.html.extract(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert out == {"a": " ".join(f"word{i}" for i in range(25)) + "...", "b": catalog.html.NO_CARDS}
