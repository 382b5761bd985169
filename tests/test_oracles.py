"""Every registered query with an SQL equivalent, side by side on the smallest tables."""

import math
import os

import duckdb
import pytest

from evigraph.plans import catalog


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_matches_sql(spark, sf_dir, db, name):
    got = catalog.queries()[name](spark, sf_dir)
    found = db.execute(catalog.oracles()[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == want


def test_all_queries_have_sql():
    assert set(catalog.queries()) == set(catalog.oracles())
