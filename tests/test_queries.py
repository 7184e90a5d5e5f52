"""Every registered query against its SQL on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p).removesuffix('.parquet')} as select * from '{p}'")
    return con


NAMES = [n for n in entry.queries() if not (n == "pipeline" or n[:2] == "op")]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, db, name):
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    if name not in entry.oracle_sql():
        assert df.columns
        return
    rel = db.sql(entry.oracle_sql()[name])
    columns, want = rel.columns, rel.fetchall()
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    left = sorted(repr(tuple(plain(r[c]) for c in names)) for r in got)
    right = sorted(repr(tuple(plain(r[columns.index(c)]) for c in names)) for r in want)
    assert left == right


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_library_does_not_need_the_corpus_operators():
    for p in glob.glob(os.path.join(os.path.dirname(entry.__file__), "routeloom", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in p:
            text = open(p).read()
            assert "llm import" not in text and "routeloom.llm" not in text


def test_routes_of_all_depths(spark):
    """The tables of scale 0.01 have parts of depth 4 to 6."""
    from routeloom.operators import graph as G
    from routeloom.plans import bindings as B

    d = "/root/testdata/sf0.01"
    cost, _ = G.and_or_depth(B.molecules(spark, d), B.reactions(spark, d))
    depths = {str(r.mol): r.cost for r in cost.where("cost >= 1").collect()}
    assert max(depths.values()) > 3
    assert {r.run for r in entry.queries()["q19_route_enumeration"](spark, d).select("run").distinct().collect()} == set(depths)
    replayed = {r.run: r.outcome for r in entry.queries()["q24_replayed_routes"](spark, d).collect()}
    assert set(replayed) == {m for m, c in depths.items() if 2 <= c <= 8} and set(replayed.values()) == {"complete", "truncated away"}
