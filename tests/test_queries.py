"""Every registered query of the core against its SQL, and plans without nested-loop joins on large sides."""

import importlib
import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
MODULES = [importlib.import_module(f"skyloom.plans.{m}") for m in ("cleaning", "relational", "domain", "catalog", "science", "compile")]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLES = {n: s for m in MODULES for n, s in m.ORACLES.items()}


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for f in sorted(FOLDER.glob("*.parquet")):
        connection.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return connection


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if type(v).__name__ == "Decimal":
        return repr(int(v)) if v == int(v) else repr(float(v))
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, tables, name):
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
    relation = tables.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    assert got == sorted(tuple(cell(r[i]) for i in order) for r in relation.fetchall())


def test_digest_is_reproducible(spark):
    a, b = (QUERIES["table_digest"](spark, str(FOLDER)).first() for _ in range(2))
    assert a == b


@pytest.mark.parametrize("name", ["or_join_rewrite", "sky_neighbours", "sky_crossmatch", "period_tolerance_match", "p5_found", "p2_found"])
def test_no_nested_loop(spark, name):
    plan = QUERIES[name](spark, str(FOLDER))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_scan_prunes_and_pushes(spark):
    plan = QUERIES["bitmask_filter"](spark, str(FOLDER))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan and "GreaterThanOrEqual(o_totalprice,50000" in plan
