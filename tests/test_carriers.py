"""Every registered catalog query against its SQL, and the entry module."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from relscope.plans import carriers, script_carriers, set_carriers  # noqa: F401  (registers its queries with carriers)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(carriers.QUERIES))
def test_query_matches_its_sql(spark, db, name):
    got = carriers.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(carriers.ORACLE[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    a = sorted(repr(tuple(map(plain, r))) for r in got.select(*columns).collect())
    assert a == sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())


def on_rows(spark, folder, name, **tables):
    """Rows of a query on tables (schema, rows), and those of its SQL."""
    c = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        c.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got, want = carriers.QUERIES[name](spark, str(folder)), c.sql(carriers.ORACLE[name])
    return sorted(map(repr, map(tuple, got.select(*want.columns).collect()))), sorted(map(repr, want.fetchall()))


def test_orders_are_no_customers(spark, tmp_path):
    orders = [(0, 3, "1-URGENT"), (1, 1, "2-HIGH"), (-4, 3, "1-URGENT"), (5, None, "1-URGENT")]
    customers = [(0,), (1,), (3,), (4,), (None,)]
    got, want = on_rows(spark, tmp_path, "orphan_customers", customer=("c_custkey long", customers), orders=("o_orderkey long, o_custkey long, o_orderpriority string", orders))
    assert got == want == ["(0,)", "(1,)", "(4,)", "(None,)"]


def test_redacted_rows_of_odd_customers(spark, tmp_path):
    balances = [-0.3, -0.0, 0.4, -0.5, 2.5, -2.5, None, float("nan"), float("inf"), float("-inf")]
    rows = [(i, f"C{i}", i, b) for i, b in enumerate(balances)] + [(20, None, 1, 1.0), (21, "a;Database=b", 2, 1.0), (22, "x", None, 1.0), (None, "x", 3, 1.0)]
    got, want = on_rows(spark, tmp_path, "redacted", customer=("c_custkey long, c_name string, c_nationkey int, c_acctbal double", rows))
    assert got == want and any("'-0.0'" in r for r in got) and any(r.endswith("None)") for r in got)


@pytest.mark.parametrize("name", ["view_most_complex", "view_most_referenced", "view_most_referencing"])
def test_a_part_of_the_metrics_searches_no_cycles(spark, monkeypatch, name):
    monkeypatch.setattr(script_carriers.views.G, "cycles", lambda *a: pytest.fail("cycles were searched"))
    assert carriers.QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_are_known_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(__spark_entry__.__file__)))
