"""Stacked blocks read each table a few times at most, before any exchange is reused; the plans that users get, with default settings, give the twins' rows."""

import re
from collections import Counter

import pytest

from test_queries import TABLES, cell
from tidewatch.plans import catalog

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.01"
STACKED = ("det_skew_shock", "calib_skew_asof", "det_dominance", "det_basis_dislocation", "det_absorption", "det_break_wall", "det_depletion", "det_spoofing", "rule_eval", "book_best", "metrics_unpivot", "iv_surface_1m")


@pytest.mark.parametrize("name", STACKED)
def test_scans(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    scans = Counter(re.findall(r"FileScan parquet.*?Location: [^\[]*\[file:([^,\]]*)", plan))
    assert scans and max(scans.values()) <= 5, scans


@pytest.mark.parametrize("name", ["book_best", "det_absorption", "det_spoofing", "det_slicing_hitting", "calib_oi_pct", "rule_eval"])
def test_default_settings(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    result = con.execute(catalog.oracle_sql()[name])
    order = [[c[0] for c in result.description].index(c) for c in columns]
    want = sorted(tuple(cell(row[i]) for i in order) for row in result.fetchall())
    assert sorted(tuple(cell(x) for x in row) for row in got.select(columns).collect()) == want
