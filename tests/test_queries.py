"""Every surveillance query against its SQL twin on the smallest tables."""

import decimal
import math
import numbers
import os

import pytest

from tidewatch.plans import catalog

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def small_plans(spark):
    """On a thousand rows, compiling and re-planning take longer than the work."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(x):
    if x is None or isinstance(x, numbers.Number) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (numbers.Number, decimal.Decimal)):
        return f"{float(x):.5f}".replace("-0.00000", "0.00000")
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, twin, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    result = twin.execute(catalog.oracle_sql()[name])
    assert sorted(c[0] for c in result.description) == columns
    order = [[c[0] for c in result.description].index(c) for c in columns]
    want = sorted(tuple(cell(row[i]) for i in order) for row in result.fetchall())
    assert sorted(tuple(cell(x) for x in row) for row in got.select(columns).collect()) == want


def test_every_query_has_its_twin():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", ["det_dominance", "det_spread_squeeze", "book_spread_mid", "det_absorption", "det_break_wall", "det_depletion", "det_spoofing", "rr_bf_atm", "surface_build"])
def test_queries_find_something(spark, name):
    """The derived feeds hold what the detectors look for: both sides of each book, calls and puts at each expiry."""
    got = catalog.queries()[name](spark, SF)
    value = {"book_spread_mid": "spread", "rr_bf_atm": "rr_25d", "surface_build": "rr_25d"}.get(name)
    assert (got.where(f"{value} is not null") if value else got).limit(1).count() == 1
