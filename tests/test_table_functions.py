"""Table functions: equal to the DataFrame operators, defaults, and arguments that reach the scan."""

from tidewatch.operators import table_functions
from tidewatch.plans import catalog
from tidewatch.sources.views import Views

SF = "/root/testdata/sf0.001"


def test_call_equals_the_operator_over_all_instruments(spark):
    v = Views(spark, SF)
    table_functions.register(spark, v.trades, v.depth)
    want = {(r.instrument_id, r.first_seq, r.k, r.volume) for r in catalog.queries()["audit_slicing_blocks"](spark, SF).collect()}
    ids = [r.instrument_id for r in v.trades.select("instrument_id").distinct().collect()]
    got = {(r.instrument_id, r.first_seq, r.k, r.volume) for i in ids for r in spark.sql(f"SELECT * FROM audit_slicing_blocks('{i}', 0, 1000000000000, 5, 5.0)").collect()}
    assert got == want and want


def test_defaults_and_pushed_filters(spark):
    v = Views(spark, SF)
    table_functions.register(spark, v.trades, v.depth)
    assert spark.sql("SELECT * FROM audit_slicing_passive_blocks('SIM:PERP:1', 0, 1000000000)").columns[0] == "instrument_id"
    stored = v.trades.where("ts_ms < 30000")
    spark.range(1).selectExpr("'SIM:PERP:1' AS instrument_id", "5L AS ts_ms", "1L AS seq", "'buy' AS side", "1.0D AS price", "2.0D AS qty").unionByName(stored.limit(0)).createOrReplaceTempView("given")
    plan = spark.sql("SELECT * FROM audit_slicing_by_second('SIM:PERP:1', 1000, 2000)")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan.split("Relation")[0] and "SIM:PERP:1" in plan.split("Relation")[0]
