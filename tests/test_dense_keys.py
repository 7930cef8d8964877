"""Cooldowns and suppression over one key whose candidates never pause: nothing is gathered by key, state passes from batch to batch."""

import pytest

from tidewatch.operators import blocks, rules


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 50)
    yield
    spark.conf.set(name, before)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cooled_without_pause(spark, small_batches):
    rows = spark.range(3000).selectExpr("if(id % 10 = 0, 'B', 'A') AS instrument_id", "id * 7 AS ts_ms", "id AS seq").repartition(3)
    got = blocks.cooled(rows, ["instrument_id"], 1000)
    assert "collect_list" not in plan(got)
    last, want = {}, set()
    for i in range(3000):
        key = "B" if i % 10 == 0 else "A"
        if key not in last or 7 * i - last[key] >= 1000:
            last[key] = 7 * i
            want.add((key, i))
    assert {(r.instrument_id, r.seq) for r in got.collect()} == want


def test_suppressed_without_pause(spark, small_batches):
    alerts = spark.range(1000).selectExpr("if(id % 10 = 0, 'B', 'A') AS dedup_key", "id * 7 AS ts_ms", "id AS seq").repartition(3)
    got = rules.suppressed(alerts, 1000)
    assert "collect_list" not in plan(got)
    want = []
    for key in "AB":
        for i in range(1000):
            if (key == "B") == (i % 10 == 0):
                if not want or want[-1][0] != key or 7 * i - want[-1][1] >= 1000:
                    want.append([key, 7 * i, 7 * i, 0])
                want[-1][2:] = 7 * i, want[-1][3] + 1
    assert sorted([r.dedup_key, r.ts_first, r.ts_last, r.n_hits] for r in got.collect()) == want
