"""What a row or a batch costs doesn't grow with the density of a feed or with the length of a table."""

from pyspark.sql import functions as F

from tidewatch.operators import blocks as B
from tidewatch.operators import rolling as R
from tidewatch.operators import surface as V
from tidewatch.plans import catalog
from tidewatch.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_alerts_broadcast_no_events(spark):
    """Only the table of rules is small at every size."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert plan(catalog.queries()["alert_text"](spark, SF)).count("BroadcastExchange") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_as_of_frames_only_grow(spark):
    """A frame with two moving ends is gone through anew at each row."""
    rows = [("a", t, t, float(t)) for t in (0, 1_000, 2_000, 2_000, 60_000, 61_500, 200_000)]
    df = spark.createDataFrame(rows, "k string, ts_ms long, seq long, x double")
    got = B.asof(df, ["k"], F.col("x"), 1_000, 60_000)
    times = [r[1] for r in rows]
    want = [(t, max((u for u in times if 1_000 <= t - u <= 60_000), default=None)) for t in times]
    assert sorted((r.ts_ms, r.ref and r.ref.ts_ms) for r in got.collect()) == sorted(want, key=lambda x: (x[0], x[1] or 0))
    assert "rangeframe, unboundedpreceding" in plan(got).lower().replace("$()", "")


def test_polls_are_taken_apart_by_spark(spark):
    """The fold in Python gives a row a stretch of polls."""
    samples = spark.readStream.format("rate").load().select(F.col("value").alias("user_id"), F.col("value").alias("ts_ms"), F.col("timestamp").alias("at"), F.lit(1.0).alias("qty"))
    polled = J.polled(samples, 3_000)
    assert polled.columns == ["user_id", "poll_ms", "qty"] and "Generate explode" in polled._jdf.queryExecution().analyzed().toString()


def test_stretches_of_polls_are_stored_not_polls(spark, tmp_path):
    """What a stream of polls keeps on disk grows with its rows: a user who is seldom heard of brings 200 polls a row."""
    heard = [(e, e // 4_000 % 3, 50.0 * (e // 4_000 % 7) + 1) for e in range(0, 200_000, 4_000)]  # a row each 200 s, a user's each 600 s
    heard += [(e, 3, 7.0) for e in (100, 160, 60_000, 199_999)]
    rows = spark.createDataFrame([(e, u, "click", x, '{"k": 1}') for e, u, x in heard], "event_id long, user_id long, event_type string, value double, props string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["stream_timer_poll"](spark, str(tmp_path))
    top, want = 199_999 * 50, []
    for user in range(4):
        own = sorted((e * 50, -(-x // 50)) for e, u, x in heard if u == user)
        for (t, qty), then in zip(own, [t for t, _ in own[1:]] + [None], strict=True):
            end = min(t + 600_001, top - 1_000 if then is None else then)
            want += [(user, p, qty) for p in range(-(-t // 3_000) * 3_000, end, 3_000)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 5_000
    assert spark.read.parquet(*got.inputFiles()).count() <= 2 * len(heard)


def test_series_lie_in_hours(spark):
    """A partition a minute is a file a minute, 60 times as many to list and to move."""
    for name in ("sink_append_dedup", "sink_metrics_series", "sink_slice_events", "sink_telemetry_add", "sink_surface_upsert", "tail_incremental"):
        files = catalog.queries()[name](spark, "/root/testdata/sf0.01").inputFiles()
        assert files and all("/hour=" in f for f in files), name
        assert len({f.rsplit("/", 2)[-2] for f in files}) <= 2, name


def test_minutes_are_made_where_they_are_grouped(spark):
    """Ticks are dealt once, before a row a minute is made of them; which minutes a tick serves doesn't depend on the stretch."""
    times = [0, 100, 61_000, 3_599_000, 3_600_000, 3_605_001, 3_661_000, 7_199_999, 9_000_000]
    rows = [(f"i{i % 2}", t, n, 0) for n, t in enumerate(times) for i in range(3)][: 3 * len(times)]
    rows = sorted({(i, t, n, q) for i, t, n, q in rows})
    got = V.serving(spark.createDataFrame(rows, "instrument_id string, ts_ms long, seq long, seq2 long"), 600_000, 5_000)
    want = []
    for minute in range(170):
        for name in ("i0", "i1"):
            seen = [r for r in rows if r[0] == name and minute * 60_000 - 600_000 <= r[1] <= minute * 60_000 + 5_000]
            want += [(minute, name, max(seen, key=lambda r: r[1:])[1])] if seen else []
    assert sorted((r.minute, r.instrument_id, r.ts_ms) for r in got.collect()) == sorted(want)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert plan(got.groupBy("_part", "minute").count()).count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_minutes_are_reduced_without_a_sort(spark):
    """A row a minute of each tick is met by aggregates of numbers, in tasks that grow in number with the time that the ticks span."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        built = plan(catalog.queries()["surface_build"](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortAggregate" not in built and "ObjectHashAggregate" not in built and "/once-" not in built
    ticks = spark.createDataFrame([("i", t * 3_600_000, 0, 0) for t in (0, 50, 99)], "instrument_id string, ts_ms long, seq long, seq2 long")
    assert V.serving(ticks, 600_000, 5_000).rdd.getNumPartitions() >= 200


def test_stray_times_make_no_tasks(spark):
    """Beyond the tasks that rows are dealt to without a sort, ticks and the stretches that hold any count, not the time between the first and the last."""
    at = lambda hours: spark.createDataFrame([(h * 3_600_000,) for h in hours], "ts_ms long")
    assert V._tasks(at([0, 1_000_000])) == V._tasks(at([0, 10, 1_000_000])) == V.TASKS and V._tasks(at([5])) == 8 and V._tasks(at([])) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = spark.range(900_000).select((F.col("id") % 5_000 * 3_600_000).alias("ts_ms"))
    full, V.FULL = V.FULL, 2_000
    try:
        assert V._tasks(many) == 450
    finally:
        V.FULL = full
    stray = V.serving(at([0, 1_000_000]).selectExpr("'i' AS instrument_id", "ts_ms", "0L AS seq", "0L AS seq2"), 60_000, 0)
    assert {r.minute for r in stray.collect()} == {0, 1, 60_000_000, 60_000_001} and stray.rdd.getNumPartitions() == V.TASKS


def test_rolling_means_by_sums_that_only_grow(spark):
    """Over ties, nulls, gaps and values of very different size, as from each window's own rows."""
    rows = [("a", t * 7 % 4_000 * 100, t, None if t % 9 == 0 else 1e9 if t % 50 == 0 else t % 13 / 8) for t in range(600)]
    got = R.mean(spark.createDataFrame(rows, "k string, ts_ms long, seq long, x double"), ["k"], "x", 20_000)
    for r in got.collect():
        window = [x for _, t, _, x in rows if r.ts_ms - 20_000 <= t <= r.ts_ms and x is not None]
        assert (r["mean"] is None) == (not window) and (not window or abs(r["mean"] - sum(window) / len(window)) <= 1e-12 * max(1, abs(r["mean"])))
    assert "rangeframe, -" not in plan(got).lower() and set(got.columns) == {"k", "ts_ms", "seq", "x", "mean"}
