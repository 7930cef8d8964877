"""Building blocks and stateful detectors against plain loops on random rows, and values worth keeping."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.operators import blocks as B
from tidewatch.operators import book, detect, macro, rolling, rules, surface


@pytest.fixture(scope="module")
def rows():
    rng, out, t = random.Random(7), [], 0
    for seq in range(900):
        t += rng.choice((0, 0, 40, 900, 4000, 30_000))
        out.append((rng.choice("AAAB"), t, seq, rng.choice(("buy", "sell")), float(rng.randint(-9, 9)), rng.random() < 0.3))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "instrument_id string, ts_ms long, seq long, side string, x double, flag boolean").repartition(4).cache()


def test_trailing_sum(frame, rows):
    got = {(r.instrument_id, r.seq): r.s for r in B.trailing_sum(frame, ["instrument_id"], F.col("x"), 5000, "s").collect()}
    for i, t, s, _, _, _ in rows:
        assert got[i, s] == pytest.approx(sum(x for j, u, q, _, x, _ in rows if j == i and q <= s and u >= t - 5000))


def test_asof(frame, rows):
    got = {(r.instrument_id, r.seq): r.ref for r in B.asof(frame, ["instrument_id"], F.col("x"), 4000, 40_000).collect()}
    for i, t, s, *_ in rows:
        past = [(u, q, x) for j, u, q, _, x, _ in rows if j == i and t - 40_000 <= u <= t - 4000]
        ref = got[i, s]
        assert (tuple(ref) if ref else None) == (max(past) if past else None)


def test_clamped_sum(frame, rows):
    got = {(r.instrument_id, r.seq): r.s for r in B.clamped_sum(frame, ["instrument_id"], F.col("x"), "s").collect()}
    level = {}
    for i, _, s, _, x, _ in rows:
        level[i] = max(level.get(i, 0.0) + x, 0.0)
        assert got[i, s] == pytest.approx(level[i])


def test_cooled(frame, rows):
    got = {(r.instrument_id, r.seq) for r in B.cooled(frame.where("flag"), ["instrument_id"], 10_000).collect()}
    last, want = {}, set()
    for i, t, s, _, _, flag in rows:
        if flag and (i not in last or t - last[i] >= 10_000):
            last[i] = t
            want.add((i, s))
    # Rows of one instant are one candidate each; the fold takes the first of them.
    assert got == want


def test_held(frame, rows):
    got = {(r.instrument_id, r.seq, r.armed_ms) for r in B.held(frame, ["instrument_id"], F.col("x") > 0, 3000, 10_000).collect()}
    armed, last, want = {}, {}, set()
    for i, t, s, _, x, _ in rows:
        if x <= 0:
            armed.pop(i, None)
        elif i in last and t - last[i] < 10_000:
            continue
        elif i not in armed:
            armed[i] = t
        elif t - armed[i] >= 3000:
            last[i] = t
            want.add((i, s, armed.pop(i)))
    assert got == want and got


def test_two_levels(frame, rows):
    """Previous rows, newest known values, running sums and as-of references over many buckets."""
    key = ["instrument_id"]
    assert max(t for _, t, *_ in rows) > 5 * B.SPAN
    was = {r.seq: r.was for r in B.previous(frame, key, ["x", "side"]).collect()}
    known = {r.seq: (r.a, r.b) for r in B.last_known(B.last_known(frame, key, True, a=F.when(F.col("flag"), F.col("x"))), key, False, b=F.when(F.col("flag"), F.col("x"))).collect()}
    total = {r.seq: r.total for r in B.running(frame, key, ["ts_ms", "seq"], total=F.col("x")).collect()}
    back = {r.seq: r.ref for r in B.asof_growing(frame, key, F.col("x"), 700_000).collect()}
    ahead = {r.seq: r.ahead for r in B.asof_forward(frame, key, F.col("x"), 700_000).collect()}
    for n, (i, t, s, _, _, flag) in enumerate(rows):
        mine = [r for r in rows if r[0] == i]
        before = [r for r in mine if r[2] < s]
        assert (tuple(was[s]) if was[s] else None) == ((before[-1][4], before[-1][3]) if before else None)
        flags = [r[4] for r in before if r[5]]
        assert known[s] == (rows[n][4] if flag else flags[-1] if flags else None, flags[-1] if flags else None)
        assert total[s] == pytest.approx(sum(r[4] for r in before) + rows[n][4])
        old, new = [r for r in mine if r[1] <= t - 700_000], [r for r in mine if r[1] >= t + 700_000]
        assert (back[s]["seq"] if back[s] else None) == (old[-1][2] if old else None)
        assert (ahead[s]["seq"] if ahead[s] else None) == (new[0][2] if new else None)


def test_percentiles(spark, rows):
    from tidewatch.operators.calibrate import percentiles

    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(3)
    for values in (rng.exponential(size=30_000), rng.integers(0, 3, 5000).astype(float), np.array([1.5]), np.array([2.0, 3.0])):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double")
        for accuracy in (10_000, 50):
            row = percentiles(df, F.col("x"), (0.0, 0.01, 0.5, 0.9, 0.99, 1.0), accuracy=accuracy).first()
            want = np.quantile(values, (0.0, 0.01, 0.5, 0.9, 0.99, 1.0))
            assert [row.p00, row.p01, row.p50, row.p90, row.p99, row.p100] == pytest.approx(want.tolist(), abs=1e-6) and row.n == len(values)
    none = percentiles(spark.createDataFrame([], "x double"), F.col("x")).first()
    assert (none.p90, none.n) == (None, 0)


def test_runs_and_slicing(frame, rows):
    trades = frame.select("instrument_id", "ts_ms", "seq", "side", F.lit(1.0).alias("price"), F.abs("x").alias("qty"))
    got = {(r.instrument_id, r.seq): (r.k, r.volume) for r in detect.slicing(trades, 900, 2, 3.0).collect()}
    state, want = {}, {}
    for i, t, s, side, x, _ in rows:
        last = state.get(i)
        k, v = (last[2], last[3]) if last and last[0] == side and t - last[1] <= 900 else (0, 0.0)
        state[i] = (side, t, k + 1, v + abs(x))
        if k + 1 >= 2 and v + abs(x) >= 3:
            want[i, s] = (k + 1, v + abs(x))
    assert got == want


def test_second_derivative_of_a_parabola(spark):
    rows = spark.createDataFrame([("A", 1000 * t, t, float(t * t)) for t in range(50)], "instrument_id string, ts_ms long, seq long, v double")
    got = rolling.second_derivative(rows, ["instrument_id"], "v", 2000, 9000).where("accel is not null").select("accel").distinct().collect()
    assert [r.accel for r in got] == [pytest.approx(2.0)]


def test_book_values(spark):
    depth = spark.createDataFrame([("A", 0, 1, "buy", "insert", 100.0, 5.0), ("A", 0, 2, "sell", "insert", 101.0, 5.0), ("A", 5, 3, "buy", "delete", 100.0, 9.0), ("A", 6, 4, "buy", "insert", 99.0, 3.0)], "instrument_id string, ts_ms long, seq long, side string, action string, price double, qty double")
    got = {r.instant: r for r in book.summary(depth, 2).collect()}
    assert (got[0].wmid, got[0].dominance_bid, got[0].imbalance) == (100.5, 0.5, 0.0)
    assert got[4].bid_vol == 5 and got[6].bid_vol == 3 and got[6].best_bid == 99.0


def test_refill_and_intensity(spark):
    row = spark.range(1).select(B.intensity(F.lit(50.0), 20, 60).alias("a"), B.intensity(F.lit(1000.0), 20, 60).alias("b"), X.close(F.lit(1.0), F.lit(1.04), 0.05, 0.0).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.75, 1.0, True)


def test_liq_cluster_arms_then_fires(spark):
    polls = spark.createDataFrame([("A", 0, 0.0, 150.0, 100.0), ("A", 10_000, 0.0, 150.0, 70.0), ("A", 20_000, 0.0, 50.0, 60.0)], "instrument_id string, ts_ms long, buy double, sell double, mid double")
    got = macro.liq_cluster(polls, 100.0, 200.0, 1e9, 25.0, 10_000, 10.0, 10_000, 60_000).collect()
    assert [(r.ts_ms, r.side, r.momentum, r.intensity) for r in got] == [(10_000, "sell", -30.0, 0.5)]


def test_gamma_flip_needs_two_polls(spark):
    polls = spark.createDataFrame([("B", t, n) for t, n in ((0, 500.0), (1, -500.0), (2, -500.0), (3, -500.0))], "underlying string, ts_ms long, net double")
    got = macro.gamma_flip(polls, 100.0, 0.1, 2, 0.0, 1000.0, 60_000).collect()
    assert [(r.ts_ms, r.sign_from, r.sign_to, r.intensity) for r in got] == [(2, 1, -1, 0.5)]


SNAPSHOT = "instrument_id string, ts_ms long, seq long, basis_vel_bps_s double, basis_vel_bps_s_doc double, best_bid double, best_ask double, dep_bid double, dep_ask double, refill_bid_3s double, refill_ask_3s double, depletion_bid_doc double, depletion_ask_doc double"


@pytest.mark.parametrize(
    ("source", "snapshot", "fired", "gate", "depleted", "refilled"),
    [
        ("doc", (None, 5.0, 100.0, 100.1, None, None, None, None, None, -80.0), True, None, 80.0, 0.0),
        ("doc", (None, 5.0, 100.0, 100.1, None, None, None, None, None, -5.0), False, "dep_low", 5.0, 0.0),
        ("doc", (None, 5.0, 100.0, 100.1, None, None, None, None, None, 30.0), False, "no_depletion", 0.0, 30.0),
        ("doc", (None, 5.0, 100.0, 103.0, None, None, None, None, None, -80.0), False, "top_levels_gate", 80.0, 0.0),
        ("doc", (5.0, None, 100.0, 100.1, None, 0.9, None, 0.1, None, -80.0), False, None, 80.0, 0.0),
        ("legacy", (5.0, None, 100.0, 100.1, None, 0.9, None, 0.1, None, None), True, None, None, None),
        ("legacy", (5.0, None, 100.0, 100.1, None, 0.9, None, 0.7, None, None), False, "refill_high", None, None),
        ("auto", (1.0, None, 100.0, 100.1, None, 0.9, None, 0.7, None, None), False, "basis_vel_low", None, None),
        ("auto", (None, 5.0, 100.0, 100.1, None, 0.9, None, 0.1, None, None), True, None, None, None),
    ],
)
def test_break_wall(spark, source, snapshot, fired, gate, depleted, refilled):
    slices = spark.createDataFrame([("A", t, t, "buy", 100.0, 5.0) for t in (10, 20, 30)], "instrument_id string, ts_ms long, seq long, side string, price double, volume double")
    rows = detect.break_wall(slices, spark.createDataFrame([("A", 1, 1, *snapshot)], SNAPSHOT), 3, 1.5, source).orderBy("ts_ms").collect()
    assert [r.fired for r in rows] == [False, False, fired] and [r.gate for r in rows] == [None, None, gate]
    last = rows[-1]
    if depleted is not None:
        assert (last.depleted, last.refilled) == (depleted, refilled)
    assert last.intensity == 5.0


def test_depletion_forms(spark):
    rows = lambda doc, dep: spark.createDataFrame([("A", t, t, doc, dep) for t in (0, 500, 1000)], "instrument_id string, ts_ms long, seq long, depletion_bid_doc double, dep_bid double")
    one = lambda *a, **k: [(r.ts_ms, round(r.intensity, 6), r.amount, r.metric_source) for r in detect.depletion(*a, **k).collect()]
    assert one(rows(-50.0, 0.9), "buy", "doc", 0.4, 20.0, 60.0, 200.0, 800, 30_000) == [(1000, 0.75, 50.0, "doc")]
    assert one(rows(-1000.0, 0.9), "buy", "auto", 0.4, 20.0, 60.0, 200.0, 800, 30_000) == [(1000, 1.0, 200.0, "doc")]
    assert one(rows(None, 0.9), "buy", "auto", 0.4, 20.0, 60.0, 200.0, 800, 30_000) == [(1000, 0.9, None, "legacy")]
    assert one(rows(50.0, 0.9), "buy", "doc", 0.4, 20.0, 60.0, 200.0, 800, 30_000) == []
    assert one(rows(50.0, 0.9), "buy", "doc", 0.4, 20.0, 60.0, 200.0, 800, 30_000, "log", False) == [(1000, round(__import__("math").log1p(2.5) / __import__("math").log1p(3), 6), 50.0, "doc")]


def test_trigger_turns_the_documented_sign(spark):
    rows = spark.createDataFrame([("A", t, t, 10.0, 120.0) for t in (0, 600)], "instrument_id string, ts_ms long, seq long, basis_bps double, basis_bps_doc double")
    got = detect.metric_trigger(rows, "basis_bps", -50.0, False, 500, 30_000, "doc", "basis_bps_doc").collect()
    assert [(r.intensity, r.metric_used, r.side) for r in got] == [(-120.0, "basis_bps_doc", "na")]


def test_spoofing_life_cycle(spark):
    depth = spark.createDataFrame([("A", 0, 1, "buy", "insert", 95.0, 12.0, 100.0, 100.1), ("A", 50, 2, "buy", "delete", 95.0, 10.0, None, None), ("A", 100, 3, "buy", "delete", 95.0, 10.0, None, None), ("A", 200, 4, "buy", "delete", 95.0, 99.0, None, None)], "instrument_id string, ts_ms long, seq long, side string, action string, price double, qty double, best_bid double, best_ask double")
    trades = spark.createDataFrame([], "instrument_id string, ts_ms long, price double, qty double")
    got = detect.spoofing(depth, trades, 10.0, 30, 80, 0.6, 2.0, 0.1).collect()
    assert [(r.ts_ms, r.side, r.intensity, r.dropped, r.cancel_rate, r.distance_ticks) for r in got] == [(100, "buy", 12.0, 20.0, 20 / 32, 50)]
    near = depth.withColumn("best_bid", F.lit(97.0))
    assert detect.spoofing(near, trades, 10.0, 30, 80, 0.6, 2.0, 0.1).count() == 0
    hit = spark.createDataFrame([("A", 60, 95.1, 3.0)], "instrument_id string, ts_ms long, price double, qty double")
    assert detect.spoofing(depth, hit, 10.0, 30, 80, 0.6, 2.0, 0.1).count() == 0


def test_rules_fit_by_side_metric_and_sign(spark):
    rows = [
        ("break_wall", "buy", 1.0, None, None, -3.0), ("break_wall", "buy", 1.0, None, None, 2.5), ("metric_trigger", "na", -120.0, "basis_bps", -50.0, None), ("metric_trigger", "na", 120.0, "basis_bps", 50.0, None), ("metric_trigger", "na", None, "spread_usd", 1.0, None),
        ("metric_trigger", "na", 9.0, "wmid", 1.0, None), ("liq_cluster", "sell", 0.5, None, None, None), ("top_traders", "LONG", -0.9, None, None, None), ("iv_spike", None, 0.9, None, None, None), ("iv_spike_down", "na", -15.0, None, None, None), ("gamma_flip", "buy", None, None, None, None), ("dominance", "sell", 85.0, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, side string, intensity double, metric string, threshold double, velocity double")
    got = sorted((r.i, r.rule, r.side, r.severity) for r in rules.rated(df).collect())
    assert got == [(1, "R1", "buy", "MEDIUM"), (2, "R16", "na", "HIGH"), (3, "R15", "na", "HIGH"), (4, "R27", "na", "LOW"), (6, "R32", "sell", "MEDIUM"), (7, "R30", "long", "LOW"), (8, "R19", "na", "HIGH"), (9, "R20", "na", "HIGH"), (10, "R36", "na", "MEDIUM"), (11, "R10", "sell", "MEDIUM")]


def test_severity_and_suppression(spark):
    assert spark.range(1).select(rules.severity(F.lit(None).cast("double"), F.lit(1.0), F.lit(2.0)).alias("s")).first().s == "MEDIUM"
    alerts = spark.createDataFrame([("k", t, t) for t in (0, 50_000, 89_999, 90_000, 200_000)], "dedup_key string, ts_ms long, seq long")
    got = sorted((r.ts_first, r.ts_last, r.n_hits) for r in rules.suppressed(alerts).collect())
    assert got == [(0, 89_999, 3), (90_000, 90_000, 1), (200_000, 200_000, 1)]


def test_surface_values(spark):
    row = spark.range(1).select(surface.tenor(F.lit(7)).alias("a"), surface.tenor(F.lit(0)).alias("b"), surface.band(F.lit(0.95)).alias("c"), surface.band(F.lit(1.1)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("0_7d", None, "0.95_1.00", None)


def test_empty_inputs(frame):
    none = frame.limit(0)
    assert B.trailing_sum(none, ["instrument_id"], F.col("x"), 5000, "s").count() == 0
    assert B.cooled(none, ["instrument_id"], 10).count() == 0
