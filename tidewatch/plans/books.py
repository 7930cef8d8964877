"""Order-book states and the metrics on them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import exprs as X
from tidewatch.operators import book as B
from tidewatch.operators import rolling as R
from tidewatch.operators.blocks import asof_join, bucketed, trailing_sum, unbucketed

from .registry import query

R6 = lambda c: F.round(c, 6)
#: Book samples: at each trade and every 50 ms; the wide snapshot, and the detectors and audits on it, every second.
CADENCE, SECOND, ARRAYS = 50, 1_000, 250

LEVELS = """
lx AS (SELECT *, sum(CASE WHEN action = 'delete' THEN -qty ELSE qty END) OVER w AS s FROM depth WINDOW w AS (PARTITION BY instrument_id, side, price ORDER BY ts_ms, seq)),
lv AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY instrument_id, side, price ORDER BY ts_ms, seq)) AS level_qty, lead(ts_ms) OVER (PARTITION BY instrument_id, side, price ORDER BY ts_ms, seq) AS to_ms, lead(seq) OVER (PARTITION BY instrument_id, side, price ORDER BY ts_ms, seq) AS to_seq FROM lx)"""
TRADED = "SELECT DISTINCT instrument_id, ts_ms AS instant FROM trades"


def grid_sql(every: int) -> str:
    return f"SELECT instrument_id, unnest(range(0, (SELECT max(ts_ms) FROM depth) + 1, {every})) AS instant FROM (SELECT DISTINCT instrument_id FROM depth)"


def book_sql(instants: str) -> str:
    """The live levels and the book at (instrument_id, instant)."""
    return f"""{LEVELS},
g AS ({instants}),
live AS (SELECT instant, g.instrument_id, side, price, level_qty AS qty, row_number() OVER (PARTITION BY instant, g.instrument_id, side ORDER BY CASE WHEN side = 'buy' THEN -price ELSE price END) AS level
         FROM g JOIN lv ON lv.instrument_id = g.instrument_id AND lv.ts_ms <= instant AND (to_ms IS NULL OR to_ms > instant) WHERE level_qty > 0),
b AS (SELECT instrument_id, instant, max(price) FILTER (WHERE side = 'buy') AS best_bid, min(price) FILTER (WHERE side = 'sell') AS best_ask, max(qty) FILTER (WHERE side = 'buy' AND level = 1) AS bid_qty, max(qty) FILTER (WHERE side = 'sell' AND level = 1) AS ask_qty,
             coalesce(sum(qty) FILTER (WHERE side = 'buy' AND level <= 5), 0) AS bid_vol, coalesce(sum(qty) FILTER (WHERE side = 'sell' AND level <= 5), 0) AS ask_vol, count(*) FILTER (WHERE side = 'buy') AS bid_levels, count(*) FILTER (WHERE side = 'sell') AS ask_levels
      FROM live GROUP BY ALL)"""


BOOK, BOOK_1S, BOOK_TRADED = book_sql(f"{grid_sql(CADENCE)} UNION {TRADED}"), book_sql(grid_sql(SECOND)), book_sql(TRADED)


def book(v):
    return B.summary(v.depth, CADENCE, at=B.instants(v.trades))


def book_1s(v):
    return B.summary(v.depth, SECOND)


@query("book_levels", f"{LEVELS} SELECT instrument_id, seq, level_qty FROM lv")
def book_levels(v):
    return B.levels(v.depth).select("instrument_id", "seq", "level_qty")


@query("book_levels_absolute", """
m AS (SELECT *, max(CASE WHEN kind = 'snapshot' THEN seq END) OVER (PARTITION BY instrument_id ORDER BY ts_ms, seq) AS epoch FROM book_feed),
p AS (SELECT *, max(u) OVER (PARTITION BY instrument_id, epoch ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM m WHERE epoch IS NOT NULL),
x AS (SELECT *, kind = 'diff' AND CASE WHEN last = epoch * 10 THEN first_u > last + 1 ELSE pu <> last END AS gap FROM p WHERE kind = 'snapshot' OR u > last),
y AS (SELECT *, min(CASE WHEN gap THEN seq END) OVER (PARTITION BY instrument_id, epoch) AS broken FROM x),
l AS (SELECT instrument_id, epoch, broken IS NOT NULL AS gapped, seq, side, price, qty FROM y WHERE kind = 'diff' AND (broken IS NULL OR seq < broken) UNION ALL
      SELECT instrument_id, epoch, broken IS NOT NULL, seq, 'buy', 100::DOUBLE - 0.1::DOUBLE * j, 5.0::DOUBLE + j FROM y, range(3) r(j) WHERE kind = 'snapshot' UNION ALL
      SELECT instrument_id, epoch, broken IS NOT NULL, seq, 'sell', 100.1::DOUBLE + 0.1::DOUBLE * j, 6.0::DOUBLE + j FROM y, range(3) r(j) WHERE kind = 'snapshot'),
s AS (SELECT instrument_id, epoch, gapped, side, round(price, 6) AS price, arg_max(qty, seq) AS qty FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, epoch, side ORDER BY CASE WHEN side = 'buy' THEN -price ELSE price END) AS level FROM s WHERE qty > 0)
SELECT instrument_id, epoch, gapped, side, price, qty, level FROM r WHERE level <= 5""")
def book_levels_absolute(v):
    levels = B.absolute_books(v.book_feed, 5)
    return levels.select("instrument_id", F.col("epoch.seq").alias("epoch"), "gapped", "side", R6("price").alias("price"), "qty", F.col("level").cast("long").alias("level"))


@query("book_best", f"{BOOK} SELECT instrument_id, instant, round(best_bid, 6) AS best_bid, round(best_ask, 6) AS best_ask, bid_qty, ask_qty FROM b")
def book_best(v):
    return book(v).select("instrument_id", "instant", R6("best_bid").alias("best_bid"), R6("best_ask").alias("best_ask"), "bid_qty", "ask_qty")


@query("book_head", f"{BOOK} SELECT instrument_id, instant, side, level, round(price, 6) AS price, qty FROM live WHERE level <= 3")
def book_head(v):
    heads = B.replay(v.depth, 3, CADENCE, B.instants(v.trades))
    sides = [heads.select("instrument_id", F.col("ts_ms").alias("instant"), F.lit(side).alias("side"), F.posexplode(column).alias("_i", "_l")) for side, column in (("buy", "bids"), ("sell", "asks"))]
    return sides[0].unionByName(sides[1]).select("instrument_id", "instant", "side", (F.col("_i") + 1).cast("long").alias("level"), R6("_l.price").alias("price"), "_l.qty")


@query("interval_join_levels", f"{BOOK_1S} SELECT instrument_id, instant, side, round(price, 6) AS price, qty FROM live")
def interval_join_levels(v):
    return B.at_instants(v.depth, SECOND).select("instrument_id", "instant", "side", R6("price").alias("price"), "qty")


def _simple(name, columns, sql):
    @query(name, f"{BOOK} SELECT instrument_id, instant, {sql} FROM b")
    def run(v):
        return book(v).select("instrument_id", "instant", *(R6(F.col(c).cast("double")).alias(c) for c in columns))


_simple("book_topn_volume", ["bid_vol", "ask_vol"], "bid_vol, ask_vol")
_simple("book_imbalance", ["imbalance"], "round((bid_vol - ask_vol) / nullif(bid_vol + ask_vol, 0), 6) AS imbalance")
_simple("book_dominance_levels", ["level_share_bid"], "round(bid_levels / nullif(bid_levels + ask_levels, 0)::DOUBLE, 6) AS level_share_bid")
_simple("book_dominance_volume", ["dominance_bid"], "round(bid_vol / nullif(bid_vol + ask_vol, 0), 6) AS dominance_bid")
_simple("book_spread_mid", ["spread", "wmid"], "round(greatest(best_ask - best_bid, 0), 6) AS spread, round((best_ask + best_bid) / 2, 6) AS wmid")
_simple("m_spread_usd", ["spread"], "round(greatest(best_ask - best_bid, 0), 6) AS spread")
_simple("m_wmid", ["wmid"], "round((best_ask + best_bid) / 2, 6) AS wmid")
_simple("m_imbalance", ["imbalance"], "round((bid_vol - ask_vol) / nullif(bid_vol + ask_vol, 0), 6) AS imbalance")
_simple("m_dominance", ["level_share_bid"], "round(bid_levels / nullif(bid_levels + ask_levels, 0)::DOUBLE, 6) AS level_share_bid")


@query("book_depletion_pct", f"{BOOK}, p AS (SELECT *, lag(bid_vol) OVER w AS pb, lag(ask_vol) OVER w AS pa FROM b WINDOW w AS (PARTITION BY instrument_id ORDER BY instant)) SELECT instrument_id, instant, round(greatest(0, (pb - bid_vol) / nullif(pb, 0)), 6) AS bid, round(greatest(0, (pa - ask_vol) / nullif(pa, 0)), 6) AS ask FROM p")
def book_depletion_pct(v):
    w = Window.partitionBy("instrument_id").orderBy("instant")
    return book(v).select("instrument_id", "instant", R6(B.depletion(F.col("bid_vol"), F.lag("bid_vol").over(w))).alias("bid"), R6(B.depletion(F.col("ask_vol"), F.lag("ask_vol").over(w))).alias("ask"))


@query("book_snapshot_arrays", f"{book_sql(grid_sql(ARRAYS))} SELECT instrument_id, instant, list_resize(coalesce(list(round(price, 6) ORDER BY level) FILTER (WHERE side = 'buy' AND level <= 4), []), 4, 0::DOUBLE)[1] AS bid1, list_resize(coalesce(list(round(price, 6) ORDER BY level) FILTER (WHERE side = 'sell' AND level <= 4), []), 4, 0::DOUBLE)[4] AS ask4, list_resize(coalesce(list(qty ORDER BY level) FILTER (WHERE side = 'sell' AND level <= 4), []), 4, 0::DOUBLE)[2] AS ask_q2 FROM live GROUP BY ALL")
def book_snapshot_arrays(v):
    got = B.padded(B.replay(v.depth, 4, ARRAYS), 4)
    return got.select("instrument_id", F.col("ts_ms").alias("instant"), R6(F.col("bid_prices")[0]).alias("bid1"), R6(F.col("ask_prices")[3]).alias("ask4"), F.col("ask_qtys")[1].alias("ask_q2"))


# Means and changes of the metrics over trailing windows, on the instants.
def timed(rows):
    return rows.withColumns({"ts_ms": F.col("instant"), "seq": F.col("instant")})


@query("m_imbalance_doc", f"{BOOK} SELECT instrument_id, instant, round(avg((bid_vol - ask_vol) / nullif(bid_vol + ask_vol, 0)) OVER (PARTITION BY instrument_id ORDER BY instant RANGE BETWEEN 30000 PRECEDING AND CURRENT ROW), 6) AS mean FROM b")
def m_imbalance_doc(v):
    return R.mean(timed(book(v)), ["instrument_id"], "imbalance", 30_000).select("instrument_id", "instant", R6("mean").alias("mean"))


@query("m_dominance_doc", f"{BOOK}, d AS (SELECT *, avg(bid_vol / nullif(bid_vol + ask_vol, 0)) OVER (PARTITION BY instrument_id ORDER BY instant RANGE BETWEEN 20000 PRECEDING AND CURRENT ROW) AS m FROM b) SELECT instrument_id, instant, round(m, 6) AS bid, round(1 - m, 6) AS ask FROM d")
def m_dominance_doc(v):
    return R.mean(timed(book(v)), ["instrument_id"], "dominance_bid", 20_000).select("instrument_id", "instant", R6("mean").alias("bid"), R6(1 - F.col("mean")).alias("ask"))


@query("m_depletion_doc", f"{BOOK} SELECT x.instrument_id, x.instant, CASE WHEN p.instant >= x.instant - 90000 THEN x.bid_vol - p.bid_vol END AS bid, CASE WHEN p.instant >= x.instant - 90000 THEN x.ask_vol - p.ask_vol END AS ask FROM b x ASOF LEFT JOIN b p ON p.instrument_id = x.instrument_id AND p.instant <= x.instant - 30000")
def m_depletion_doc(v):
    bid = R.delta(timed(book(v)), ["instrument_id"], "bid_vol", 30_000, 90_000).withColumnRenamed("delta", "bid").drop("ref")
    return R.delta(bid, ["instrument_id"], "ask_vol", 30_000, 90_000).select("instrument_id", "instant", "bid", F.col("delta").alias("ask"))


@query("m_basis", "SELECT instrument_id, seq, round((mark_price / index_price - 1) * 1e4, 6) AS basis FROM mark_funding")
def m_basis(v):
    return v.mark_funding.select("instrument_id", "seq", R6(X.basis_bps()).alias("basis"))


@query("m_basis_velocity", "b AS (SELECT *, (mark_price / index_price - 1) * 1e4 AS b FROM mark_funding) SELECT instrument_id, seq, round((b - lag(b) OVER w) / greatest((ts_ms - lag(ts_ms) OVER w) / 1000.0::DOUBLE, 1e-6), 5) AS velocity FROM b WINDOW w AS (PARTITION BY instrument_id ORDER BY ts_ms, seq)")
def m_basis_velocity(v):
    return X.basis_velocity(v.mark_funding).select("instrument_id", "seq", F.round("velocity", 5).alias("velocity"))


DOC = "b AS (SELECT *, (index_price - mark_price) / mark_price * 1e4 AS b FROM mark_funding)"


def basis_doc(v):
    return v.mark_funding.withColumn("b", (F.col("index_price") - F.col("mark_price")) / F.col("mark_price") * 1e4)


@query("m_basis_doc", f"{DOC} SELECT instrument_id, seq, round(b, 6) AS basis FROM b")
def m_basis_doc(v):
    return basis_doc(v).select("instrument_id", "seq", R6("b").alias("basis"))


BREF = "LEFT JOIN LATERAL (SELECT p.{c} AS v, p.ts_ms AS t FROM {t} p WHERE p.instrument_id = x.instrument_id AND p.ts_ms <= x.ts_ms - 5000 AND p.ts_ms >= x.ts_ms - 20000 ORDER BY p.ts_ms DESC, p.seq DESC LIMIT 1) r ON true"


@query("m_basis_velocity_doc", f"{DOC} SELECT x.instrument_id, x.seq, round((x.b - r.v) / ((x.ts_ms - r.t) / 1000.0::DOUBLE), 5) AS slope FROM b x {BREF.format(c='b', t='b')}")
def m_basis_velocity_doc(v):
    return R.derivative(basis_doc(v), ["instrument_id"], "b", 5000, 20000).select("instrument_id", "seq", F.round("slope", 5).alias("slope"))


@query("m_basis_accel_doc", f"{DOC}, d AS (SELECT x.instrument_id, x.seq, x.ts_ms, (x.b - r.v) / ((x.ts_ms - r.t) / 1000.0::DOUBLE) AS s FROM b x {BREF.format(c='b', t='b')}) SELECT x.instrument_id, x.seq, round((x.s - r.v) / ((x.ts_ms - r.t) / 1000.0::DOUBLE), 5) AS accel FROM d x {BREF.format(c='s', t='d')}")
def m_basis_accel_doc(v):
    return R.second_derivative(basis_doc(v), ["instrument_id"], "b", 5000, 20000).select("instrument_id", "seq", F.round("accel", 5).alias("accel"))


@query("m_dep_refill", """
s AS (SELECT x.instrument_id, x.seq, x.side, (SELECT sum(qty) FROM depth p WHERE p.instrument_id = x.instrument_id AND p.side = x.side AND p.seq <= x.seq AND p.ts_ms >= x.ts_ms - 3000 AND action <> 'delete') AS ins,
             (SELECT sum(qty) FROM depth p WHERE p.instrument_id = x.instrument_id AND p.side = x.side AND p.seq <= x.seq AND p.ts_ms >= x.ts_ms - 3000 AND action = 'delete') AS del FROM depth x)
SELECT instrument_id, seq, side, round(coalesce(del, 0) / nullif(coalesce(ins, 0) + coalesce(del, 0), 0), 6) AS dep, round(least(coalesce(ins, 0) / nullif(del, 0), 1), 6) AS refill FROM s""")
def m_dep_refill(v):
    key = ["instrument_id", "side"]
    rows = trailing_sum(v.depth, key, F.when(F.col("action") != "delete", F.col("qty")), 3000, "ins")
    rows = trailing_sum(rows, key, F.when(F.col("action") == "delete", F.col("qty")), 3000, "del")
    return rows.select("instrument_id", "seq", "side", R6(F.try_divide(F.col("del"), F.col("ins") + F.col("del"))).alias("dep"), R6(F.least(F.try_divide(F.col("ins"), F.col("del")), F.lit(1.0))).alias("refill"))


@query("m_oi_delta_pct", "SELECT x.instrument_id, x.seq, round((x.open_interest - r.v) / nullif(r.v, 0) * 100, 6) AS pct FROM open_interest x LEFT JOIN LATERAL (SELECT p.open_interest AS v FROM open_interest p WHERE p.instrument_id = x.instrument_id AND p.ts_ms <= x.ts_ms - 60000 ORDER BY p.ts_ms DESC, p.seq DESC LIMIT 1) r ON true")
def m_oi_delta_pct(v):
    return R.percent_change(v.open_interest, ["instrument_id"], "open_interest", 60_000).select("instrument_id", "seq", R6("pct").alias("pct"))


# The whole snapshot: a row per instrument and instant with all metrics, documented forms beside the others.
SNAP = f"""{BOOK_1S},
mb AS (SELECT instrument_id, ts_ms, seq, (mark_price / index_price - 1) * 1e4 AS b, (index_price - mark_price) / mark_price * 1e4 AS d FROM mark_funding),
mv AS (SELECT *, (b - lag(b) OVER w) / greatest((ts_ms - lag(ts_ms) OVER w) / 1000.0::DOUBLE, 1e-6) AS vel FROM mb WINDOW w AS (PARTITION BY instrument_id ORDER BY ts_ms, seq)),
md AS (SELECT x.*, (x.d - r.v) / ((x.ts_ms - r.t) / 1000.0::DOUBLE) AS s FROM mv x {BREF.format(c='d', t='mb')}),
ma AS (SELECT x.*, (x.s - r.v) / ((x.ts_ms - r.t) / 1000.0::DOUBLE) AS a FROM md x {BREF.format(c='s', t='md')}),
fl AS (SELECT instrument_id, instant, coalesce(sum(qty) FILTER (WHERE side = 'buy' AND action <> 'delete'), 0) AS ib, coalesce(sum(qty) FILTER (WHERE side = 'buy' AND action = 'delete'), 0) AS db,
              coalesce(sum(qty) FILTER (WHERE side = 'sell' AND action <> 'delete'), 0) AS ia, coalesce(sum(qty) FILTER (WHERE side = 'sell' AND action = 'delete'), 0) AS da FROM g JOIN depth USING (instrument_id) WHERE ts_ms <= instant AND ts_ms >= instant - 3000 GROUP BY ALL),
s0 AS (SELECT *, bid_vol + ask_vol AS vol, bid_levels / nullif(bid_levels + ask_levels, 0)::DOUBLE AS lev FROM b),
s1 AS (SELECT *, (bid_vol - ask_vol) / nullif(vol, 0) AS imb, avg((bid_vol - ask_vol) / nullif(vol, 0)) OVER w AS imb_doc, avg(bid_vol / nullif(vol, 0)) OVER w AS dom_doc FROM s0 WINDOW w AS (PARTITION BY instrument_id ORDER BY instant RANGE BETWEEN 5000 PRECEDING AND CURRENT ROW)),
s2 AS (SELECT x.*, CASE WHEN p.instant >= x.instant - 9000 THEN x.bid_vol - p.bid_vol END AS dv_bid, CASE WHEN p.instant >= x.instant - 9000 THEN x.ask_vol - p.ask_vol END AS dv_ask FROM s1 x ASOF LEFT JOIN b p ON p.instrument_id = x.instrument_id AND p.instant <= x.instant - 3000),
s3 AS (SELECT s2.*, ma.b AS basis, ma.vel, ma.d AS basis_d, ma.s AS vel_d, ma.a AS acc_d FROM s2 ASOF LEFT JOIN ma ON ma.instrument_id = s2.instrument_id AND ma.ts_ms <= s2.instant),
sn AS (SELECT s3.instrument_id, s3.instant, s3.instant AS ts_ms, s3.instant AS seq, best_bid, best_ask, greatest(best_ask - best_bid, 0) AS spread_usd, basis AS basis_bps, vel AS basis_vel_bps_s, basis_d AS basis_bps_doc, vel_d AS basis_vel_bps_s_doc, acc_d AS basis_accel_bps_s2_doc,
              lev AS dom_bid, 1 - lev AS dom_ask, dom_doc AS dominance_bid_doc, 1 - dom_doc AS dominance_ask_doc, imb AS imbalance, imb_doc AS imbalance_doc, coalesce(db, 0) / nullif(coalesce(ib, 0) + coalesce(db, 0), 0) AS dep_bid, coalesce(da, 0) / nullif(coalesce(ia, 0) + coalesce(da, 0), 0) AS dep_ask,
              dv_bid AS depletion_bid_doc, dv_ask AS depletion_ask_doc, least(ib / nullif(db, 0), 1) AS refill_bid_3s, least(ia / nullif(da, 0), 1) AS refill_ask_3s, (best_ask + best_bid) / 2 AS wmid FROM s3 LEFT JOIN fl USING (instrument_id, instant))"""
#: The metrics that are kept as a series, and the window of each in seconds.
SERIES = {
    "spread_usd": 1, "basis_bps": 1, "basis_vel_bps_s": 1, "basis_bps_doc": 5, "basis_vel_bps_s_doc": 5, "basis_accel_bps_s2_doc": 5, "dom_bid": 1, "dom_ask": 1, "dominance_bid_doc": 5, "dominance_ask_doc": 5, "imbalance": 1, "imbalance_doc": 5,
    "dep_bid": 1, "dep_ask": 1, "depletion_bid_doc": 3, "depletion_ask_doc": 3, "refill_bid_3s": 1, "refill_ask_3s": 1, "wmid": 1,
}


def snapshots(v):
    key = ["instrument_id"]
    marks = X.basis_velocity(basis_doc(v))
    marks = R.second_derivative(marks, key, "b", 5000, 20000)
    marks = marks.select("instrument_id", "ts_ms", "seq", F.struct("basis", "velocity", "b", "slope", "accel").alias("m"))
    rows = asof_join(timed(book_1s(v)), marks, key, F.col("m"), "m")
    rows = bucketed(rows, 9_000)
    here = Window.partitionBy("instrument_id", "_bucket").orderBy("ts_ms")
    near, before = here.rangeBetween(-5_000, 0), here.rangeBetween(-9_000, -3_000)
    rows = unbucketed(rows.withColumns({"imbalance_doc": F.avg("imbalance").over(near), "dominance_bid_doc": F.avg("dominance_bid").over(near), "_was": F.max(F.struct("ts_ms", "bid_vol", "ask_vol")).over(before)}))
    # Each delta serves the instants up to 3 s after it.
    first, last = F.ceil(F.col("ts_ms") / SECOND) * SECOND, F.floor((F.col("ts_ms") + 3000) / SECOND) * SECOND
    gone = F.when(F.col("action") == "delete", F.col("qty")).otherwise(0.0)
    came = F.when(F.col("action") != "delete", F.col("qty")).otherwise(0.0)
    sums = [F.sum(F.when(F.col("side") == side, c).otherwise(0.0)).alias(f"{name}_{end}") for side, end in (("buy", "bid"), ("sell", "ask")) for c, name in ((came, "in"), (gone, "out"))]
    flow = v.depth.withColumn("instant", F.explode(F.sequence(first, last, F.lit(SECOND).cast("long")))).groupBy("instrument_id", "instant").agg(*sums)
    rows = rows.join(flow, ["instrument_id", "instant"], "left")
    both = {f"dep_{e}": F.try_divide(f"out_{e}", F.col(f"in_{e}") + F.col(f"out_{e}")) for e in ("bid", "ask")} | {f"refill_{e}_3s": F.least(F.try_divide(f"in_{e}", f"out_{e}"), F.lit(1.0)) for e in ("bid", "ask")}
    named = {
        "spread_usd": F.col("spread"), "basis_bps": F.col("m.basis"), "basis_vel_bps_s": F.col("m.velocity"), "basis_bps_doc": F.col("m.b"), "basis_vel_bps_s_doc": F.col("m.slope"), "basis_accel_bps_s2_doc": F.col("m.accel"),
        "dom_bid": F.col("level_share_bid"), "dom_ask": 1 - F.col("level_share_bid"), "dominance_ask_doc": 1 - F.col("dominance_bid_doc"), "depletion_bid_doc": F.col("bid_vol") - F.col("_was.bid_vol"), "depletion_ask_doc": F.col("ask_vol") - F.col("_was.ask_vol"),
    }
    return rows.withColumns(both | named).select("instrument_id", "instant", "ts_ms", "seq", "best_bid", "best_ask", *SERIES)


@query("metrics_unpivot", f"{SNAP}, u AS (UNPIVOT (SELECT instrument_id, instant, {', '.join(SERIES)} FROM sn) ON {', '.join(SERIES)} INTO NAME metric VALUE value) SELECT instrument_id, instant, metric, CASE WHEN metric LIKE 'depletion%' THEN 3 WHEN metric LIKE '%_doc' THEN 5 ELSE 1 END AS window_s, round(value, 4) AS value FROM u")
def metrics_unpivot(v):
    long = snapshots(v).unpivot(["instrument_id", "instant"], list(SERIES), "metric", "value")
    window = F.create_map(*(F.lit(x) for pair in SERIES.items() for x in pair))[F.col("metric")]
    return R.clean(long, "value").select("instrument_id", "instant", "metric", window.alias("window_s"), F.round("value", 4).alias("value"))
