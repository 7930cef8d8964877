"""Detectors on trades, depth and book samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import exprs as X
from tidewatch.operators import detect as D
from tidewatch.operators.blocks import held, run_ids
from tidewatch.operators.book import with_best

from . import books
from .registry import query

R6 = lambda c: F.round(c, 6)


def runs_sql(table: str, gap: int, equal: bool = False) -> str:
    moved = f"coalesce(side <> lag(side) OVER o OR price <> lag(price) OVER o OR ts_ms - lag(ts_ms) OVER o > {gap}, true)"
    odd = "coalesce(qty <> lag(qty) OVER o, false)" if equal else "false"
    return f"""
r0 AS (SELECT *, {moved} AS moved, {odd} AS uneq FROM {table} WINDOW o AS (PARTITION BY instrument_id ORDER BY ts_ms, seq)),
r1 AS (SELECT *, uneq AND NOT moved AS odd, sum((moved OR uneq)::INT) OVER (PARTITION BY instrument_id ORDER BY ts_ms, seq) AS run FROM r0),
r2 AS (SELECT *, count(*) OVER i AS k, sum(qty) OVER i AS volume FROM r1 WINDOW i AS (PARTITION BY instrument_id, run ORDER BY ts_ms, seq))"""


def cooled_sql(source: str, keys: str, ms: int, out: str = "fired") -> str:
    """Candidates that fire, by a recursion over the candidates of each key."""
    on = " AND ".join(f"c.{k} = f.{k}" for k in keys.split(", "))
    return f"""
cn AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts_ms, seq) AS rn FROM {source}),
rf AS (SELECT {keys}, rn, ts_ms AS last, true AS hit FROM cn WHERE rn = 1 UNION ALL
       SELECT {', '.join('c.' + k for k in keys.split(', '))}, c.rn, CASE WHEN c.ts_ms - f.last >= {ms} THEN c.ts_ms ELSE f.last END, c.ts_ms - f.last >= {ms} FROM rf f JOIN cn c ON {on} AND c.rn = f.rn + 1),
{out} AS (SELECT cn.* FROM cn JOIN rf USING ({keys}, rn) WHERE hit)"""



@query("det_slicing_hitting", f"{runs_sql('trades', 800)} SELECT instrument_id, seq, side, round(price, 6) AS price, k, volume AS intensity, CASE WHEN volume >= 10 THEN 'HIGH' WHEN volume >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN side = 'buy' THEN 'R5' ELSE 'R6' END AS rule FROM r2 WHERE k >= 5 AND volume >= 10")
def det_slicing_hitting(v):
    from tidewatch.operators.rules import rated

    got = D.slicing(v.trades, 800, 5, 10.0)
    return rated(got).select("instrument_id", "seq", "side", R6("price").alias("price"), "k", "intensity", "severity", "rule")


@query("det_slicing_iceberg", f"{runs_sql('trades', 2000, True)} SELECT instrument_id, seq, side, k, volume AS intensity FROM r2 WHERE k >= 2 AND volume >= 2 AND NOT odd")
def det_slicing_iceberg(v):
    return D.slicing(v.trades, 2000, 2, 2.0, equal=True, mode="iceberg").select("instrument_id", "seq", "side", "k", "intensity")


@query("det_slicing_passive", f"dp AS (SELECT * FROM depth WHERE action = 'insert' AND qty > 0), {runs_sql('dp', 2000)} SELECT instrument_id, seq, side, k, volume AS intensity FROM r2 WHERE k >= 2 AND volume >= 5")
def det_slicing_passive(v):
    return D.slicing_passive(v.depth, 2000, 2, 5.0).select("instrument_id", "seq", "side", "k", "intensity")


ABSORB = """
rw AS (SELECT t.*, b.best_bid, b.best_ask, CASE WHEN side = 'buy' THEN best_ask ELSE best_bid END AS passive FROM trades t ASOF LEFT JOIN b ON b.instrument_id = t.instrument_id AND b.instant <= t.ts_ms),
pv AS (SELECT *, last_value(CASE WHEN side = 'buy' THEN ts_ms END IGNORE NULLS) OVER w AS pb, last_value(CASE WHEN side = 'sell' THEN ts_ms END IGNORE NULLS) OVER w AS ps FROM rw WINDOW w AS (PARTITION BY instrument_id ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sx AS (SELECT *, CASE WHEN side = 'buy' THEN pb ELSE ps END AS own, CASE WHEN side = 'buy' THEN ps ELSE pb END AS opp FROM pv),
an AS (SELECT *, last_value(CASE WHEN own IS NULL OR opp > own + 3000 THEN {'p': passive} END IGNORE NULLS) OVER (PARTITION BY instrument_id, side ORDER BY ts_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor,
              (SELECT sum(qty) FROM trades q WHERE q.instrument_id = sx.instrument_id AND q.side = sx.side AND q.seq <= sx.seq AND q.ts_ms >= sx.ts_ms - 3000) AS volume FROM sx)"""


@query("det_absorption", f"{books.BOOK_TRADED}, {ABSORB} SELECT instrument_id, seq, side, volume AS intensity FROM an WHERE volume >= 5 AND abs(passive - anchor.p) <= 0.2 + 1e-9")
def det_absorption(v):
    best = books.timed(books.B.summary(v.depth, None, 1, books.B.instants(v.trades))).select("instrument_id", "ts_ms", "seq", "best_bid", "best_ask")
    return D.absorption(v.trades, best, 3_000, 5.0, 0.2).select("instrument_id", "seq", "side", "intensity")


BREAK = f"""
{books.SNAP}, {runs_sql('trades', 800)},
sl AS (SELECT * FROM r2 WHERE k >= 3 AND volume >= 5),
w1 AS (SELECT *, sum(coalesce(side <> pside, true)::INT) OVER (PARTITION BY instrument_id ORDER BY ts_ms, seq) AS streak FROM (SELECT *, lag(side) OVER (PARTITION BY instrument_id ORDER BY ts_ms, seq) AS pside FROM sl)),
w2 AS (SELECT *, count(*) OVER (PARTITION BY instrument_id, streak ORDER BY ts_ms, seq) AS n FROM w1),
w3 AS (SELECT w2.instrument_id, w2.ts_ms, w2.seq, w2.side, w2.price, w2.volume, w2.n, sn.* EXCLUDE (instrument_id, instant, ts_ms, seq) FROM w2 ASOF LEFT JOIN sn ON sn.instrument_id = w2.instrument_id AND sn.ts_ms <= w2.ts_ms),
w4 AS (SELECT *, coalesce(basis_vel_bps_s_doc, basis_vel_bps_s) AS auto_vel, CASE WHEN basis_vel_bps_s_doc IS NULL AND basis_vel_bps_s IS NOT NULL THEN 'legacy' ELSE 'doc' END AS auto_source, CASE WHEN side = 'buy' THEN depletion_ask_doc ELSE depletion_bid_doc END AS dv,
              coalesce(CASE WHEN side = 'buy' THEN dep_ask ELSE dep_bid END, 0) AS dep, coalesce(CASE WHEN side = 'buy' THEN refill_ask_3s ELSE refill_bid_3s END, 0) AS refill, abs(price - CASE WHEN side = 'buy' THEN best_ask ELSE best_bid END) / 0.1 AS far FROM w3)"""


def gate_sql(source: str, speed: float, share: float, refill: float, warn: float, most: float, ticks: float) -> str:
    """The gate of each slicing event: 'pass', a reason, or null."""
    vel = {"legacy": "basis_vel_bps_s", "doc": "basis_vel_bps_s_doc", "auto": "auto_vel"}[source]
    used = {"legacy": "'legacy'", "doc": "'doc'", "auto": "auto_source"}[source]
    plain = f"CASE WHEN dep < {share} THEN 'dep_low' WHEN refill >= {refill} THEN 'refill_high' ELSE 'pass' END"
    return f"""bw AS (SELECT *, {vel} AS vel, CASE WHEN n < 3 OR {vel} IS NULL THEN NULL WHEN abs({vel}) < {speed} THEN 'basis_vel_low' WHEN far > {ticks} THEN 'top_levels_gate' WHEN {used} = 'legacy' THEN {plain}
        WHEN dv IS NULL THEN {plain if source == 'auto' else 'NULL'} WHEN dv >= 0 THEN 'no_depletion' WHEN least(-dv, 300) < {warn} THEN 'dep_low' ELSE 'pass' END AS verdict FROM w4)"""


GATES = {"legacy": (20.0, 0.3, 0.95, 8.0, 10.0, 8.0), "doc": (1.0, 0.3, 0.95, 8.0, 10.0, 8.0), "auto": (2.0, 0.3, 0.95, 8.0, 10.0, 8.0)}


def break_rows(v, source):
    speed, share, refill, warn, most, ticks = GATES[source]
    return D.break_wall(D.slicing(v.trades, 800, 3, 5.0), books.snapshots(v), 3, speed, source, share, refill, warn, most, ticks=ticks)


def _break_query(name, source):
    @query(name, f"{BREAK}, {gate_sql(source, *GATES[source])} SELECT instrument_id, seq, side, n, verdict IS NOT NULL AND verdict = 'pass' AS fired, nullif(verdict, 'pass') AS gate FROM bw")
    def run(v):
        return break_rows(v, source).select("instrument_id", "seq", "side", "n", "fired", "gate")


_break_query("det_break_wall", "auto")
_break_query("det_break_wall_doc", "doc")
_break_query("det_break_wall_legacy", "legacy")


@query("audit_breakwall_from_raw", f"{BREAK}, {gate_sql('auto', *GATES['auto'])} SELECT instrument_id, seq, side, CASE WHEN side = 'buy' THEN 'R1' ELSE 'R2' END AS expected_rule FROM bw WHERE verdict = 'pass' AND (side = 'buy' AND vel > 0 OR side = 'sell' AND vel < 0)")
def audit_breakwall_from_raw(v):
    from tidewatch.operators.rules import rated

    fired = break_rows(v, "auto").where("fired")
    return rated(fired).select("instrument_id", "seq", "side", F.col("rule").alias("expected_rule"))


DOM = f"""{books.SNAP}, tight AS (SELECT * FROM sn WHERE spread_usd <= 2.0),
dd AS (SELECT instrument_id, ts_ms, seq, CASE WHEN dominance_bid_doc >= 0.6 THEN 'buy' ELSE 'sell' END AS side, 'doc' AS metric_source, 100 * greatest(dominance_bid_doc, dominance_ask_doc) AS x FROM tight WHERE dominance_bid_doc >= 0.6 OR dominance_ask_doc >= 0.6),
d0 AS (SELECT instrument_id, ts_ms, seq, CASE WHEN dom_bid >= 0.55 THEN 'buy' ELSE 'sell' END AS side, 100 * greatest(dom_bid, dom_ask) AS x FROM tight t WHERE (dom_bid >= 0.55 OR dom_ask >= 0.55) AND {{rest}}),
d1 AS (SELECT *, coalesce(side <> lag(side) OVER (PARTITION BY instrument_id ORDER BY ts_ms), true) AS turn FROM d0),
cand AS (SELECT *, sum(turn::INT) OVER (PARTITION BY instrument_id ORDER BY ts_ms) AS run FROM d1), {cooled_sql('cand', 'instrument_id, run', 3000)}"""
LEVEL_FORM = "SELECT instrument_id, ts_ms, side, 'legacy' AS metric_source, round(x, 6) AS intensity FROM fired"


def _dominance(v, source):
    return D.dominance(books.snapshots(v), source, 0.6, 0.55, 2.0, 3000).select("instrument_id", "ts_ms", "side", "metric_source", R6("intensity").alias("intensity"))


@query("det_dominance", f"{DOM.format(rest='NOT EXISTS (SELECT 1 FROM dd WHERE dd.instrument_id = t.instrument_id AND dd.ts_ms = t.ts_ms)')} SELECT instrument_id, ts_ms, side, metric_source, round(x, 6) AS intensity FROM dd UNION ALL {LEVEL_FORM}")
def det_dominance(v):
    return _dominance(v, "auto")


@query("det_dominance_levels", f"{DOM.format(rest='true')} {LEVEL_FORM}")
def det_dominance_levels(v):
    return _dominance(v, "legacy")


TAPE = """
tp AS (SELECT x.*, (SELECT sum(CASE WHEN p.side = 'buy' THEN qty ELSE 0 END) / sum(qty) FROM trades p WHERE p.instrument_id = x.instrument_id AND p.seq <= x.seq AND p.ts_ms >= x.ts_ms - 3000) AS ratio FROM trades x),
cand AS (SELECT instrument_id, ts_ms, seq, ratio FROM tp WHERE ratio >= 0.8 OR ratio <= 0.2)"""


@query("det_tape_pressure", f"{TAPE}, {cooled_sql('cand', 'instrument_id', 20000)} SELECT instrument_id, seq, CASE WHEN ratio >= 0.8 THEN 'buy' ELSE 'sell' END AS side, round(ratio, 6) AS intensity FROM fired")
def det_tape_pressure(v):
    return D.tape_pressure(v.trades, 3000, 0.8, 0.2, 20_000).select("instrument_id", "seq", "side", R6("intensity").alias("intensity"))


REVERT = """
bv AS (SELECT instrument_id, ts_ms, seq, b, (b - lag(b) OVER w) / greatest((ts_ms - lag(ts_ms) OVER w) / 1000.0::DOUBLE, 1e-6) AS vel FROM (SELECT *, (mark_price / index_price - 1) * 1e4 AS b FROM mark_funding) WINDOW w AS (PARTITION BY instrument_id ORDER BY ts_ms, seq)),
cand AS (SELECT * FROM (SELECT *, lag(vel) OVER (PARTITION BY instrument_id ORDER BY ts_ms, seq) AS was FROM bv) WHERE sign(vel) <> 0 AND sign(was) <> 0 AND sign(vel) <> sign(was) AND abs(b) <= 60 AND abs(vel) >= 1.5)"""


@query("det_basis_mean_revert", f"{REVERT}, {cooled_sql('cand', 'instrument_id', 60000)} SELECT instrument_id, seq, CASE WHEN vel > 0 THEN 'buy' ELSE 'sell' END AS side, round(vel, 5) AS intensity FROM fired")
def det_basis_mean_revert(v):
    return D.mean_revert(X.basis_velocity(v.mark_funding), 60.0, 1.5, 60_000).select("instrument_id", "seq", "side", F.round("intensity", 5).alias("intensity"))


def held_sql(source: str, condition: str, hold: int, cool: int, out: str = "fired") -> str:
    """Arm, hold, fire, by a recursion over the true samples of each instrument."""
    armed, cooling = "CASE WHEN c.run = f.run THEN f.armed END", f"coalesce(c.ts_ms - f.last < {cool}, false)"
    return f"""
h0 AS (SELECT *, coalesce({condition}, false) AS c FROM {source}),
h1 AS (SELECT *, coalesce(c <> lag(c) OVER o, true) AS brk FROM h0 WINDOW o AS (PARTITION BY instrument_id ORDER BY ts_ms, seq)),
h2 AS (SELECT *, sum(brk::INT) OVER (PARTITION BY instrument_id ORDER BY ts_ms, seq) AS run FROM h1),
hn AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_ms, seq) AS rn FROM h2 WHERE c),
hf AS (SELECT instrument_id, rn, run, ts_ms AS armed, NULL::BIGINT AS last, false AS hit FROM hn WHERE rn = 1 UNION ALL
       SELECT c.instrument_id, c.rn, c.run, CASE WHEN {cooling} THEN {armed} WHEN {armed} IS NULL THEN c.ts_ms WHEN c.ts_ms - {armed} >= {hold} THEN NULL ELSE {armed} END,
              CASE WHEN NOT {cooling} AND coalesce(c.ts_ms - {armed} >= {hold}, false) THEN c.ts_ms ELSE f.last END, NOT {cooling} AND coalesce(c.ts_ms - {armed} >= {hold}, false)
       FROM hf f JOIN hn c ON c.instrument_id = f.instrument_id AND c.rn = f.rn + 1),
{out} AS (SELECT hn.* FROM hn JOIN hf USING (instrument_id, rn) WHERE hit)"""


def _trigger(name, metric, threshold, above, source="legacy", doc=None, flip=True):
    value = {"legacy": metric, "doc": f"{'-' if flip else ''}{doc or metric}", "auto": f"coalesce({'-' if flip else ''}{doc or metric}, {metric})"}[source]
    sign = ">=" if above else "<="

    @query(name, f"{books.SNAP}, ms AS (SELECT *, {value} AS mv FROM sn), {held_sql('ms', f'mv {sign} {threshold}', 1500, 30000)} SELECT instrument_id, ts_ms, round(mv, 5) AS intensity FROM fired")
    def run(v):
        got = D.metric_trigger(books.snapshots(v), metric, threshold, above, 1500, 30_000, source, doc, flip)
        return got.select("instrument_id", "ts_ms", F.round("intensity", 5).alias("intensity"))


_trigger("det_metric_trigger", "basis_bps", 20.0, True, "auto", "basis_bps_doc")
_trigger("det_metric_trigger_doc", "basis_bps", -20.0, False, "doc", "basis_bps_doc")
_trigger("det_basis_extreme", "basis_bps", -50.0, False)


def depl_sql(side: str, source: str, mode: str = "linear") -> str:
    """Either form of a side's depletion with hold 1 s and cooldown 30 s."""
    end = "bid" if side == "buy" else "ask"
    used = {"legacy": "'legacy'", "doc": "'doc'", "auto": f"CASE WHEN depletion_{end}_doc IS NULL THEN 'legacy' ELSE 'doc' END"}[source]
    degree = "(amount - 5) / 45" if mode == "linear" else "ln(1 + amount / 5) / ln(1 + 50 / 5)"
    rows = f"dp AS (SELECT *, {used} AS used, least(greatest(-depletion_{end}_doc, 0), 200) AS amount, dep_{end} AS dep FROM sn)"
    condition = "CASE WHEN used = 'doc' THEN amount >= 5 ELSE dep >= 0.4 END"
    return f"{books.SNAP}, {rows}, {held_sql('dp', condition, 1000, 30000)} SELECT instrument_id, ts_ms, '{side}' AS side, used AS metric_source, round(CASE WHEN used = 'doc' THEN least(greatest({degree}, 0), 1) ELSE dep END, 6) AS intensity FROM fired"


def _depletion(name, side, source, mode="linear"):
    @query(name, depl_sql(side, source, mode))
    def run(v):
        got = D.depletion(books.snapshots(v), side, source, 0.4, 5.0, 50.0, 200.0, 1000, 30_000, mode)
        return got.select("instrument_id", "ts_ms", "side", "metric_source", R6("intensity").alias("intensity"))


_depletion("det_depletion", "buy", "auto")
_depletion("det_depletion_ask", "sell", "doc", "log")
_depletion("det_depletion_legacy", "buy", "legacy")

DEPL = f"""{books.SNAP}, dd AS (SELECT least(greatest(-depletion_bid_doc, 0), 200) AS amount FROM sn)"""


@query("calib_depletion", f"{DEPL}, x AS (SELECT amount AS x FROM dd WHERE amount > 0) SELECT round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99, count(*) AS n FROM x")
def calib_depletion(v):
    from tidewatch.operators.calibrate import percentiles

    amount = F.least(F.greatest(-F.col("depletion_bid_doc"), F.lit(0.0)), F.lit(200.0))
    return percentiles(books.snapshots(v).where(amount > 0), amount)


@query("det_spread_squeeze", f"{books.BOOK_1S}, sq AS (SELECT *, instant AS ts_ms, instant AS seq FROM b), {held_sql('sq', 'greatest(best_ask - best_bid, 0) <= 0.5 AND bid_vol >= 20 AND ask_vol >= 20', 1500, 30000)} SELECT instrument_id, ts_ms FROM fired")
def det_spread_squeeze(v):
    tight = (F.col("spread") <= 0.5) & (F.col("bid_vol") >= 20) & (F.col("ask_vol") >= 20)
    return held(books.timed(books.book_1s(v)), ["instrument_id"], tight, 1500, 30_000).select("instrument_id", "ts_ms")


SPOOF = f"""{books.LEVELS},
big AS (SELECT * FROM depth WHERE action = 'insert' AND qty >= 5),
bb AS (SELECT x.instrument_id, x.seq, max(lv.price) FILTER (WHERE lv.side = 'buy') AS bid, min(lv.price) FILTER (WHERE lv.side = 'sell') AS ask FROM big x JOIN lv ON lv.instrument_id = x.instrument_id AND lv.seq <= x.seq AND (lv.to_seq IS NULL OR lv.to_seq > x.seq) WHERE lv.level_qty > 0 GROUP BY ALL),
so AS (SELECT d.*, coalesce(floor(round(abs(d.price - CASE WHEN d.side = 'buy' THEN bid ELSE ask END) / 0.1, 6)), 0)::BIGINT AS away FROM depth d LEFT JOIN bb USING (instrument_id, seq)),
sp AS (SELECT *, (action = 'insert' AND qty >= 5 AND away >= 3) AS o FROM so),
se AS (SELECT * FROM (SELECT *, sum(o::INT) OVER (PARTITION BY instrument_id, side, price ORDER BY ts_ms, seq) AS episode FROM sp) WHERE episode > 0),
st AS (SELECT *, min(ts_ms) OVER e AS t0, first_value(qty) OVER (PARTITION BY instrument_id, side, price, episode ORDER BY ts_ms, seq) AS wall, first_value(away) OVER (PARTITION BY instrument_id, side, price, episode ORDER BY ts_ms, seq) AS ticks FROM se WINDOW e AS (PARTITION BY instrument_id, side, price, episode)),
sc AS (SELECT *, min(seq) FILTER (WHERE ts_ms - t0 > 4000) OVER e AS s1, min(ts_ms) FILTER (WHERE ts_ms - t0 > 4000) OVER e AS t1 FROM st WINDOW e AS (PARTITION BY instrument_id, side, price, episode)),
sw AS (SELECT instrument_id, side, price, episode, t0, t1, wall, ticks, sum(CASE WHEN action = 'delete' THEN qty ELSE 0 END) AS cancelled FROM sc WHERE seq <= s1 GROUP BY ALL),
sz AS (SELECT *, cancelled / (wall + cancelled) AS rate, coalesce((SELECT sum(t.qty) FROM trades t WHERE t.instrument_id = sw.instrument_id AND t.ts_ms BETWEEN sw.t0 AND sw.t1 AND abs(t.price - sw.price) <= 0.15 + 1e-9), 0) AS executed FROM sw)"""


def spoof_rows(v, most_executed=5.0):
    big = v.depth.where("action = 'insert' and qty >= 5")
    best = with_best(v.depth, big).select("instrument_id", "ts_ms", "seq", "best_bid", "best_ask")
    return D.spoofing(v.depth.join(best, ["instrument_id", "ts_ms", "seq"], "left"), v.trades, 5.0, 3, 4000, 0.3, most_executed, 0.1)


@query("det_spoofing", f"{SPOOF} SELECT instrument_id, t1 AS ts_ms, side, round(price, 6) AS price, wall AS intensity, ticks AS distance_ticks, round(rate, 6) AS cancel_rate, executed FROM sz WHERE rate >= 0.3 AND executed <= 5")
def det_spoofing(v):
    return spoof_rows(v).select("instrument_id", "ts_ms", "side", R6("price").alias("price"), "intensity", "distance_ticks", R6("cancel_rate").alias("cancel_rate"), "executed")


@query("near_price_join", f"{SPOOF} SELECT instrument_id, t1 AS ts_ms, side, round(price, 6) AS price, executed FROM sz WHERE rate >= 0.3 AND executed <= 1e9")
def near_price_join(v):
    return spoof_rows(v, 1e9).select("instrument_id", "ts_ms", "side", R6("price").alias("price"), "executed")


from .aggregates import OI_RUN  # noqa: E402


@query("det_oi_skew", f"{OI_RUN}, cand AS (SELECT * REPLACE (row_number() OVER (PARTITION BY underlying ORDER BY ts_ms, seq, seq2, instrument_id, open_interest) AS seq), CASE WHEN calls >= 1.1 * puts THEN 'bull' ELSE 'bear' END AS turn FROM o WHERE calls > 0 AND puts > 0 AND (calls >= 1.1 * puts OR puts >= 1.1 * calls) AND calls + puts >= 100), {cooled_sql('cand', 'underlying, turn', 60000)} SELECT underlying, ts_ms, 'oi_skew_' || turn AS kind, round(greatest(calls, puts) / least(calls, puts), 6) AS intensity FROM fired")
def det_oi_skew(v):
    seen = X.running_oi(X.with_instruments(v.options_ticker, v.options_instruments)).withColumn("seq", F.col("nth"))
    return D.oi_skew(seen, 1.1, 100.0, 60_000).select("underlying", "ts_ms", "kind", R6("intensity").alias("intensity"))


IV_TICKS = """
it AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_ms, seq, seq2) AS rn FROM options_ticker WHERE mark_iv > 0),
ir AS (SELECT instrument_id, rn, ts_ms, seq, mark_iv AS base, ts_ms AS since, NULL::BIGINT AS up, NULL::BIGINT AS down, NULL::VARCHAR AS hit, NULL::DOUBLE AS move FROM it WHERE rn = 1 UNION ALL
       SELECT instrument_id, rn, ts_ms, seq, CASE WHEN old OR hit IS NOT NULL OR turn IS NULL AND abs(mv) < 10 THEN iv ELSE base END, CASE WHEN old OR hit IS NOT NULL OR turn IS NULL AND abs(mv) < 10 THEN ts_ms ELSE since END,
              CASE WHEN hit = 'up' THEN ts_ms ELSE up END, CASE WHEN hit = 'down' THEN ts_ms ELSE down END, hit, mv
       FROM (SELECT *, CASE WHEN NOT old AND turn = 'up' AND (up IS NULL OR ts_ms - up >= 60000) OR NOT old AND turn = 'down' AND (down IS NULL OR ts_ms - down >= 60000) THEN turn END AS hit
             FROM (SELECT *, CASE WHEN mv >= 20 THEN 'up' WHEN mv <= -20 THEN 'down' END AS turn
                   FROM (SELECT c.instrument_id, c.rn, c.ts_ms, c.seq, c.mark_iv AS iv, f.base, f.since, f.up, f.down, c.ts_ms - f.since > 600000 AS old, (c.mark_iv / f.base - 1) * 100 AS mv FROM ir f JOIN it c ON c.instrument_id = f.instrument_id AND c.rn = f.rn + 1))))"""


@query("det_iv_spike_tick", f"{IV_TICKS} SELECT instrument_id, ts_ms, seq, 'iv_spike_' || hit AS kind, round(move, 6) AS intensity FROM ir WHERE hit IS NOT NULL")
def det_iv_spike_tick(v):
    return D.iv_spike_ticks(v.options_ticker, 20.0, -20.0, 600_000, 60_000).select("instrument_id", "ts_ms", "seq", "kind", R6("intensity").alias("intensity"))


# Audits: the same runs, a row each.
@query("audit_slicing_blocks", f"{runs_sql('trades', 100000000)} SELECT instrument_id, side, min(seq) AS first_seq, count(*) AS k, sum(qty) AS volume FROM r2 GROUP BY instrument_id, run, side HAVING count(*) >= 5 AND sum(qty) >= 5")
def audit_slicing_blocks(v):
    return _blocks(D.slicing(v.trades, 100_000_000, 1, 0.0), 5, 5.0)


@query("audit_slicing_blocks_iceberg", f"{runs_sql('trades', 100000000, True)} SELECT instrument_id, side, min(seq) AS first_seq, count(*) AS k, sum(qty) AS volume FROM r2 GROUP BY instrument_id, run, side HAVING count(*) >= 3 AND sum(qty) >= 3")
def audit_slicing_blocks_iceberg(v):
    changed = lambda was, now: (now["side"] != was["side"]) | (now["price"] != was["price"]) | (now["qty"] != was["qty"])
    return _blocks(run_ids(v.trades, ["instrument_id"], ["side", "price", "qty"], changed), 3, 3.0)


def _blocks(rows, k, volume):
    got = rows.groupBy("instrument_id", "run", "side").agg(F.min("seq").alias("first_seq"), F.count("*").alias("k"), F.sum("qty").alias("volume"))
    return got.where((F.col("k") >= k) & (F.col("volume") >= volume)).drop("run")


@query("audit_slicing_passive_blocks", f"dp AS (SELECT * FROM depth WHERE action = 'insert' AND qty > 0), {runs_sql('dp', 2000)} SELECT instrument_id, side, min(seq) AS first_seq, count(*) AS k, sum(qty) AS volume FROM r2 GROUP BY instrument_id, run, side HAVING count(*) >= 2 AND sum(qty) >= 5 ORDER BY first_seq LIMIT 100")
def audit_slicing_passive_blocks(v):
    return _blocks(D.slicing_passive(v.depth, 2000, 1, 0.0), 2, 5.0).orderBy("first_seq").limit(100)


@query("audit_slicing_by_second", "SELECT instrument_id, ts_ms // 1000 AS sec, side, round(price, 6) AS price, count(*) AS k, sum(qty) AS volume FROM trades GROUP BY ALL")
def audit_slicing_by_second(v):
    return v.trades.groupBy("instrument_id", F.floor(F.col("ts_ms") / 1000).alias("sec"), "side", R6("price").alias("price")).agg(F.count("*").alias("k"), F.sum("qty").alias("volume"))


@query("audit_absorption_exact", "a AS (SELECT x.instrument_id, x.seq, x.side, (SELECT {'v': sum(qty), 'd': max(price) - min(price)} FROM trades p WHERE p.instrument_id = x.instrument_id AND p.side = x.side AND p.seq <= x.seq AND p.ts_ms >= x.ts_ms - 10000) AS r FROM trades x) SELECT instrument_id, seq, side, r.v AS vol_exec, round(r.d / 0.1, 4) AS price_drift_ticks FROM a WHERE r.v >= 20 AND r.d / 0.1 <= 2 + 1e-6")
def audit_absorption_exact(v):
    from tidewatch.operators.blocks import bucketed, trailing_sum, unbucketed

    rows = trailing_sum(v.trades, ["instrument_id", "side"], F.col("qty"), 10_000, "vol_exec")
    w = Window.partitionBy("instrument_id", "side", "_bucket").orderBy("ts_ms").rangeBetween(-10_000, 0)
    rows = unbucketed(bucketed(rows, 10_000).withColumn("drift", (F.max("price").over(w) - F.min("price").over(w)) / 0.1))
    return rows.where((F.col("vol_exec") >= 20) & (F.col("drift") <= 2 + 1e-6)).select("instrument_id", "seq", "side", "vol_exec", F.round("drift", 4).alias("price_drift_ticks"))


@query("audit_breakwall_snapshots", f"{books.BOOK_1S} SELECT instrument_id, instant, round(greatest(best_ask - best_bid, 0), 6) AS spread, bid_vol, ask_vol, round((bid_vol - ask_vol) / nullif(bid_vol + ask_vol, 0), 6) AS imbalance FROM b")
def audit_breakwall_snapshots(v):
    return books.book_1s(v).select("instrument_id", "instant", R6("spread").alias("spread"), "bid_vol", "ask_vol", R6("imbalance").alias("imbalance"))
