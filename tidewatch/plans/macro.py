"""Polled detectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import exprs as X
from tidewatch.operators import macro as M
from tidewatch.operators import rolling as R
from tidewatch.operators import surface as V
from tidewatch.operators.blocks import asof, asof_join

from . import aggregates as A
from . import books
from .detectors import cooled_sql
from .registry import query
from .surface_rows import BUILD, IV1M, JOINED, surface, ticks

R6 = lambda c: F.round(c, 6)
GRID = "g AS (SELECT instrument_id, unnest(range(0, (SELECT max(ts_ms) FROM ev), 30000)) AS ts_ms FROM (SELECT DISTINCT instrument_id FROM ev))"
LAT = "LEFT JOIN LATERAL (SELECT p.{c} AS v, p.ts_ms AS t FROM {t} p WHERE p.instrument_id = x.instrument_id AND p.ts_ms <= x.ts_ms - {w} ORDER BY p.ts_ms DESC, p.seq DESC LIMIT 1) {a} ON true"
SCALE = lambda x, a, b: f"least(greatest(({x} - {a}) / {b - a}, 0), 1)"


def grid(v):
    return X.poll_grid(v.ev, 30_000)


# The series of instrument 3 counts as missing, so that it takes the fallback: the mean change of the account ratios.
OI = f"{GRID}, own AS (SELECT * FROM open_interest WHERE instrument_id <> 'SIM:PERP:3'), oi AS (SELECT x.*, (x.open_interest - r.v) / nullif(r.v, 0) * 100 AS pct FROM own x {LAT.format(c='open_interest', t='own', w=120000, a='r')}), ac AS (SELECT *, 1 + long_ratio AS y FROM account_ratio), fb AS (SELECT x.*, (x.y - r.v) / nullif(r.v, 0) * 100 AS pct FROM ac x {LAT.format(c='y', t='ac', w=120000, a='r')}), mv AS (SELECT x.*, x.mark_price - r.v AS move FROM mark_funding x {LAT.format(c='mark_price', t='mark_funding', w=60000, a='r')}), pl AS (SELECT x.*, x.ts_ms AS seq, coalesce(a.v, c.v) AS pct, CASE WHEN a.v IS NULL THEN 'fallback' ELSE 'series' END AS used, b.v AS move FROM g x {LAT.format(c='pct', t='oi', w=0, a='a')} {LAT.format(c='pct', t='fb', w=0, a='c')} {LAT.format(c='move', t='mv', w=0, a='b')}), cand AS (SELECT * FROM pl WHERE abs(pct) >= 0.8 AND abs(move) >= 0.3)"


@query("det_oi_spike", f"{OI}, {cooled_sql('cand', 'instrument_id', 60000)} SELECT instrument_id, ts_ms, CASE WHEN move > 0 THEN 'buy' ELSE 'sell' END AS side, used, round(({SCALE('abs(pct)', 0.8, 20.0)} + {SCALE('abs(move)', 0.3, 5.0)}) / 2, 6) AS intensity FROM fired")
def det_oi_spike(v):
    own = R.percent_change(v.open_interest.where("instrument_id <> 'SIM:PERP:3'"), ["instrument_id"], "open_interest", 120_000)
    other = R.percent_change(v.account_ratio.withColumn("y", 1 + F.col("long_ratio")), ["instrument_id"], "y", 120_000)
    mid = R.percent_change(v.mark_funding, ["instrument_id"], "mark_price", 60_000).withColumn("move", F.col("mark_price") - F.col("ref.v"))
    return M.oi_spike(grid(v), own, other, mid, 0.8, 20.0, 0.3, 5.0, 60_000).select("instrument_id", "ts_ms", "side", "used", R6("intensity").alias("intensity"))


def top_sql(choose_by: str, require_both: bool) -> str:
    """Scores by series and side; an account counts from 0.6 to 0.9, a position from 0.7 to 0.95."""
    join = "AND" if require_both else "OR"
    over = {s: f"coalesce(a.{c} >= 0.6, false) {join} coalesce(b.{c} >= 0.7, false)" for s, c in (("long", "l"), ("short", "s"))}
    score = {"a": SCALE("a.{c}", 0.6, 0.9), "b": SCALE("b.{c}", 0.7, 0.95)}
    series = {"max_score": "ab", "account_only": "a", "position_only": "b"}[choose_by]
    parts = [(f"CASE WHEN {over[side]} THEN coalesce({score[x].format(c=side[0])}, 0) END", side) for side in ("long", "short") for x in series]
    best = f"greatest({', '.join(p for p, _ in parts)}, NULL)"
    side = "CASE " + " ".join(f"WHEN {p} = {best} THEN '{name}'" for p, name in parts) + " END"
    there = " AND ".join(f"{x}.l IS NOT NULL" for x in series)
    asof = lambda t, n: f"LEFT JOIN LATERAL (SELECT long_ratio AS l, short_ratio AS s FROM {t} p WHERE p.instrument_id = x.instrument_id AND p.ts_ms <= x.ts_ms ORDER BY p.ts_ms DESC LIMIT 1) {n} ON true"
    return f"{GRID}, cand AS (SELECT x.*, x.ts_ms AS seq, {best} AS best, {side} AS side FROM g x {asof('account_ratio', 'a')} {asof('position_ratio', 'b')} WHERE {there} AND {best} IS NOT NULL), {cooled_sql('cand', 'instrument_id', 60000)} SELECT instrument_id, ts_ms, side, round(best, 5) AS intensity FROM fired"


def _top(name, choose_by, require_both):
    @query(name, top_sql(choose_by, require_both))
    def run(v):
        got = M.top_traders(grid(v), v.account_ratio, v.position_ratio, (0.6, 0.9), (0.7, 0.95), choose_by, require_both, 60_000)
        return got.select("instrument_id", "ts_ms", "side", F.round("intensity", 5).alias("intensity"))


_top("det_top_traders", "max_score", False)
_top("det_top_traders_both", "max_score", True)
_top("det_top_traders_account", "account_only", False)
_top("det_top_traders_position", "position_only", False)

DISL = f"""{GRID}, mb AS (SELECT instrument_id, ts_ms, seq, funding_rate, (mark_price / index_price - 1) * 1e4 AS b, (index_price - mark_price) / mark_price * 1e4 AS d FROM mark_funding), mv AS (SELECT *, (b - lag(b) OVER w) / greatest((ts_ms - lag(ts_ms) OVER w) / 1000.0::DOUBLE, 1e-6) AS vel FROM mb WINDOW w AS (PARTITION BY instrument_id ORDER BY ts_ms, seq)),
md AS (SELECT x.*, (x.d - r.v) / ((x.ts_ms - r.t) / 1000.0::DOUBLE) AS s FROM mv x {books.BREF.format(c='d', t='mb')}), dv AS (SELECT * FROM md WHERE s IS NOT NULL), lv AS (SELECT * FROM md WHERE vel IS NOT NULL),
fu AS (SELECT x.instrument_id, x.ts_ms, x.seq, (x.funding_rate - r.v) / greatest((x.ts_ms - r.t) / 1000.0::DOUBLE, 1) AS trend FROM mark_funding x {LAT.format(c='funding_rate', t='mark_funding', w=9000, a='r')}),
pl AS (SELECT x.*, x.ts_ms AS seq, least(greatest(coalesce(a.v, e.v), -150), 150) AS b, least(greatest(coalesce(c.v, f.v), -50), 50) AS vel, d.v AS trend FROM g x {LAT.format(c='d', t='md', w=0, a='a')} {LAT.format(c='b', t='md', w=0, a='e')} {LAT.format(c='s', t='dv', w=0, a='c')} {LAT.format(c='vel', t='lv', w=0, a='f')} {LAT.format(c='trend', t='fu', w=0, a='d')}),
cand AS (SELECT * FROM pl WHERE abs(b) >= 20 AND abs(vel) >= 1 AND coalesce(abs(trend) >= 1e-7, true))"""


@query("det_basis_dislocation", f"{DISL}, {cooled_sql('cand', 'instrument_id', 60000)} SELECT instrument_id, ts_ms, 'na' AS side, round(greatest({SCALE('abs(b)', 20.0, 200.0)}, {SCALE('abs(vel)', 1.0, 80.0)}, coalesce(least(greatest((abs(trend) - 1e-7) / (1e-4 - 1e-7), 0), 1), 0)), 6) AS intensity FROM fired")
def det_basis_dislocation(v):
    funding = R.trend(v.mark_funding, ["instrument_id"], "funding_rate", 9_000)
    legacy = X.basis_velocity(v.mark_funding)
    documented = R.derivative(books.basis_doc(v), ["instrument_id"], "b", 5000, 20000).withColumnsRenamed({"b": "basis", "slope": "velocity"})
    got = M.basis_dislocation(grid(v), documented, legacy, funding, "auto", (20.0, 200.0), (1.0, 80.0), (1e-7, 1e-4), 150.0, 50.0, True, True, 60_000)
    return got.select("instrument_id", "ts_ms", "side", R6("intensity").alias("intensity"))


@query("det_skew_shock", f"{IV1M}, {A.ASOF_M.format(c='rr', k=5)}, cand AS (SELECT 'BTC' AS instrument_id, bucket * 60000 AS ts_ms, bucket AS seq, d FROM b WHERE abs(d) >= 0.01 AND abs(d) / dt >= 3e-5), {cooled_sql('cand', 'instrument_id', 300000)} SELECT ts_ms, CASE WHEN d > 0 THEN 'bull' ELSE 'bear' END AS side, round({SCALE('abs(d)', 0.01, 0.1)}, 5) AS intensity FROM fired")
def det_skew_shock(v):
    rows = M.change_shock(A._delta(A._iv1m(v), "rr", 300_000), "skew_shock", 0.01, 0.1, 3e-5, 300_000)
    return rows.select("ts_ms", "side", F.round("intensity", 5).alias("intensity"))


MINUTE = 60_000
#: The surface's 7 to 30 days, which have no value while an option is missing; the tickers' mean by minute stands in.
SPIKE = f"""{BUILD}, sv AS (SELECT minute, iv FROM sf WHERE tenor = '7_30d' AND band = '0.95_1.00'),
tk AS (SELECT minute, avg(least(greatest(mark_iv, 0.35), 0.65)) AS iv FROM xn WHERE abs(delta) BETWEEN 0.2 AND 0.8 GROUP BY 1 HAVING count(*) >= 5),
mi AS (SELECT DISTINCT minute FROM xn), pl AS (SELECT mi.minute, a.iv AS now, (SELECT arg_max(q.iv, q.minute) FROM sv q WHERE q.minute <= mi.minute - 5 AND q.minute >= mi.minute - 15) AS before, c.iv AS tn, d.iv AS tb FROM mi LEFT JOIN sv a ON a.minute = mi.minute LEFT JOIN tk c ON c.minute = mi.minute LEFT JOIN tk d ON d.minute = mi.minute - 5),
cand AS (SELECT 'BTC' AS instrument_id, minute * 60000 AS ts_ms, minute AS seq, CASE WHEN now IS NOT NULL AND before IS NOT NULL THEN 'surface' ELSE 'ticker_fallback' END AS source, CASE WHEN now IS NOT NULL AND before IS NOT NULL THEN now - before ELSE tn - tb END AS d FROM pl WHERE abs(CASE WHEN now IS NOT NULL AND before IS NOT NULL THEN now - before ELSE tn - tb END) >= 0.005)"""


@query("det_iv_spike", f"{SPIKE}, {cooled_sql('cand', 'instrument_id', 300000)} SELECT ts_ms, source, CASE WHEN d > 0 THEN 'up' ELSE 'down' END AS side, round({SCALE('abs(d)', 0.005, 0.05)}, 5) AS intensity FROM fired")
def det_iv_spike(v):
    key = ["instrument_id"]
    rows = V.serving(ticks(v).where(V.tenor(F.col("expiry_days")).isNotNull()), 600_000, 5_000, v.option_times)
    gate = F.abs("delta").between(0.2, 0.8)
    mean = F.avg(F.when(gate, X.clamp(F.col("mark_iv"), 0.35, 0.65)))
    polls = rows.groupBy("minute", F.col("underlying").alias("instrument_id")).agg(F.when(F.count_if(gate) >= 5, mean).alias("iv"))
    polls = polls.withColumns({"ts_ms": F.col("minute") * MINUTE, "seq": F.col("minute")})
    polls = asof(polls, key, F.col("iv"), 5 * MINUTE, 5 * MINUTE, "t").select(*key, "minute", "ts_ms", "seq", F.col("iv").alias("ticker_now"), F.col("t.v").alias("ticker_before"))
    own = surface(v).where("tenor = '7_30d' and band = '0.95_1.00'").select(F.col("underlying").alias("instrument_id"), "minute", F.col("iv").alias("now"))
    both = polls.join(own, [*key, "minute"], "left")
    # The newest surface value 5 to 15 minutes old: windows over the minutes that have one.
    span = 4 * 15 * MINUTE
    near = both.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor(F.col("ts_ms") / span), F.floor((F.col("ts_ms") + 15 * MINUTE) / span))))).withColumn("_own", F.col("_b") == F.floor(F.col("ts_ms") / span))
    w = Window.partitionBy(*key, "_b").orderBy("ts_ms").rangeBetween(-15 * MINUTE, -5 * MINUTE)
    both = near.withColumn("before", F.max(F.when(F.col("now").isNotNull(), F.struct("ts_ms", "now"))).over(w)["now"]).where("_own")
    return M.iv_spike(both, 0.005, 0.05, (0.0, 5.0), False, 300_000).select("ts_ms", "source", "side", F.round("intensity", 5).alias("intensity"))


TERM_SCAN = f"""{A.TERM}, tn AS (SELECT bucket * 60000 AS ts_ms, sp, row_number() OVER (ORDER BY bucket) AS rn FROM s),
tf AS (SELECT rn, ts_ms, sp AS kept, ts_ms AS at, NULL::DOUBLE AS vel, CASE WHEN sp >= 0.01 THEN ts_ms END AS fired, sp >= 0.01 AS hit FROM tn WHERE rn = 1 UNION ALL
       SELECT c.rn, c.ts_ms, CASE WHEN coalesce(c.ts_ms - f.fired < 300000, false) THEN f.kept ELSE c.sp END, CASE WHEN coalesce(c.ts_ms - f.fired < 300000, false) THEN f.at ELSE c.ts_ms END, CASE WHEN NOT coalesce(c.ts_ms - f.fired < 300000, false) THEN (c.sp - f.kept) / ((c.ts_ms - f.at) / 1000.0::DOUBLE) END,
              CASE WHEN NOT coalesce(c.ts_ms - f.fired < 300000, false) AND c.sp >= 0.01 THEN c.ts_ms ELSE f.fired END, NOT coalesce(c.ts_ms - f.fired < 300000, false) AND c.sp >= 0.01 FROM tf f JOIN tn c ON c.rn = f.rn + 1)"""


@query("det_term_structure_invert", f"{TERM_SCAN} SELECT ts_ms, round(kept, 6) AS spread, round(vel * 1e3, 6) AS velocity, round({SCALE('kept', 0.01, 0.4)}, 5) AS intensity FROM tf WHERE hit")
def det_term_structure_invert(v):
    got = M.term_inversion(A._term(v).withColumn("spread", F.col("sp")), 0.01, 0.4, 2.0, 300_000)
    return got.select("ts_ms", R6("spread").alias("spread"), R6(F.col("velocity") * 1e3).alias("velocity"), F.round("intensity", 5).alias("intensity"))


usd = "least(coalesce(sum(coalesce(quote_qty_usd, qty)) FILTER (WHERE side = '{s}'), 0), 150000)"
LIQ = f"""{GRID}, lq AS (SELECT g.instrument_id, g.ts_ms, {usd.format(s='buy')} AS buy, {usd.format(s='sell')} AS sell FROM g LEFT JOIN liquidations l ON l.instrument_id = g.instrument_id AND l.ts_ms <= g.ts_ms AND l.ts_ms >= g.ts_ms - 60000 GROUP BY ALL),
lm AS (SELECT lq.*, m.mark_price AS mid, row_number() OVER (PARTITION BY lq.instrument_id ORDER BY lq.ts_ms) AS rn FROM lq ASOF LEFT JOIN mark_funding m ON m.instrument_id = lq.instrument_id AND m.ts_ms <= lq.ts_ms),
lp AS (SELECT x.*, x.mid - (SELECT arg_max(p.mid, p.ts_ms) FROM lm p WHERE p.instrument_id = x.instrument_id AND p.mid IS NOT NULL AND p.ts_ms <= x.ts_ms - 60000 AND p.ts_ms >= x.ts_ms - 600000) AS mom, CASE WHEN sell >= 1000 AND sell >= buy THEN 'sell' WHEN buy >= 1000 THEN 'buy' END AS dom FROM lm x),
lf AS (SELECT instrument_id, rn, ts_ms, dom AS side, ts_ms AS armed, mid AS anchor, NULL::BIGINT AS fired, false AS hit FROM lp WHERE rn = 1 UNION ALL
       SELECT instrument_id, rn, ts_ms, CASE WHEN cooling THEN side WHEN fresh THEN dom WHEN back OR hit THEN NULL ELSE side END, CASE WHEN NOT cooling AND fresh THEN ts_ms ELSE armed END, CASE WHEN cooling THEN anchor WHEN fresh THEN mid ELSE anc END, CASE WHEN hit THEN ts_ms ELSE fired END, hit
       FROM (SELECT *, NOT cooling AND NOT fresh AND NOT back AND coalesce(sign * mom >= 0.3, false) AND ts_ms - armed >= 10000 AS hit
             FROM (SELECT *, coalesce(sign * (anc - mid) > 5, false) AS back
                   FROM (SELECT c.*, f.side, f.armed, f.anchor, f.fired, coalesce(c.ts_ms - f.fired < 60000, false) AS cooling, c.dom IS NULL OR f.side IS NULL OR c.dom <> f.side AS fresh, coalesce(f.anchor, c.mid) AS anc, CASE WHEN c.dom = 'sell' THEN -1 ELSE 1 END AS sign FROM lf f JOIN lp c ON c.instrument_id = f.instrument_id AND c.rn = f.rn + 1))))"""


@query("det_liq_cluster", f"{LIQ} SELECT lp.instrument_id, lp.ts_ms, lp.dom AS side, round(lp.mom, 6) AS momentum, round({SCALE('CASE WHEN lp.dom = $$sell$$ THEN lp.sell ELSE lp.buy END', 1000.0, 200000.0)}, 6) AS intensity FROM lf JOIN lp USING (instrument_id, rn) WHERE lf.hit")
def det_liq_cluster(v):
    key, usd = ["instrument_id"], F.coalesce("quote_qty_usd", "qty")
    # A liquidation serves the polls up to 60 s after it.
    polls = F.explode(F.sequence(F.ceil(F.col("ts_ms") / 30_000) * 30_000, F.floor((F.col("ts_ms") + 60_000) / 30_000) * 30_000, F.lit(30_000).cast("long")))
    side = lambda s: F.sum(F.when(F.col("side") == s, usd).otherwise(0.0)).alias(s)
    sums = v.liquidations.withColumn("_t", polls).groupBy(*key, F.col("_t").alias("ts_ms")).agg(side("buy"), side("sell"))
    rows = asof_join(grid(v), v.mark_funding, key, F.col("mark_price"), "mid").join(sums, [*key, "ts_ms"], "left").fillna(0.0, ["buy", "sell"])
    got = M.liq_cluster(rows, 1000.0, 200_000.0, 150_000.0, 0.3, 60_000, 5.0, 10_000, 60_000)
    return got.select("instrument_id", "ts_ms", "side", R6("momentum").alias("momentum"), R6("intensity").alias("intensity"))


FLIP = f"""gx AS (SELECT *, unnest(range(greatest(ceil(ts_ms / 60000.0::DOUBLE)::BIGINT, 0), (ts_ms + 600000) // 60000 + 1)) AS minute FROM {JOINED}),
gl AS (SELECT * FROM gx QUALIFY row_number() OVER (PARTITION BY minute, instrument_id ORDER BY ts_ms DESC, seq DESC, seq2 DESC) = 1),
gp AS (SELECT underlying, minute, sum({A.GEX}) AS net FROM gl GROUP BY ALL), gn AS (SELECT *, minute * 60000 AS ts_ms, CASE WHEN net > 0 THEN 1 ELSE -1 END AS sg, row_number() OVER (PARTITION BY underlying ORDER BY minute) AS rn FROM gp WHERE abs(net) >= 100 AND net <> 0),
gf AS (SELECT underlying, rn, ts_ms, sg AS sign, 0 AS n, NULL::BIGINT AS fired, false AS hit, 0 AS was FROM gn WHERE rn = 1 UNION ALL
       SELECT underlying, rn, ts_ms, CASE WHEN hit THEN sg ELSE sign END, CASE WHEN hit THEN 0 ELSE cnt END, CASE WHEN hit THEN ts_ms ELSE fired END, hit, sign
       FROM (SELECT *, cnt >= 2 AND coalesce(ts_ms - fired >= 300000, true) AS hit FROM (SELECT c.*, f.sign, f.fired, CASE WHEN c.sg = f.sign OR abs(c.net) < 110 THEN 0 ELSE f.n + 1 END AS cnt FROM gf f JOIN gn c ON c.underlying = f.underlying AND c.rn = f.rn + 1)))"""


@query("det_gamma_flip", f"{FLIP} SELECT gf.underlying, gf.ts_ms, was AS sign_from, sign AS sign_to, round(net, 2) AS net, round({SCALE('abs(net)', 100.0, 1e6)}, 6) AS intensity FROM gf JOIN gn USING (underlying, rn) WHERE hit")
def det_gamma_flip(v):
    rows = X.gamma_exposure(V.serving(ticks(v), 600_000, 0, v.option_times))
    polls = rows.groupBy("underlying", (F.col("minute") * MINUTE).alias("ts_ms")).agg(F.sum("gex").alias("net"))
    return M.gamma_flip(polls, 100.0, 0.1, 2, 100.0, 1e6, 300_000).select("underlying", "ts_ms", "sign_from", "sign_to", F.round("net", 2).alias("net"), R6("intensity").alias("intensity"))
