"""Rules, alerts, dispatch, drill-down, and calibration on events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.operators import detect as D
from tidewatch.operators import rules as S
from tidewatch.operators.blocks import asof_join, previous
from tidewatch.operators.calibrate import percentiles
from tidewatch.operators.once import once

from . import books
from .aggregates import OI_RUN, P3, PCT
from .detectors import BREAK, GATES, SPOOF, TAPE, break_rows, cooled_sql, gate_sql, runs_sql, spoof_rows
from .registry import query

R6 = lambda c: F.round(c, 6)
EVENTS = f"{runs_sql('trades', 800)}, sl AS (SELECT instrument_id, ts_ms, seq, 'slicing_aggr' AS kind, side, price, volume AS intensity, k FROM r2 WHERE k >= 5 AND volume >= 5)"
SEV = "CASE WHEN intensity >= 10 THEN 'HIGH' WHEN intensity >= 5 THEN 'MEDIUM' ELSE 'LOW' END"


def events(v):
    got = D.slicing(v.trades, 800, 5, 5.0)
    return got.select("instrument_id", "ts_ms", "seq", "kind", "side", "price", "intensity", "k", F.create_map(F.lit("mode"), F.col("mode"), F.lit("k"), F.col("k").cast("string")).alias("fields"))


TAPES = cooled_sql("cand", "instrument_id", 20000)

#: Kinds of event and the scale of their intensities, for a catalogue of events of every kind, side and sign.
KINDS = [
    ("break_wall", 5.0), ("absorption", 900.0), ("slicing_aggr", 15.0), ("slicing_pass", 40.0), ("dominance", 100.0), ("spoofing", 150.0), ("depletion", 1.0), ("metric_trigger", 150.0), ("basis_mean_revert", 5.0),
    ("iv_spike", 1.0), ("iv_spike_up", 30.0), ("iv_spike_down", 30.0), ("oi_skew_bull", 3.0), ("oi_skew_bear", 3.0), ("tape_pressure", 1.0), ("oi_spike", 1.0), ("top_traders", 1.0), ("liq_cluster", 1.0),
    ("basis_dislocation", 1.0), ("skew_shock", 1.0), ("gamma_flip", 1.0), ("term_structure_invert", 1.0), ("unknown", 1.0),
]
SIDES = ["buy", "sell", "na", "long", "SHORT", None]
METRICS = ["basis_bps", "spread_usd", "wmid"]
text_list = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"
number = lambda x: "NULL" if x is None else f"{x}"
EVERY_KIND = f"""
ek AS (SELECT event_id AS seq, instrument_id, ({text_list(k for k, _ in KINDS)})[event_id % {len(KINDS)} + 1] AS kind, lower(coalesce(({text_list(SIDES)})[(event_id // 7) % {len(SIDES)} + 1], 'na')) AS side, ({text_list(METRICS)})[(event_id // 5) % {len(METRICS)} + 1] AS metric,
       CASE WHEN k % 17 = 0 THEN NULL ELSE (k - 30) / 70::DOUBLE * (ARRAY{[x for _, x in KINDS]})[event_id % {len(KINDS)} + 1] END AS val, CASE WHEN k % 5 = 0 THEN NULL ELSE (k % 7 - 2) * 20::DOUBLE END AS thr, CASE WHEN k % 6 = 0 THEN NULL ELSE (k - 50) / 12::DOUBLE END AS vel FROM ev),
th AS (SELECT *, coalesce(thr, 0) AS t, coalesce(vel, 0) AS u FROM ek),
hit AS (
SELECT *, CASE side WHEN 'buy' THEN 'R1' ELSE 'R2' END AS rule, side AS out_side, abs(u) AS x, 2.0 AS m, 3.0 AS h FROM th WHERE kind = 'break_wall' AND (side = 'buy' AND u > 0 OR side = 'sell' AND u < 0)
UNION ALL SELECT th.*, CASE side WHEN 'buy' THEN r[1] ELSE r[2] END, side, val, m, h FROM th JOIN (VALUES ('absorption', ['R3', 'R4'], 300, 600), ('slicing_aggr', ['R5', 'R6'], 5, 10), ('slicing_pass', ['R7', 'R8'], 10, 25), ('dominance', ['R9', 'R10'], 80, 90), ('spoofing', ['R11', 'R12'], 50, 100), ('depletion', ['R13', 'R14'], 0.4, 0.6), ('tape_pressure', ['R23', 'R24'], 0.8, 0.9), ('oi_spike', ['R28', 'R29'], 0.6, 0.8), ('liq_cluster', ['R33', 'R32'], 0.4, 0.8)) q(kind, r, m, h) USING (kind) WHERE side IN ('buy', 'sell')
UNION ALL SELECT *, CASE side WHEN 'long' THEN 'R30' ELSE 'R31' END, side, val, 0.6, 0.8 FROM th WHERE kind = 'top_traders' AND side IN ('long', 'short')
UNION ALL SELECT *, 'R15', 'na', val, 50, 100 FROM th WHERE kind = 'metric_trigger' AND metric = 'basis_bps' AND val >= t AND t >= 0
UNION ALL SELECT *, 'R16', 'na', abs(val), 50, 100 FROM th WHERE kind = 'metric_trigger' AND metric = 'basis_bps' AND val <= -abs(t)
UNION ALL SELECT *, CASE side WHEN 'sell' THEN 'R17' ELSE 'R18' END, side, abs(val), 2, 3 FROM th WHERE kind = 'basis_mean_revert' AND side IN ('buy', 'sell')
UNION ALL SELECT *, 'R19', side, val, 0.6, 0.8 FROM th WHERE kind = 'iv_spike'
UNION ALL SELECT *, CASE kind WHEN 'iv_spike_up' THEN 'R19' ELSE 'R20' END, 'na', 1, 0, 0 FROM th WHERE kind IN ('iv_spike_up', 'iv_spike_down')
UNION ALL SELECT *, CASE kind WHEN 'oi_skew_bull' THEN 'R21' ELSE 'R22' END, 'na', 1, 0, 9 FROM th WHERE kind IN ('oi_skew_bull', 'oi_skew_bear')
UNION ALL SELECT *, 'R27', 'na', abs(coalesce(val, 0)), 0.5, 1 FROM th WHERE kind = 'metric_trigger' AND metric = 'spread_usd'
UNION ALL SELECT *, CASE kind WHEN 'basis_dislocation' THEN 'R34' WHEN 'skew_shock' THEN 'R35' WHEN 'gamma_flip' THEN 'R36' ELSE 'R37' END, 'na', val, 0.6, 0.8 FROM th WHERE kind IN ('basis_dislocation', 'skew_shock', 'gamma_flip', 'term_structure_invert'))"""


def every_kind(v):
    """Events of every kind, derived from the raw events."""
    pick = lambda xs, i: F.get(F.array(*(F.lit(x) for x in xs)), (i % len(xs)).cast("int"))
    e, k = F.col("event_id"), F.col("k")
    scale = pick([x for _, x in KINDS], e)
    return v.ev.select(
        e.alias("seq"), "instrument_id", pick([x for x, _ in KINDS], e).alias("kind"), pick(SIDES, F.floor(e / 7)).alias("side"), pick(METRICS, F.floor(e / 5)).alias("metric"),
        F.when(k % 17 != 0, (k - 30) / 70.0 * scale).alias("intensity"), F.when(k % 5 != 0, (k % 7 - 2) * 20.0).alias("threshold"), F.when(k % 6 != 0, (k - 50) / 12.0).alias("velocity"),
    )


@query("rule_eval", f"{EVENTS}, {TAPE}, {TAPES}, {EVERY_KIND} SELECT instrument_id, seq, CASE WHEN side = 'buy' THEN 'R5' ELSE 'R6' END AS rule, side, {SEV} AS severity FROM sl UNION ALL SELECT instrument_id, seq, CASE WHEN ratio >= 0.8 THEN 'R23' ELSE 'R24' END, CASE WHEN ratio >= 0.8 THEN 'buy' ELSE 'sell' END, CASE WHEN ratio >= 0.9 THEN 'HIGH' WHEN ratio >= 0.8 THEN 'MEDIUM' ELSE 'LOW' END FROM fired UNION ALL SELECT instrument_id, seq, rule, out_side, CASE WHEN x IS NULL THEN 'MEDIUM' WHEN x >= h THEN 'HIGH' WHEN x >= m THEN 'MEDIUM' ELSE 'LOW' END FROM hit")
def rule_eval(v):
    tape = D.tape_pressure(v.trades, 3000, 0.8, 0.2, 20_000)
    found = events(v).select("instrument_id", "seq", "kind", "side", "intensity").unionByName(tape.select("instrument_id", "seq", "kind", "side", "intensity"))
    return S.rated(found.unionByName(every_kind(v), allowMissingColumns=True)).select("instrument_id", "seq", "rule", "side", "severity")


@query("severity_abs", "SELECT event_id, CASE WHEN value - 50 IS NULL THEN 'MEDIUM' WHEN abs(value - 50) >= 40 THEN 'HIGH' WHEN abs(value - 50) >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM ev")
def severity_abs(v):
    return v.ev.select("event_id", S.severity(F.abs(F.col("value") - 50), F.lit(20.0), F.lit(40.0)).alias("severity"))


@query("severity_val", "SELECT event_id, CASE WHEN k % 9 = 0 THEN 'MEDIUM' WHEN value - 50 >= 40 THEN 'HIGH' WHEN value - 50 >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM ev")
def severity_val(v):
    return v.ev.select("event_id", S.severity(F.when(F.col("k") % 9 != 0, F.col("value") - 50), F.lit(20.0), F.lit(40.0)).alias("severity"))


@query("severity_norm", "SELECT event_id, CASE k % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END AS severity FROM ev")
def severity_norm(v):
    word = F.when(F.col("k") % 4 == 0, " high").when(F.col("k") % 4 == 1, "low").when(F.col("k") % 4 == 2, "medium").otherwise("odd")
    return v.ev.select("event_id", S.normal_severity(word).alias("severity"))


#: Intensities of runs grow from trade to trade; in steps of 20, hits of one run merge.
KEYED = f"""{EVENTS}, al AS (SELECT *, instrument_id || '|' || CASE WHEN side = 'buy' THEN 'R5' ELSE 'R6' END || '|' || side || '|' || kind || '|p=' || printf('%.2f', price) || '|i=' || printf('%.4f', step) || '|' || substring(sha1('{{"mode":"hitting","step":"' || step::BIGINT::VARCHAR || '"}}'), 1, 8) AS dedup_key FROM (SELECT *, floor(intensity / 20) * 20 AS step FROM sl))"""


def keyed(v):
    step = F.floor(F.col("intensity") / 20) * 20
    rows = S.rated(events(v)).withColumn("intensity", step.cast("double"))
    return rows.withColumn("dedup_key", S.dedup_key(F.create_map(F.lit("step"), step.cast("string"), F.lit("mode"), F.col("fields")["mode"])))


@query("dedup_key", f"{KEYED} SELECT instrument_id, seq, dedup_key FROM al")
def dedup_key(v):
    return keyed(v).select("instrument_id", "seq", "dedup_key")


UPSERT = f"""{KEYED}, a1 AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY ts_ms, seq) AS rn FROM al),
rf AS (SELECT dedup_key, rn, ts_ms AS first, ts_ms AS t FROM a1 WHERE rn = 1 UNION ALL SELECT c.dedup_key, c.rn, CASE WHEN c.ts_ms - f.first >= 90000 THEN c.ts_ms ELSE f.first END, c.ts_ms FROM rf f JOIN a1 c ON c.dedup_key = f.dedup_key AND c.rn = f.rn + 1)"""


@query("alert_upsert_suppress", f"{UPSERT} SELECT dedup_key, first AS ts_first, max(t) AS ts_last, count(*) AS n_hits FROM rf GROUP BY ALL")
def alert_upsert_suppress(v):
    return S.suppressed(keyed(v)).select("dedup_key", "ts_first", "ts_last", "n_hits")


#: Fields of the catalogue's events, each missing in one event of eleven.
TEXT_FIELDS = sorted({source for parts in S.TEXTS.values() for _, _, source in parts} - set(S.COLUMNS))


def _field_sql(source: str) -> str:
    if source in S.COLUMNS:
        return {"price": "price", "intensity": "val"}[source]
    j = TEXT_FIELDS.index(source)
    return f"CASE WHEN k % 11 <> {j % 11} THEN (k - 40) * {j + 1} / 7::DOUBLE END"


def _told_sql(parts) -> str:
    return " || ' ' || ".join(f"'{name}=' || coalesce(printf('{form}', {_field_sql(source)}), 'na')" for name, form, source in parts)


@query("alert_text", f"{EVERY_KIND}, tx AS (SELECT hit.*, ev.k, 100 + ev.k / 10::DOUBLE AS price FROM hit JOIN ev ON ev.event_id = hit.seq) SELECT instrument_id, seq, rule, '#' || rule || ' ' || kind || ' ' || upper(out_side) || ' | ' || CASE kind {' '.join(f'WHEN {kind!r} THEN {_told_sql(parts)}' for kind, parts in S.TEXTS.items())} ELSE 'i=' || coalesce(printf('%.2f', val), 'na') END AS text FROM tx")
def alert_text(v):
    # The texts are made behind the join: it carries the number that they come from, not a map an event, and broadcasts no side, whatever its files' sizes tell.
    k = F.col("k")
    fields = F.map_filter(F.create_map(*(x for j, name in enumerate(TEXT_FIELDS) for x in (F.lit(name), F.when(k % 11 != j % 11, ((k - 40) * (j + 1) / 7.0).cast("string"))))), lambda _, x: x.isNotNull())
    more = v.ev.select(F.col("event_id").alias("seq"), "k").hint("merge")
    rows = S.rated(every_kind(v).join(more, "seq")).withColumns({"price": 100 + k / 10.0, "fields": fields})
    return rows.select("instrument_id", "seq", "rule", S.text().alias("text"))


@query("alert_lag", f"{EVENTS} SELECT side, (10000000 - max(ts_ms)) / 1000.0::DOUBLE AS lag_s, count(*) AS n FROM sl GROUP BY 1")
def alert_lag(v):
    return events(v).groupBy("side").agg(((F.lit(10_000_000) - F.max("ts_ms")) / 1000.0).alias("lag_s"), F.count("*").alias("n"))


@query("dispatch_throttle", f"{EVENTS}, d AS (SELECT *, row_number() OVER (PARTITION BY ts_ms // 60000 ORDER BY ts_ms, seq) AS rn FROM sl) SELECT instrument_id, seq, CASE WHEN rn <= 60 THEN 'sent' ELSE 'rate_limit' END AS status FROM d")
def dispatch_throttle(v):
    return S.throttled(events(v).withColumn("router", F.lit("chat"))).select("instrument_id", "seq", "status")


@query("dispatch_log", f"{EVENTS} SELECT event_id AS alert_id, k FROM ev WHERE event_id IN (SELECT seq FROM sl)")
def dispatch_log(v):
    return S.dispatch_log(v.ev.select(F.col("event_id").alias("alert_id"), "k"), events(v).select(F.col("seq").alias("alert_id")))


# What the gates of the detectors decide: the reason of each discard, null for what is emitted.
REASONS = ("dom_spread", "metrics_none", "iv_missing", "oi_missing", "oi_low", "basis_vel_low", "dep_low", "refill_high", "top_levels_gate")
WALLS = REASONS[5:]
LEAST_OI = 100.0
_DOMINANT = "spread_usd <= 2.0 AND (dominance_bid_doc >= 0.6 OR dominance_ask_doc >= 0.6)"
GATED = f"""{BREAK}, {gate_sql('auto', *GATES['auto'])}, {OI_RUN},
gt AS (SELECT ts_ms, 'R1/R2' AS rule, side, 'metrics_none' AS reason FROM bw WHERE vel IS NULL
       UNION ALL SELECT ts_ms, 'R1/R2', side, verdict FROM bw WHERE verdict IN ({', '.join(repr(x) for x in WALLS)})
       UNION ALL SELECT ts_ms, CASE WHEN side = 'buy' THEN 'R1' ELSE 'R2' END, side, NULL FROM bw WHERE verdict = 'pass' AND (side = 'buy' AND vel > 0 OR side = 'sell' AND vel < 0)
       UNION ALL SELECT ts_ms, CASE WHEN dominance_bid_doc >= 0.6 THEN 'R9' ELSE 'R10' END, CASE WHEN dominance_bid_doc >= 0.6 THEN 'buy' ELSE 'sell' END, NULL FROM sn WHERE {_DOMINANT}
       UNION ALL SELECT ts_ms, 'R9/R10', 'na', CASE WHEN spread_usd IS NULL THEN 'metrics_none' ELSE 'dom_spread' END FROM sn WHERE NOT coalesce({_DOMINANT}, false)
       UNION ALL SELECT ts_ms, 'R15/R16', 'na', 'metrics_none' FROM sn WHERE basis_bps IS NULL
       UNION ALL SELECT ts_ms, 'R17/R18', 'na', 'metrics_none' FROM sn WHERE basis_bps IS NULL OR basis_vel_bps_s IS NULL
       UNION ALL SELECT ts_ms, 'R19/R20', 'na', 'iv_missing' FROM options_ticker WHERE mark_iv IS NULL OR mark_iv <= 0
       UNION ALL SELECT ts_ms, 'R21/R22', 'na', 'oi_missing' FROM options_ticker WHERE open_interest IS NULL
       UNION ALL SELECT ts_ms, 'R21/R22', 'na', 'oi_low' FROM o WHERE calls + puts < {LEAST_OI})"""


def gated(v):
    """(ts_ms, rule, side, reason): the break wall's gates on slicing events, those of each book sample, and of each option tick."""
    row = lambda rows, rule, side, reason: rows.select("ts_ms", *(c.alias(n) for c, n in ((rule, "rule"), (side, "side"), (reason, "reason"))))
    na, none = F.lit("na"), F.lit("metrics_none")
    walls, samples = once(break_rows(v, "auto").select("ts_ms", "side", "fired", "gate", "velocity")), once(books.snapshots(v))
    own = (F.col("side") == "buy") & (F.col("velocity") > 0) | (F.col("side") == "sell") & (F.col("velocity") < 0)
    dominant = F.coalesce(F.expr(_DOMINANT), F.lit(False))
    bid = F.col("dominance_bid_doc") >= 0.6
    running = X.running_oi(X.with_instruments(v.options_ticker, v.options_instruments))
    parts = [
        row(walls.where("velocity is null"), F.lit("R1/R2"), F.col("side"), none),
        row(walls.where(F.col("gate").isin(*WALLS)), F.lit("R1/R2"), F.col("side"), F.col("gate")),
        row(walls.where(F.col("fired") & own), F.when(F.col("side") == "buy", "R1").otherwise("R2"), F.col("side"), F.lit(None).cast("string")),
        row(samples.where(dominant), F.when(bid, "R9").otherwise("R10"), F.when(bid, "buy").otherwise("sell"), F.lit(None).cast("string")),
        row(samples.where(~dominant), F.lit("R9/R10"), na, F.when(F.col("spread_usd").isNull(), none).otherwise("dom_spread")),
        row(samples.where("basis_bps is null"), F.lit("R15/R16"), na, none),
        row(samples.where("basis_bps is null or basis_vel_bps_s is null"), F.lit("R17/R18"), na, none),
        row(v.options_ticker.where("mark_iv is null or mark_iv <= 0"), F.lit("R19/R20"), na, F.lit("iv_missing")),
        row(v.options_ticker.where("open_interest is null"), F.lit("R21/R22"), na, F.lit("oi_missing")),
        row(running.where(F.col("calls") + F.col("puts") < LEAST_OI), F.lit("R21/R22"), na, F.lit("oi_low")),
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query("discard_reasons", f"{GATED} SELECT rule, reason, count(*) AS n FROM gt WHERE reason IS NOT NULL GROUP BY ALL")
def discard_reasons(v):
    return gated(v).where("reason is not null").groupBy("rule", "reason").agg(F.count("*").alias("n"))


@query("telemetry_minute", f"{GATED} SELECT ts_ms // 60000 AS minute, rule, side, count(*) FILTER (WHERE reason IS NULL) AS emitted, {', '.join(f'count(*) FILTER (WHERE reason = {x!r}) AS disc_{x}' for x in REASONS)} FROM gt GROUP BY ALL")
def telemetry_minute(v):
    return X.telemetry(gated(v), REASONS)


@query("event_drilldown", f"{EVENTS} SELECT instrument_id, seq, 'hitting' AS mode, intensity FROM sl ORDER BY ts_ms DESC LIMIT 50")
def event_drilldown(v):
    return events(v).where(F.col("fields")["mode"] == "hitting").orderBy(F.desc("ts_ms")).limit(50).select("instrument_id", "seq", F.col("fields")["mode"].alias("mode"), "intensity")


@query("calib_slicing", f"{EVENTS}, x AS (SELECT intensity AS x FROM sl) SELECT {P3} FROM x")
def calib_slicing(v):
    return percentiles(events(v), F.col("intensity"))


@query("calib_spoofing", f"{SPOOF}, x AS (SELECT wall AS x FROM sz WHERE rate >= 0.3 AND executed <= 5) SELECT {P3} FROM x")
def calib_spoofing(v):
    return percentiles(spoof_rows(v), F.col("intensity"))


@query("calib_absorption", "a AS (SELECT (SELECT sum(qty) FROM trades p WHERE p.instrument_id = x.instrument_id AND p.side = x.side AND p.seq <= x.seq AND p.ts_ms >= x.ts_ms - 10000) AS x FROM trades x) SELECT " + P3 + " FROM a WHERE x >= 20")
def calib_absorption(v):
    from tidewatch.operators.blocks import trailing_sum

    return percentiles(trailing_sum(v.trades, ["instrument_id", "side"], F.col("qty"), 10_000, "volume").where("volume >= 20"), F.col("volume"))


@query("calib_spread", f"{books.BOOK}, x AS (SELECT greatest(best_ask - best_bid, 0) AS x FROM b WHERE best_ask IS NOT NULL AND best_bid IS NOT NULL) SELECT {PCT(0.5, 0.9, 0.95, 0.99)} FROM x")
def calib_spread(v):
    return percentiles(books.book(v).where("best_ask is not null and best_bid is not null"), F.col("spread"), (0.5, 0.9, 0.95, 0.99))


@query("calib_dominance", f"{books.BOOK}, x AS (SELECT instrument_id, bid_vol / (bid_vol + ask_vol) AS x FROM b WHERE bid_vol + ask_vol > 0) SELECT instrument_id, {P3} FROM x GROUP BY 1")
def calib_dominance(v):
    return percentiles(books.book(v).where("dominance_bid is not null"), F.col("dominance_bid"), by=["instrument_id"])


REFILL = """s AS (SELECT x.side, (SELECT sum(qty) FROM depth p WHERE p.instrument_id = x.instrument_id AND p.side = x.side AND p.seq <= x.seq AND p.ts_ms >= x.ts_ms - 3000 AND action <> 'delete') AS ins,
(SELECT sum(qty) FROM depth p WHERE p.instrument_id = x.instrument_id AND p.side = x.side AND p.seq <= x.seq AND p.ts_ms >= x.ts_ms - 3000 AND action = 'delete') AS del FROM depth x), x AS (SELECT least(coalesce(ins, 0) / nullif(del, 0), 1) AS x FROM s)"""


@query("calib_refill", f"{REFILL} SELECT {P3} FROM x WHERE x > 0")
def calib_refill(v):
    from tidewatch.operators.blocks import trailing_sum

    key = ["instrument_id", "side"]
    rows = trailing_sum(v.depth, key, F.when(F.col("action") != "delete", F.col("qty")), 3000, "ins")
    rows = trailing_sum(rows, key, F.when(F.col("action") == "delete", F.col("qty")), 3000, "del").withColumn("r", F.least(F.try_divide("ins", "del"), F.lit(1.0)))
    return percentiles(rows.where("r > 0"), F.col("r"))


@query("calib_dep_refill_amounts", f"{books.BOOK_1S}, p AS (SELECT bid_vol - lag(bid_vol) OVER (PARTITION BY instrument_id ORDER BY instant) AS d FROM b), x AS (SELECT 'depletion' AS kind, greatest(-d, 0) AS x FROM p WHERE d IS NOT NULL UNION ALL SELECT 'refill', greatest(d, 0) FROM p WHERE d IS NOT NULL) SELECT kind, {PCT(0.5, 0.9, 0.95, 0.99)} FROM x GROUP BY 1")
def calib_dep_refill_amounts(v):
    rows = previous(books.timed(books.book_1s(v)).select("instrument_id", "ts_ms", "seq", "bid_vol"), ["instrument_id"], ["bid_vol"])
    d = F.col("bid_vol") - F.col("was.bid_vol")
    amounts = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.greatest(x, F.lit(0.0)).alias("x")) for kind, x in (("depletion", -d), ("refill", d)))))
    return percentiles(rows.where(d.isNotNull()).select(amounts.alias("a")).select("a.*"), F.col("x"), (0.5, 0.9, 0.95, 0.99), by=["kind"])


HORIZONS = (30, 60)


@query("calib_wmid_move", f"{books.BOOK_1S}, q AS (SELECT instrument_id, instant, (best_ask + best_bid) / 2 AS mid FROM b WHERE best_ask IS NOT NULL AND best_bid IS NOT NULL), h(horizon_s) AS (VALUES {', '.join(f'({h})' for h in HORIZONS)}), z AS (SELECT *, instant - horizon_s * 1000 AS t FROM q, h), x AS (SELECT z.horizon_s, abs(z.mid - p.mid) AS x FROM z ASOF JOIN q p ON p.instrument_id = z.instrument_id AND p.instant <= z.t) SELECT horizon_s, {PCT(0.25, 0.5, 0.75, 0.95, 0.99)} FROM x GROUP BY 1")
def calib_wmid_move(v):
    """Moves of the book's mid over both horizons: a probe for each, all in one ordered stream."""
    mids = once(books.timed(books.book_1s(v)).where("wmid is not null").select("instrument_id", "ts_ms", "seq", "wmid"))
    probes = mids.withColumn("horizon_s", F.explode(F.array(*map(F.lit, HORIZONS)))).withColumn("ts_ms", F.col("ts_ms") - F.col("horizon_s") * 1000)
    moved = asof_join(probes, mids, ["instrument_id"], F.col("wmid"), "was").where("was is not null")
    return percentiles(moved, F.abs(F.col("wmid") - F.col("was")), (0.25, 0.5, 0.75, 0.95, 0.99), by=["horizon_s"])
