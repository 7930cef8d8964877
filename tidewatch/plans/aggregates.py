"""Filters, joins, aggregates, liveness, limits and percentile calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.operators import surface as V
from tidewatch.operators.blocks import asof_forward, asof_growing, asof_join, latest, previous, trailing_sum
from tidewatch.operators.calibrate import percentiles

from .registry import query
from .surface_rows import BUILD, IV1M, JOINED, surface

R6 = lambda c: F.round(c, 6)
MINUTE = 60_000


def PCT(*ps):
    return ", ".join(f"round(quantile_cont(x, {p}), 6) AS p{int(round(p * 100)):02d}" for p in ps) + ", count(*) AS n"


P3 = PCT(0.9, 0.95, 0.99)


@query("filter_instrument_range", "SELECT seq, side FROM trades WHERE instrument_id = 'SIM:PERP:1' AND ts_ms >= 10000 AND ts_ms < 200000")
def filter_instrument_range(v):
    return X.instrument_range(v.trades, "SIM:PERP:1", 10_000, 200_000).select("seq", "side")


@query("json_field_filter", "SELECT event_id FROM ev WHERE k = 7")
def json_field_filter(v):
    return v.table("events").where(X.json_has("props", "k") & (X.json_text("props", "k") == "7")).select("event_id")


@query("metric_resolve", """
SELECT event_id, CASE WHEN k % 3 <> 0 THEN round(-value, 6) ELSE round(value / 2, 6) END AS value, CASE WHEN k % 3 <> 0 THEN 'basis_doc' ELSE 'basis' END AS used_key, CASE WHEN k % 3 <> 0 THEN 'doc' ELSE 'legacy' END AS used_source FROM ev""")
def metric_resolve(v):
    got = X.resolve_metric(F.when(F.col("k") % 3 != 0, F.col("value")).otherwise(F.lit(float("nan"))), F.col("value") / 2, "basis_doc", "basis", "auto", flip_doc=True)
    return v.ev.select("event_id", got.alias("m")).select("event_id", R6(F.col("m.value")).alias("value"), "m.used_key", "m.used_source")


@query("option_gates", f"SELECT instrument_id, seq, seq2 FROM {JOINED} WHERE expiry_days > 10 AND expiry_days < 60 AND strike BETWEEN 105 * 0.9 AND 105 * 1.1 AND abs(delta) BETWEEN 0.2 AND 0.8")
def option_gates(v):
    return X.gate_options(X.with_instruments(v.options_ticker, v.options_instruments), 10, 60, 105.0, 0.1, 0.2, 0.8).select("instrument_id", "seq", "seq2")


@query("quote_gate", "SELECT instrument_id, seq, seq2 FROM options_ticker WHERE seq % 4 <> 0")
def quote_gate(v):
    return X.quoted(v.options_ticker.withColumn("bid", F.when(F.col("seq") % 4 != 0, F.col("bid"))), True).select("instrument_id", "seq", "seq2")


@query("join_ticker_instrument", f"SELECT instrument_id, seq, seq2, strike, option_type, round(mark_iv, 6) AS mark_iv FROM {JOINED}")
def join_ticker_instrument(v):
    return X.with_instruments(v.options_ticker, v.options_instruments).select("instrument_id", "seq", "seq2", "strike", "option_type", R6(F.col("mark_iv")).alias("mark_iv"))


@query("join_cross_scalar", "s AS (SELECT max(price) AS spot FROM trades) SELECT instrument_id, round(strike / spot, 6) AS moneyness FROM options_instruments, s")
def join_cross_scalar(v):
    spot = v.trades.agg(F.max("price").alias("spot"))  # one row
    return v.options_instruments.crossJoin(F.broadcast(spot)).select("instrument_id", R6(F.col("strike") / F.col("spot")).alias("moneyness"))


@query("join_using_time", "a AS (SELECT ts_ms // 60000 AS minute, avg(long_ratio) AS a FROM account_ratio GROUP BY 1), p AS (SELECT ts_ms // 60000 AS minute, avg(long_ratio) AS p FROM position_ratio GROUP BY 1) SELECT minute, round(a - p, 6) AS gap FROM a JOIN p USING (minute)")
def join_using_time(v):
    side = lambda df, n: df.groupBy(F.floor(F.col("ts_ms") / MINUTE).alias("minute")).agg(F.avg("long_ratio").alias(n))
    return side(v.account_ratio, "a").join(side(v.position_ratio, "p"), "minute").select("minute", R6(F.col("a") - F.col("p")).alias("gap"))


ASOF_BACK = "LEFT JOIN LATERAL (SELECT p.{c} AS v FROM {t} p WHERE p.instrument_id = x.instrument_id AND p.ts_ms <= x.ts_ms - {w} ORDER BY p.ts_ms DESC, p.seq DESC LIMIT 1) r ON true"


@query("asof_backward", f"SELECT x.instrument_id, x.seq, r.v AS ref FROM open_interest x {ASOF_BACK.format(c='open_interest', t='open_interest', w=5000)}")
def asof_backward(v):
    return asof_growing(v.open_interest, ["instrument_id"], F.col("open_interest"), 5000).select("instrument_id", "seq", F.col("ref.v").alias("ref"))


@query("asof_forward", "SELECT x.instrument_id, x.seq, r.v AS ahead FROM mark_funding x LEFT JOIN LATERAL (SELECT p.funding_rate AS v FROM mark_funding p WHERE p.instrument_id = x.instrument_id AND p.ts_ms >= x.ts_ms + 9000 ORDER BY p.ts_ms, p.seq LIMIT 1) r ON true")
def asof_forward_q(v):
    return asof_forward(v.mark_funding, ["instrument_id"], F.col("funding_rate"), 9000).select("instrument_id", "seq", F.col("ahead.v").alias("ahead"))


@query("asof_poll", "g AS (SELECT instrument_id, unnest(range(0, (SELECT max(ts_ms) FROM ev), 30000)) AS ts_ms FROM (SELECT DISTINCT instrument_id FROM ev)) SELECT x.instrument_id, x.ts_ms, r.v AS oi FROM g x " + ASOF_BACK.format(c="open_interest", t="open_interest", w=0))
def asof_poll(v):
    return asof_join(X.poll_grid(v.ev, 30_000), v.open_interest, ["instrument_id"], F.col("open_interest"), "oi")


@query("liq_window_by_side", "SELECT x.instrument_id, x.seq, x.side, round((SELECT sum(coalesce(p.quote_qty_usd, p.qty)) FROM liquidations p WHERE p.instrument_id = x.instrument_id AND p.side = x.side AND p.seq <= x.seq AND p.ts_ms >= x.ts_ms - 60000), 4) AS volume FROM liquidations x")
def liq_window_by_side(v):
    got = trailing_sum(v.liquidations, ["instrument_id", "side"], F.coalesce("quote_qty_usd", "qty"), 60_000, "volume")
    return got.select("instrument_id", "seq", "side", F.round("volume", 4).alias("volume"))


@query("liq_minute_by_side", "SELECT ts_ms // 60000 AS minute, side, round(coalesce(sum(quote_qty_usd), sum(qty)), 4) AS volume FROM liquidations GROUP BY ALL")
def liq_minute_by_side(v):
    return v.liquidations.groupBy(F.floor(F.col("ts_ms") / MINUTE).alias("minute"), "side").agg(F.round(F.coalesce(F.sum("quote_qty_usd"), F.sum("qty")), 4).alias("volume"))


FLOW = "SELECT ts_ms // 1000 AS sec, sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) AS buy, sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END) AS sell, count(*) AS n, sum(qty) AS total FROM trades GROUP BY 1"


@query("trades_per_second_flow", f"f AS ({FLOW}) SELECT sec, buy, sell, n, round((buy - sell) / nullif(buy + sell, 0), 6) AS ofi FROM f")
def trades_per_second_flow(v):
    return X.flow_per_second(v.trades).select("sec", "buy", "sell", "n", R6(F.col("ofi")).alias("ofi"))


@query("surface_bucket_avg", f"SELECT expiry_days, round(sum(mark_iv * open_interest) / sum(open_interest), 6) AS iv, count(*) AS n FROM {JOINED} GROUP BY 1")
def surface_bucket_avg(v):
    return X.with_instruments(v.options_ticker, v.options_instruments).groupBy("expiry_days").agg(R6(X.weighted_mean("mark_iv", "open_interest")).alias("iv"), F.count("*").alias("n"))


@query("iv_surface_1m", f"{IV1M} SELECT bucket, underlying, round(iv, 6) AS iv_avg, round(rr, 6) AS rr_25d_avg, round(bf, 6) AS bf_25d_avg FROM m")
def iv_surface_1m(v):
    return V.by_minute(surface(v)).select("bucket", "underlying", *(R6(F.col(c)).alias(c) for c in ("iv_avg", "rr_25d_avg", "bf_25d_avg")))


GEX = "least(gamma, 1) * least(open_interest, 1e6) * 105 * 105 * CASE WHEN option_type = 'C' THEN 1 ELSE -1 END"
LATEST_TICK = "t AS (SELECT * FROM options_ticker QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY ts_ms DESC, seq DESC, seq2 DESC) = 1)"


@query("gex_net", f"{LATEST_TICK}, g AS (SELECT option_type, {GEX} AS x FROM t JOIN options_instruments USING (instrument_id)) SELECT round(sum(x), 3) AS net, round(sum(CASE WHEN option_type = 'C' THEN x ELSE 0 END), 3) AS calls, round(sum(CASE WHEN option_type = 'P' THEN x ELSE 0 END), 3) AS puts, count(*) AS n_used FROM g")
def gex_net(v):
    rows = X.with_instruments(latest(v.options_ticker, ["instrument_id"], "ts_ms", "seq", "seq2"), v.options_instruments)
    got = X.gamma_exposure(rows).groupBy().agg(F.sum("gex").alias("net"), F.sum(F.when(F.col("option_type") == "C", F.col("gex")).otherwise(0.0)).alias("calls"), F.sum(F.when(F.col("option_type") == "P", F.col("gex")).otherwise(0.0)).alias("puts"), F.count("*").alias("n_used"))
    return got.select(F.round("net", 3).alias("net"), F.round("calls", 3).alias("calls"), F.round("puts", 3).alias("puts"), "n_used")


@query("gex_per_minute", f"SELECT ts_ms // 60000 AS minute, round(sum({GEX}), 3) AS net FROM {JOINED} GROUP BY 1")
def gex_per_minute(v):
    rows = X.gamma_exposure(X.with_instruments(v.options_ticker, v.options_instruments))
    return rows.groupBy(F.floor(F.col("ts_ms") / MINUTE).alias("minute")).agg(F.round(F.sum("gex"), 3).alias("net"))


@query("ticker_iv_mean", f"{LATEST_TICK} SELECT round(avg(least(greatest(mark_iv, 0.35), 0.65)), 6) AS iv, count(*) AS n, max(ts_ms) AS ts_ms FROM t JOIN options_instruments USING (instrument_id) WHERE expiry_days > 10 AND abs(delta) BETWEEN 0.2 AND 0.8 HAVING count(*) >= 5")
def ticker_iv_mean(v):
    rows = X.with_instruments(latest(v.options_ticker, ["instrument_id"], "ts_ms", "seq", "seq2"), v.options_instruments).where((F.col("expiry_days") > 10) & F.abs("delta").between(0.2, 0.8))
    return rows.agg(R6(F.avg(X.clamp(F.col("mark_iv"), 0.35, 0.65))).alias("iv"), F.count("*").alias("n"), F.max("ts_ms").alias("ts_ms")).where("n >= 5")


OI_RUN = """
d AS (SELECT t.*, i.underlying, i.option_type, t.open_interest - coalesce(lag(t.open_interest) OVER (PARTITION BY t.instrument_id ORDER BY t.ts_ms, t.seq, t.seq2, t.open_interest), 0) AS x FROM options_ticker t JOIN options_instruments i USING (instrument_id)),
o AS (SELECT instrument_id, ts_ms, seq, seq2, open_interest, underlying, sum(CASE WHEN option_type = 'C' THEN x ELSE 0 END) OVER w AS calls, sum(CASE WHEN option_type = 'P' THEN x ELSE 0 END) OVER w AS puts FROM d WINDOW w AS (PARTITION BY underlying ORDER BY ts_ms, seq, seq2, instrument_id, open_interest))"""


@query("oi_calls_puts_running", f"{OI_RUN} SELECT instrument_id, seq, seq2, calls, puts FROM o")
def oi_calls_puts_running(v):
    return X.running_oi(X.with_instruments(v.options_ticker, v.options_instruments)).select("instrument_id", "seq", "seq2", "calls", "puts")


LIVE = "SELECT '{t}' AS stream, max(ts_ms) AS last_ms, count(*) AS n FROM {t}"


@query("liveness_lag", "SELECT instrument_id, max(ts_ms) AS last_ms, (1000000 - max(ts_ms)) / 1000.0::DOUBLE AS lag_s, avg(k) AS latency, count(*) AS n FROM ev GROUP BY 1")
def liveness_lag(v):
    return v.ev.groupBy("instrument_id").agg(F.max("ts_ms").alias("last_ms"), ((F.lit(1_000_000) - F.max("ts_ms")) / 1000.0).alias("lag_s"), F.avg("k").alias("latency"), F.count("*").alias("n"))


@query("liveness_filtered_agg", "SELECT min(ts_ms) FILTER (WHERE k > 90) AS first_ms, count(*) FILTER (WHERE k > 90) AS n FROM ev")
def liveness_filtered_agg(v):
    return v.ev.agg(F.min(F.when(F.col("k") > 90, F.col("ts_ms"))).alias("first_ms"), F.count_if(F.col("k") > 90).alias("n"))


@query("metrics_last_seen_topn", "SELECT event_type AS metric, k % 5 AS window_s, max(ts_ms) AS last_ms FROM ev GROUP BY ALL ORDER BY last_ms DESC, metric LIMIT 12")
def metrics_last_seen_topn(v):
    return v.ev.groupBy(F.col("event_type").alias("metric"), (F.col("k") % 5).alias("window_s")).agg(F.max("ts_ms").alias("last_ms")).orderBy(F.desc("last_ms"), "metric").limit(12)


@query("surface_1m_health", f"{IV1M} SELECT min(bucket) AS first_bucket, max(bucket) AS last_bucket, count(*) AS n, count(rr) AS n_rr FROM m")
def surface_1m_health(v):
    return V.by_minute(surface(v)).agg(F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"), F.count("*").alias("n"), F.count("rr_25d_avg").alias("n_rr"))


@query("surface_coverage", f"{BUILD} SELECT count(*) AS n, max(minute) AS newest, count(DISTINCT minute) AS minutes FROM sf")
def surface_coverage(v):
    return surface(v).groupBy("minute").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.max("minute").alias("newest"), F.count("*").alias("minutes"))


@query("surface_key_violations", f"{BUILD}, twice AS (SELECT underlying, minute - minute % 2 AS pair, tenor, band FROM sf) SELECT underlying, pair, tenor, band, count(*) AS n FROM twice GROUP BY ALL HAVING count(*) > 1")
def surface_key_violations(v):
    # The surface has no double keys; with minutes taken in pairs it has.
    return V.violations(surface(v).withColumn("pair", F.col("minute") - F.col("minute") % 2), ["underlying", "pair", "tenor", "band"])


@query("surface_minute_max", f"SELECT ts_ms // 60000 AS minute, expiry_days, round(max(mark_iv), 6) AS iv, max(ts_ms) AS last_ms FROM {JOINED} GROUP BY ALL")
def surface_minute_max(v):
    return X.with_instruments(v.options_ticker, v.options_instruments).groupBy(F.floor(F.col("ts_ms") / MINUTE).alias("minute"), "expiry_days").agg(R6(F.max("mark_iv")).alias("iv"), F.max("ts_ms").alias("last_ms"))


@query("events_per_hour", "SELECT event_type, ts_ms // 3600000 AS hour, count(*) AS n FROM ev GROUP BY ALL")
def events_per_hour(v):
    return v.ev.groupBy("event_type", F.floor(F.col("ts_ms") / 3_600_000).alias("hour")).agg(F.count("*").alias("n"))


@query("distinct_expiries", "SELECT DISTINCT underlying, expiry_days FROM options_instruments")
def distinct_expiries(v):
    return v.options_instruments.select("underlying", "expiry_days").distinct()


# Sorts, limits and set operations.
@query("topk_recent", "SELECT instrument_id, seq, qty FROM trades ORDER BY ts_ms DESC LIMIT 50")
def topk_recent(v):
    return v.trades.orderBy(F.desc("ts_ms")).limit(50).select("instrument_id", "seq", "qty")


@query("surface_latest_rows", f"{BUILD} SELECT minute, tenor, band, round(iv, 6) AS iv, n_used::VARCHAR AS n_used, 'oi' AS weights_used FROM sf ORDER BY minute DESC, tenor, band LIMIT 10")
def surface_latest_rows(v):
    rows = surface(v).withColumn("meta", V.meta()).orderBy(F.desc("minute"), "tenor", "band").limit(10)
    return rows.select("minute", "tenor", "band", R6(F.col("iv")).alias("iv"), *(F.get_json_object("meta", f"$.{c}").alias(c) for c in ("n_used", "weights_used")))


@query("surface_at_max_time", "SELECT instrument_id, seq, seq2 FROM options_ticker WHERE ts_ms = (SELECT max(ts_ms) FROM options_ticker)")
def surface_at_max_time(v):
    newest = v.options_ticker.agg(F.max("ts_ms").alias("ts_ms"))
    return v.options_ticker.join(F.broadcast(newest), "ts_ms", "left_semi").select("instrument_id", "seq", "seq2")


@query("multi_key_sort", "SELECT instrument_id, seq FROM trades ORDER BY instrument_id, ts_ms")
def multi_key_sort(v):
    return v.trades.orderBy("instrument_id", "ts_ms").select("instrument_id", "seq")


@query("union_liveness", " UNION ALL ".join(LIVE.format(t=t) for t in ("trades", "depth", "mark_funding", "liquidations", "open_interest")))
def union_liveness(v):
    one = lambda t: getattr(v, t).agg(F.max("ts_ms").alias("last_ms"), F.count("*").alias("n")).select(F.lit(t).alias("stream"), "last_ms", "n")
    out = one("trades")
    for t in ("depth", "mark_funding", "liquidations", "open_interest"):
        out = out.unionByName(one(t))
    return out


# Scalar functions.
@query("scalar_math", "SELECT event_id, round(least(greatest(value, 10), 90), 6) AS clamped, round(least(greatest((value - 50) / 200, 0), 1), 6) AS norm, round(ln(1 + value), 6) AS log_severity, sign(k - 50)::INTEGER AS sgn, value / greatest(k, 1e-9) AS ratio, (abs(value - k) <= 5 OR abs(value - k) <= 0.1 * greatest(abs(value), abs(k)))::BOOLEAN AS near, floor(abs(value - k) / 0.5)::BIGINT AS ticks FROM ev")
def scalar_math(v):
    a, b = F.col("value"), F.col("k").cast("double")
    return v.ev.select("event_id", R6(X.clamp(a, 10, 90)).alias("clamped"), R6(X.intensity(a, 50, 250)).alias("norm"), R6(F.log1p(a)).alias("log_severity"), F.signum(b - 50).cast("int").alias("sgn"), X.safe_divide(a, b).alias("ratio"), X.close(a, b, 5.0, 0.1).alias("near"), X.ticks(a, b, 0.5).alias("ticks"))


@query("scalar_text", "SELECT event_id, upper(event_type) || ':' || user_id::VARCHAR AS id, instrument_id LIKE 'SIM:PERP:1%' AS mine, substring(sha1(event_type), 1, 8) AS h FROM ev")
def scalar_text(v):
    return v.ev.select("event_id", F.concat_ws(":", F.upper("event_type"), F.col("user_id").cast("string")).alias("id"), F.col("instrument_id").like("SIM:PERP:1%").alias("mine"), F.substring(F.sha1(F.col("event_type").cast("binary")), 1, 8).alias("h"))


# Percentile calibration.
@query("calib_liq", f"x AS (SELECT side, coalesce(sum(quote_qty_usd), sum(qty)) AS x FROM liquidations GROUP BY ts_ms // 60000, side) SELECT side, {P3} FROM x GROUP BY side")
def calib_liq(v):
    rows = v.liquidations.groupBy(F.floor(F.col("ts_ms") / MINUTE), "side").agg(F.coalesce(F.sum("quote_qty_usd"), F.sum("qty")).alias("x"))
    return percentiles(rows, F.col("x"), by=["side"])


BASIS = "(mark_price / index_price - 1) * 1e4"


@query("calib_basis", f"x AS (SELECT {BASIS} AS x FROM mark_funding) SELECT {PCT(0.01, 0.05, 0.5, 0.95, 0.99)} FROM x")
def calib_basis(v):
    return percentiles(v.mark_funding, X.basis_bps(), (0.01, 0.05, 0.5, 0.95, 0.99))


VEL = f"b AS (SELECT instrument_id, seq, ts_ms, {BASIS} AS b FROM mark_funding), x AS (SELECT abs((b - lag(b) OVER w) / greatest((ts_ms - lag(ts_ms) OVER w) / 1000.0::DOUBLE, 1e-6)) AS x, abs(b) AS y FROM b WINDOW w AS (PARTITION BY instrument_id ORDER BY ts_ms, seq))"


@query("calib_basis_velocity", f"{VEL} SELECT {P3.replace('count(*)', 'count(x)')} FROM x")
def calib_basis_velocity(v):
    return percentiles(X.basis_velocity(v.mark_funding), F.abs("velocity"))


@query("calib_basis_abs", f"{VEL} SELECT {P3.replace('quantile_cont(x', 'quantile_cont(y')} FROM x")
def calib_basis_abs(v):
    return percentiles(X.basis_velocity(v.mark_funding), F.abs("basis"))


@query("calib_funding_trend", "y AS (SELECT (r.v - x.funding_rate) * 1e6 / ((r.t - x.ts_ms) / 1000.0::DOUBLE) AS s FROM mark_funding x JOIN LATERAL (SELECT p.funding_rate AS v, p.ts_ms AS t FROM mark_funding p WHERE p.instrument_id = x.instrument_id AND p.ts_ms >= x.ts_ms + 9000 ORDER BY p.ts_ms, p.seq LIMIT 1) r ON true), x AS (SELECT abs(s) AS x FROM y) SELECT " + P3 + " FROM x")
def calib_funding_trend(v):
    rows = asof_forward(v.mark_funding, ["instrument_id"], F.col("funding_rate"), 9000)
    return percentiles(rows, F.abs((F.col("ahead.v") - F.col("funding_rate")) * 1e6 / ((F.col("ahead.ts_ms") - F.col("ts_ms")) / 1000.0)))


DELTA = "b AS (SELECT x.instrument_id, x.seq, x.{c} - r.v AS d, x.ts_ms - r.t AS dt, r.v AS p FROM {t} x JOIN LATERAL (SELECT p.{c} AS v, p.ts_ms AS t FROM {t} p WHERE p.instrument_id = x.instrument_id AND p.ts_ms <= x.ts_ms - {w} ORDER BY p.ts_ms DESC, p.seq DESC LIMIT 1) r ON true)"


def _delta(df, column, back_ms):
    rows = asof_growing(df, ["instrument_id"], F.col(column), back_ms)
    return rows.withColumns({"d": F.col(column) - F.col("ref.v"), "dt": F.col("ts_ms") - F.col("ref.ts_ms"), "p": F.col("ref.v")})


@query("calib_oi_pct", DELTA.format(c="open_interest", t="open_interest", w=120000) + f", x AS (SELECT abs(d / nullif(p, 0)) * 100 AS x FROM b) SELECT {P3} FROM x")
def calib_oi_pct(v):
    return percentiles(_delta(v.open_interest, "open_interest", 120_000), F.abs(F.col("d") / F.nullif("p", F.lit(0.0))) * 100)


def _iv1m(v):
    rows = V.by_minute(surface(v)).withColumnsRenamed({"iv_avg": "iv", "rr_25d_avg": "rr", "bf_25d_avg": "bf"})
    return rows.withColumns({"instrument_id": F.col("underlying"), "ts_ms": F.col("bucket") * MINUTE, "seq": F.col("bucket")})


ASOF_M = "b AS (SELECT m.bucket, m.{c} - r.v AS d, (m.bucket - r.t) * 60.0::DOUBLE AS dt, r.v AS p FROM m JOIN LATERAL (SELECT q.{c} AS v, q.bucket AS t FROM m q WHERE q.bucket <= m.bucket - {k} ORDER BY q.bucket DESC LIMIT 1) r ON true)"


@query("calib_iv_delta", f"{IV1M}, {ASOF_M.format(c='iv', k=5)}, x AS (SELECT d AS x FROM b) SELECT {P3.replace('count(*)', 'count(x)')} FROM x")
def calib_iv_delta(v):
    return percentiles(_delta(_iv1m(v), "iv", 5 * MINUTE), F.col("d"))


@query("calib_iv_pct", f"{IV1M}, {ASOF_M.format(c='iv', k=1)}, x AS (SELECT d / p * 100 AS x FROM b) SELECT {P3.replace('count(*)', 'count(x)')} FROM x")
def calib_iv_pct(v):
    return percentiles(_delta(_iv1m(v), "iv", MINUTE), F.col("d") / F.col("p") * 100)


@query("calib_skew_asof", f"{IV1M}, {ASOF_M.format(c='rr', k=5)}, x AS (SELECT abs(d) AS x FROM b) SELECT {P3.replace('count(*)', 'count(x)')} FROM x")
def calib_skew_asof(v):
    return percentiles(_delta(_iv1m(v), "rr", 5 * MINUTE), F.abs("d"))


@query("calib_skew_lag", f"{IV1M}, x AS (SELECT abs(rr - lag(rr) OVER (ORDER BY bucket)) AS x FROM m) SELECT {P3.replace('count(*)', 'count(x)')} FROM x")
def calib_skew_lag(v):
    rows = previous(_iv1m(v), ["instrument_id"], ["rr"])
    return percentiles(rows, F.abs(F.col("rr") - F.col("was.rr")))


@query("calib_surface_iv_delta", f"{IV1M}, x AS (SELECT (iv - lag(iv) OVER w) * 1e3 / greatest((bucket - lag(bucket) OVER w) * 60.0::DOUBLE, 1) AS x FROM m WINDOW w AS (ORDER BY bucket)) SELECT {P3.replace('count(*)', 'count(x)')} FROM x")
def calib_surface_iv_delta(v):
    rows = previous(_iv1m(v), ["instrument_id"], ["bucket", "iv"])
    dt = F.greatest((F.col("bucket") - F.col("was.bucket")) * 60.0, F.lit(1.0))
    return percentiles(rows, (F.col("iv") - F.col("was.iv")) * 1e3 / dt)


TERM = f"{BUILD}, s AS (SELECT minute AS bucket, underlying, max(iv) FILTER (WHERE tenor = '0_7d') - max(iv) FILTER (WHERE tenor = '30_90d') AS sp FROM sf WHERE band = 'NA' GROUP BY ALL HAVING sp IS NOT NULL)"


def _term(v):
    of = lambda t: F.max(F.when(F.col("tenor") == t, F.col("iv")))
    rows = surface(v).where("band = 'NA'").groupBy(F.col("minute").alias("bucket"), "underlying").agg((of("0_7d") - of("30_90d")).alias("sp")).where("sp is not null")
    return rows.withColumns({"instrument_id": F.col("underlying"), "ts_ms": F.col("bucket") * MINUTE, "seq": F.col("bucket")})


@query("calib_term_minute_spread", f"{TERM}, x AS (SELECT sp AS x FROM s) SELECT {P3} FROM x")
def calib_term_minute_spread(v):
    return percentiles(_term(v), F.col("sp"))


@query("calib_term_spread", f"{TERM}, x AS (SELECT sp AS x FROM s WHERE sp > 0) SELECT {P3} FROM x")
def calib_term_spread(v):
    return percentiles(_term(v).where("sp > 0"), F.col("sp"))


@query("calib_term_velocity", f"{TERM}, x AS (SELECT abs(s.sp - r.v) * 1e3 / ((s.bucket - r.t) * 60.0::DOUBLE) AS x FROM s JOIN LATERAL (SELECT q.sp AS v, q.bucket AS t FROM s q WHERE q.bucket <= s.bucket - 10 ORDER BY q.bucket DESC LIMIT 1) r ON true) SELECT {P3} FROM x")
def calib_term_velocity(v):
    return percentiles(_delta(_term(v), "sp", 10 * MINUTE), F.abs("d") * 1e3 / (F.col("dt") / 1000.0))


@query("calib_gex", f"x AS (SELECT abs(sum({GEX})) AS x FROM {JOINED} GROUP BY ts_ms // 60000) SELECT {P3.replace(', 6)', ', 2)')} FROM x")
def calib_gex(v):
    rows = X.gamma_exposure(X.with_instruments(v.options_ticker, v.options_instruments)).groupBy(F.floor(F.col("ts_ms") / MINUTE)).agg(F.abs(F.sum("gex")).alias("x"))
    got = percentiles(rows, F.col("x"))
    return got.select(*(F.round(c, 2).alias(c) for c in ("p90", "p95", "p99")), "n")


@query("calib_tape", f"f AS ({FLOW}), x AS (SELECT 'ofi' AS metric, (buy - sell) / nullif(buy + sell, 0) AS x FROM f WHERE n >= 10 UNION ALL SELECT 'qty', buy + sell FROM f WHERE n >= 10) SELECT metric, {P3} FROM x WHERE x IS NOT NULL GROUP BY 1")
def calib_tape(v):
    busy = X.flow_per_second(v.trades).where("n >= 10")
    both = F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), x.alias("x")) for name, x in (("ofi", F.col("ofi")), ("qty", F.col("buy") + F.col("sell"))))))
    return percentiles(busy.select(both.alias("m")).select("m.*"), F.col("x"), by=["metric"])


@query("calib_top_traders_raw", f"x AS (SELECT long_ratio AS x FROM account_ratio) SELECT {PCT(0.95, 0.99)} FROM x")
def calib_top_traders_raw(v):
    return percentiles(v.account_ratio, F.col("long_ratio"), (0.95, 0.99))


@query("calib_top_traders", f"x AS (SELECT 'SIM:PERP:' || (user_id % 4)::VARCHAR AS instrument_id, json_extract(props, '$.k')::DOUBLE / 100 AS x FROM events WHERE event_type = 'purchase') SELECT instrument_id, {P3} FROM x GROUP BY 1")
def calib_top_traders(v):
    """Ratios out of the events' JSON, parsed once into a variant and read by path."""
    rows = v.table("events").where("event_type = 'purchase'").select(F.concat(F.lit("SIM:PERP:"), (F.col("user_id") % 4).cast("string")).alias("instrument_id"), F.try_parse_json("props").alias("fields"))
    return percentiles(rows.select("instrument_id", (F.try_variant_get("fields", "$.k", "double") / 100).alias("ratio")), F.col("ratio"), by=["instrument_id"])
