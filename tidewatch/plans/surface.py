"""Volatility-surface queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import surface as V

from .registry import query
from .surface_rows import BAND, BUILD, JOINED, TENOR, parts_sql, surface, ticks

R6 = lambda c: F.round(c, 6)
MONEY = BAND.format(m="(strike / underlying_price)")


@query("tenor_bucket", f"SELECT instrument_id, {TENOR.format(d='expiry_days')} AS tenor FROM options_instruments")
def tenor_bucket(v):
    return v.options_instruments.select("instrument_id", V.tenor(F.col("expiry_days")).alias("tenor"))


@query("moneyness_bucket", f"SELECT instrument_id, seq, seq2, {MONEY} AS band FROM {JOINED}")
def moneyness_bucket(v):
    return ticks(v).select("instrument_id", "seq", "seq2", V.band(F.col("strike") / F.col("underlying_price")).alias("band"))


@query("surface_spot", "SELECT arg_max(underlying_price, (ts_ms, seq, seq2)) AS spot FROM options_ticker WHERE starts_with(instrument_id, 'OPT:1')")
def surface_spot(v):
    return V.spot(v.options_ticker, "OPT:1")


@query("surface_expiries", f"d AS (SELECT DISTINCT underlying, expiry_days, {TENOR.format(d='expiry_days')} AS tenor FROM options_instruments) SELECT * FROM (SELECT underlying, tenor, expiry_days, row_number() OVER (PARTITION BY underlying, tenor ORDER BY expiry_days) AS n FROM d WHERE tenor IS NOT NULL) WHERE n <= 3")
def surface_expiries(v):
    return V.expiries(v.options_instruments).select("underlying", "tenor", "expiry_days", F.col("n").cast("long").alias("n"))


@query("pick_by_delta", f"{parts_sql(JOINED, 'expiry_days')} SELECT expiry_days, round(c.iv, 6) AS iv_call, round(p.iv, 6) AS iv_put FROM cp")
def pick_by_delta(v):
    return V.components(ticks(v), ["expiry_days"]).select("expiry_days", R6("iv_call").alias("iv_call"), R6("iv_put").alias("iv_put"))


@query("pick_atm", f"{parts_sql(JOINED, 'expiry_days')} SELECT expiry_days, round(a.iv, 6) AS iv_atm FROM cp")
def pick_atm(v):
    return V.components(ticks(v), ["expiry_days"]).select("expiry_days", R6("iv_atm").alias("iv_atm"))


@query("rr_bf_atm", f"x AS (SELECT *, ts_ms // 3600000 AS hour FROM {JOINED}), {parts_sql('x', 'hour, expiry_days')} SELECT hour, expiry_days, round(c.iv - p.iv, 6) AS rr_25d, round(0.5 * (c.iv + p.iv) - a.iv, 6) AS bf_25d, coalesce(nullif(coalesce(c.oi, 0) + coalesce(p.oi, 0) + coalesce(a.oi, 0), 0), 1) AS weight FROM cp")
def rr_bf_atm(v):
    rows = ticks(v).withColumn("hour", F.floor(F.col("ts_ms") / 3_600_000))
    return V.components(rows, ["hour", "expiry_days"]).select("hour", "expiry_days", R6("rr_25d").alias("rr_25d"), R6("bf_25d").alias("bf_25d"), "weight")


@query("moneyness_iv", f"m AS (SELECT *, {MONEY} AS band FROM {JOINED}) SELECT expiry_days, band, round(coalesce(sum(mark_iv * open_interest) / nullif(sum(open_interest), 0), 0), 6) AS iv, count(*) AS n_used FROM m WHERE band IS NOT NULL GROUP BY ALL")
def moneyness_iv(v):
    return V.band_iv(ticks(v), ["expiry_days"]).select("expiry_days", "band", R6("iv").alias("iv"), "n_used")


SURFACE = "minute, underlying, tenor, band, round(iv, 6) AS iv, round(rr_25d, 6) AS rr_25d, round(bf_25d, 6) AS bf_25d, n_expiries_used, n_used, round(sum_weights, 4) AS sum_weights, expiry_min, expiry_max, missing_call, missing_put, missing_atm"


@query("surface_build", f"{BUILD} SELECT {SURFACE} FROM sf")
def surface_build(v):
    names = ["n_expiries_used", "n_used", F.round("sum_weights", 4).alias("sum_weights"), "expiry_min", "expiry_max", "missing_call", "missing_put", "missing_atm"]
    # Sums in any order differ in their last bits, which at a tie would decide the sixth place.
    return surface(v).select("minute", "underlying", "tenor", "band", *(R6(F.round(c, 12)).alias(c) for c in ("iv", "rr_25d", "bf_25d")), *names)


@query("option_id_parse", "SELECT instrument_id, underlying, strike, option_type FROM options_instruments")
def option_id_parse(v):
    name = F.concat(F.lit("X:"), "underlying", F.lit("-28NOV25-"), F.col("strike").cast("int").cast("string"), F.lit("-"), "option_type")
    return v.options_instruments.select("instrument_id", V.option_parts(name).alias("o")).select("instrument_id", "o.underlying", "o.strike", "o.option_type")
