"""Rolling windows, references back in time, and sequence continuity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators import rolling as R
from tidewatch.operators.blocks import latest, previous

from .registry import query

R6 = lambda c: F.round(c, 6)
KEY = ["instrument_id"]
REF = "LEFT JOIN LATERAL (SELECT p.{c} AS v, p.ts_ms AS t FROM {t} p WHERE p.instrument_id = x.instrument_id AND p.ts_ms <= x.ts_ms - {w} AND p.ts_ms >= x.ts_ms - {age} ORDER BY p.ts_ms DESC, p.seq DESC LIMIT 1) r ON true"
MARK_REF = REF.format(c="mark_price", t="mark_funding", w=5000, age=20000)


@query("roll_mean", "SELECT x.instrument_id, x.seq, round((SELECT avg(p.mark_price) FROM mark_funding p WHERE p.instrument_id = x.instrument_id AND p.ts_ms <= x.ts_ms AND p.ts_ms >= x.ts_ms - 5000), 6) AS mean FROM mark_funding x")
def roll_mean(v):
    return R.mean(v.mark_funding, KEY, "mark_price", 5000).select("instrument_id", "seq", R6("mean").alias("mean"))


@query("roll_ref", f"SELECT x.instrument_id, x.seq, round(r.v, 6) AS ref, r.t AS ref_ms FROM mark_funding x {MARK_REF}")
def roll_ref(v):
    return R.delta(v.mark_funding, KEY, "mark_price", 5000, 20000).select("instrument_id", "seq", R6("ref.v").alias("ref"), F.col("ref.ts_ms").alias("ref_ms"))


@query("roll_delta", f"SELECT x.instrument_id, x.seq, round(x.mark_price - r.v, 6) AS delta FROM mark_funding x {MARK_REF}")
def roll_delta(v):
    return R.delta(v.mark_funding, KEY, "mark_price", 5000, 20000).select("instrument_id", "seq", R6("delta").alias("delta"))


@query("roll_derivative", f"SELECT x.instrument_id, x.seq, round((x.mark_price - r.v) / ((x.ts_ms - r.t) / 1000.0::DOUBLE), 6) AS slope FROM mark_funding x {MARK_REF}")
def roll_derivative(v):
    return R.derivative(v.mark_funding, KEY, "mark_price", 5000, 20000).select("instrument_id", "seq", R6("slope").alias("slope"))


SECOND = f"a AS (SELECT x.instrument_id, x.ts_ms, x.seq, x.mark_price, r.v, r.t FROM mark_funding x {MARK_REF}), d AS (SELECT *, (mark_price - v) / ((ts_ms - t) / 1000.0::DOUBLE) AS slope FROM a)"


@query("roll_second_derivative", SECOND + " SELECT x.instrument_id, x.seq, round((x.slope - p.slope) / ((x.ts_ms - p.ts_ms) / 1000.0::DOUBLE), 6) AS accel FROM d x LEFT JOIN d p ON p.instrument_id = x.instrument_id AND p.ts_ms = x.t")
def roll_second_derivative(v):
    return R.second_derivative(v.mark_funding, KEY, "mark_price", 5000, 20000).select("instrument_id", "seq", R6("accel").alias("accel"))


@query("roll_trim_clean", "SELECT instrument_id, event_id AS seq, value FROM ev WHERE k % 11 <> 0 AND k % 13 <> 0")
def roll_trim_clean(v):
    odd = F.when(F.col("k") % 11 == 0, F.lit(float("nan"))).when(F.col("k") % 13 == 0, F.lit(None)).otherwise(F.col("value"))
    return R.clean(v.ev.withColumn("value", odd), "value").select("instrument_id", F.col("event_id").alias("seq"), "value")


@query("lag_prev", "SELECT instrument_id, seq, round(lag(open_interest) OVER w, 6) AS prev, ts_ms - lag(ts_ms) OVER w AS dt FROM open_interest WINDOW w AS (PARTITION BY instrument_id ORDER BY ts_ms)")
def lag_prev(v):
    rows = previous(v.open_interest, KEY, ["ts_ms", "open_interest"])
    return rows.select("instrument_id", "seq", R6(F.col("was.open_interest")).alias("prev"), (F.col("ts_ms") - F.col("was.ts_ms")).alias("dt"))


@query("latest_per_instrument", "SELECT instrument_id, ts_ms, seq, seq2 FROM options_ticker QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY ts_ms DESC, seq DESC, seq2 DESC) = 1")
def latest_per_instrument(v):
    return latest(v.options_ticker, KEY, "ts_ms", "seq", "seq2").select("instrument_id", "ts_ms", "seq", "seq2")


@query("latest_one", "SELECT instrument_id, seq, round(mark_price, 6) AS mark_price FROM mark_funding ORDER BY ts_ms DESC LIMIT 1")
def latest_one(v):
    newest = F.max_by(F.struct("instrument_id", "seq", R6(F.col("mark_price")).alias("mark_price")), F.struct("ts_ms", "seq")).alias("m")
    return v.mark_funding.agg(newest).select("m.*")


@query("oi_delta_pct", f"SELECT x.instrument_id, x.seq, round((x.open_interest - r.v) / nullif(r.v, 0) * 100, 6) AS pct FROM open_interest x {REF.format(c='open_interest', t='open_interest', w=120000, age=1000000000)}")
def oi_delta_pct(v):
    return R.percent_change(v.open_interest, KEY, "open_interest", 120_000).select("instrument_id", "seq", R6("pct").alias("pct"))


@query("funding_trend", f"SELECT x.instrument_id, x.seq, round((x.funding_rate - r.v) * 1e6 / greatest((x.ts_ms - r.t) / 1000.0::DOUBLE, 1), 6) AS trend FROM mark_funding x {REF.format(c='funding_rate', t='mark_funding', w=9000, age=1000000000)}")
def funding_trend(v):
    return R.trend(v.mark_funding, KEY, "funding_rate", 9_000).select("instrument_id", "seq", R6(F.col("trend") * 1e6).alias("trend"))


GAP = "m AS (SELECT *, max(u) OVER (PARTITION BY instrument_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_u FROM depth_seq)"


@query("gap_classify", f"{GAP} SELECT instrument_id, seq, CASE WHEN last_u IS NULL THEN 'first' WHEN pu = last_u THEN 'in_sync' WHEN pu < last_u THEN 'stale' WHEN pu - last_u >= 500000 THEN 'huge_gap' ELSE 'gap' END AS kind FROM m")
def gap_classify(v):
    return R.continuity(v.depth_seq).select("instrument_id", "seq", "kind")


@query("gap_classify_overlap", f"{GAP} SELECT instrument_id, seq, CASE WHEN last_u IS NULL THEN 'first' WHEN pu = last_u OR (first_u <= last_u + 1 AND u >= last_u + 1) THEN 'in_sync' WHEN u <= last_u THEN 'stale' ELSE 'gap' END AS kind FROM m")
def gap_classify_overlap(v):
    return R.continuity_overlap(v.depth_seq).select("instrument_id", "seq", "kind")


@query("gap_classify_option_book", "SELECT instrument_id, seq, seq2, coalesce(seq - 1 <> lag(seq) OVER (PARTITION BY instrument_id ORDER BY seq, seq2), false) AS gap FROM options_ticker")
def gap_classify_option_book(v):
    w = Window.partitionBy(*KEY).orderBy("seq", "seq2")
    return R.option_gap(v.options_ticker.withColumn("prev_change_id", F.col("seq") - 1), w).select("instrument_id", "seq", "seq2", "gap")
