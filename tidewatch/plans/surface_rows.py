"""The built surface, for the queries on it, in Spark and as table expressions (``sf``: its rows, ``m``: minute means)."""

from __future__ import annotations

from tidewatch.functions import exprs as X
from tidewatch.operators import surface as V

JOINED = "options_ticker JOIN options_instruments USING (instrument_id)"
TENOR = "CASE WHEN {d} <= 0 THEN NULL WHEN {d} <= 7 THEN '0_7d' WHEN {d} <= 30 THEN '7_30d' WHEN {d} <= 90 THEN '30_90d' WHEN {d} <= 180 THEN '90_180d' END"
BAND = "CASE WHEN {m} >= 0.9 AND {m} < 0.95 THEN '0.90_0.95' WHEN {m} >= 0.95 AND {m} < 1.0 THEN '0.95_1.00' WHEN {m} >= 1.0 AND {m} < 1.05 THEN '1.00_1.05' WHEN {m} >= 1.05 AND {m} < 1.1 THEN '1.05_1.10' END"
CALL = "delta >= 0 AND round(abs(abs(delta) - 0.25), 9) <= 0.05"
PUT = "delta <= 0 AND round(abs(abs(delta) - 0.25), 9) <= 0.05"


def nearest(cond: str, target: float) -> str:
    return f"arg_min({{'iv': mark_iv, 'oi': open_interest}}, (round(abs(abs(delta) - {target}), 9), -ts_ms, -seq, -seq2)) FILTER (WHERE {cond})"


def parts_sql(source: str, keys: str) -> str:
    return f"cp AS (SELECT {keys}, {nearest(CALL, 0.25)} AS c, {nearest(PUT, 0.25)} AS p, {nearest('delta IS NOT NULL', 0.5)} AS a, count(*) AS n FROM {source} GROUP BY {keys})"


BUILD = f"""
nx AS (SELECT underlying, expiry_days, {TENOR.format(d='expiry_days')} AS tenor, row_number() OVER (PARTITION BY underlying, {TENOR.format(d='expiry_days')} ORDER BY expiry_days) AS nth FROM (SELECT DISTINCT underlying, expiry_days FROM {JOINED})),
xt AS (SELECT t.*, nx.tenor FROM ({"SELECT * FROM " + JOINED}) t JOIN nx USING (underlying, expiry_days) WHERE nx.tenor IS NOT NULL AND nth <= 3),
xe AS (SELECT *, unnest(range(greatest(ceil((ts_ms - 5000) / 60000.0::DOUBLE)::BIGINT, 0), (ts_ms + 600000) // 60000 + 1)) AS minute FROM xt),
xn AS (SELECT * FROM xe QUALIFY row_number() OVER (PARTITION BY minute, instrument_id ORDER BY ts_ms DESC, seq DESC, seq2 DESC) = 1),
{parts_sql('xn', 'minute, underlying, tenor, expiry_days')},
ck AS (SELECT *, c IS NOT NULL AND p IS NOT NULL AND a IS NOT NULL AS whole, coalesce(nullif(coalesce(c.oi, 0) + coalesce(p.oi, 0) + coalesce(a.oi, 0), 0), 1) AS w FROM cp),
ca AS (SELECT minute, underlying, tenor, expiry_days, 'NA' AS band, CASE WHEN whole THEN a.iv END AS iv, CASE WHEN whole THEN c.iv - p.iv END AS rr, CASE WHEN whole THEN 0.5 * (c.iv + p.iv) - a.iv END AS bf, w, n, (c IS NULL)::INT AS nc, (p IS NULL)::INT AS np, (a IS NULL)::INT AS na FROM ck),
sp AS (SELECT minute, underlying, arg_max(underlying_price, (ts_ms, seq, seq2)) AS spot FROM xn GROUP BY ALL),
cb AS (SELECT minute, underlying, tenor, expiry_days, band, coalesce(sum(mark_iv * open_interest) / nullif(sum(open_interest), 0), 0) AS iv, NULL::DOUBLE AS rr, NULL::DOUBLE AS bf, coalesce(nullif(sum(open_interest), 0), 1) AS w, count(*) AS n, 0 AS nc, 0 AS np, 0 AS na FROM (SELECT xn.*, {BAND.format(m='(strike / spot)')} AS band FROM xn JOIN sp USING (minute, underlying)) WHERE band IS NOT NULL GROUP BY minute, underlying, tenor, expiry_days, band),
sf AS (SELECT minute, underlying, tenor, band, sum(iv * w) / sum(w) FILTER (WHERE iv IS NOT NULL) AS iv, sum(rr * w) / sum(w) FILTER (WHERE rr IS NOT NULL) AS rr_25d, sum(bf * w) / sum(w) FILTER (WHERE bf IS NOT NULL) AS bf_25d, count(*) FILTER (WHERE iv IS NOT NULL) AS n_expiries_used,
              coalesce(sum(n) FILTER (WHERE iv IS NOT NULL), 0)::BIGINT AS n_used, sum(w) FILTER (WHERE iv IS NOT NULL) AS sum_weights, min(expiry_days) FILTER (WHERE iv IS NOT NULL) AS expiry_min, max(expiry_days) FILTER (WHERE iv IS NOT NULL) AS expiry_max, sum(nc)::BIGINT AS missing_call, sum(np)::BIGINT AS missing_put, sum(na)::BIGINT AS missing_atm
       FROM (SELECT * FROM ca UNION ALL SELECT * FROM cb) GROUP BY ALL HAVING count(iv) > 0)"""
IV1M = f"{BUILD}, m AS (SELECT minute AS bucket, underlying, avg(iv) AS iv, avg(rr_25d) AS rr, avg(bf_25d) AS bf FROM sf GROUP BY ALL)"


def ticks(v):
    return X.with_instruments(v.options_ticker, v.options_instruments)


def surface(v):
    return V.build(ticks(v), times=v.option_times)
