"""The audits called from SQL with arguments."""

from __future__ import annotations

from tidewatch.operators import table_functions as T

from .detectors import runs_sql
from .registry import query

ONE, FROM, TO = "SIM:PERP:1", 5_000, 40_000_000
IN_RANGE = f"SELECT * FROM {{t}} WHERE instrument_id = '{ONE}' AND ts_ms >= {FROM} AND ts_ms < {TO}"
BLOCKS = "SELECT instrument_id, min(ts_ms) AS t_start, max(ts_ms) AS t_end, side, round(price, 6) AS price, min(seq) AS first_seq, count(*) AS k, sum(qty) AS volume FROM r2 GROUP BY instrument_id, run, side, price"
SHOWN = "instrument_id, t_start, t_end, side, round(price, 6) AS price, first_seq, k, volume"


def called(v, sql: str):
    T.register(v.spark, v.trades, v.depth)
    return v.spark.sql(sql)


@query("audit_slicing_blocks_call", f"tr AS ({IN_RANGE.format(t='trades')}), {runs_sql('tr', 1 << 40)} {BLOCKS} HAVING count(*) >= 5 AND sum(qty) >= 5")
def audit_slicing_blocks_call(v):
    return called(v, f"SELECT {SHOWN} FROM audit_slicing_blocks('{ONE}', {FROM}, {TO}, 5, 5.0)")


@query("audit_slicing_blocks_iceberg_call", f"tr AS ({IN_RANGE.format(t='trades')}), {runs_sql('tr', 1 << 40, True)} {BLOCKS} HAVING count(*) >= 3 AND sum(qty) >= 3")
def audit_slicing_blocks_iceberg_call(v):
    return called(v, f"SELECT {SHOWN} FROM audit_slicing_blocks_iceberg('{ONE}', {FROM}, {TO}, 3, 3.0)")


@query("audit_slicing_passive_blocks_call", f"dp AS (SELECT * FROM ({IN_RANGE.format(t='depth')}) WHERE action = 'insert' AND qty > 0), {runs_sql('dp', 2000)} {BLOCKS} HAVING count(*) >= 2 AND sum(qty) >= 5 ORDER BY t_start LIMIT 100")
def audit_slicing_passive_blocks_call(v):
    return called(v, f"SELECT {SHOWN} FROM audit_slicing_passive_blocks('{ONE}', {FROM}, {TO}, 2000, 2, 5.0)")


@query("audit_slicing_by_second_call", f"SELECT instrument_id, ts_ms // 1000 AS sec, side, round(price, 6) AS price, count(*) AS k, sum(qty) AS volume FROM ({IN_RANGE.format(t='trades')}) GROUP BY ALL")
def audit_slicing_by_second_call(v):
    return called(v, f"SELECT instrument_id, sec, side, round(price, 6) AS price, k, volume FROM audit_slicing_by_second('{ONE}', {FROM}, {TO})")


@query("audit_absorption_exact_call", f"tr AS ({IN_RANGE.format(t='trades')}), a AS (SELECT x.instrument_id, x.seq, x.side, (SELECT {{'v': sum(qty), 'd': max(price) - min(price)}} FROM tr p WHERE p.side = x.side AND p.seq <= x.seq AND p.ts_ms >= x.ts_ms - 10000) AS r FROM tr x) SELECT instrument_id, seq, side, r.v AS vol_exec, round(r.d / 0.1, 4) AS price_drift_ticks FROM a WHERE r.v >= 20 AND r.d / 0.1 <= 2 + 1e-6")
def audit_absorption_exact_call(v):
    return called(v, f"SELECT * FROM audit_absorption_exact(TABLE({IN_RANGE.format(t='trades')}) PARTITION BY instrument_id ORDER BY (ts_ms, seq), 10.0D, 20.0D, 2.0D, 0.1D)")
