"""Audits as table functions with arguments, to be called from SQL: ``SELECT * FROM audit_slicing_blocks('SIM:PERP:1', 0, 60000, 5, 5.0)``.

Functions whose work is runs and groups are SQL themselves: their arguments reach the scan as filters. The one that folds a window along the rows is a Python table function over
a table argument that the caller partitions by instrument and orders by time, so that each instrument is a fold of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

RANGE = "instrument_id = {f}.p_instrument_id AND ts_ms >= {f}.p_from AND ts_ms < {f}.p_to"
ASKED = "p_instrument_id STRING, p_from BIGINT, p_to BIGINT"


def _runs(source: str, moved: str, least: str) -> str:
    """Runs of the rows of ``source``, a new one where ``moved`` holds, that pass ``least``."""
    return f"""
    SELECT instrument_id, min(ts_ms) AS t_start, max(ts_ms) AS t_end, side, price, min(seq) AS first_seq, count(*) AS k, sum(qty) AS volume
    FROM (SELECT *, sum(CASE WHEN coalesce({moved}, true) THEN 1 ELSE 0 END) OVER (PARTITION BY instrument_id ORDER BY ts_ms, seq) AS run
          FROM (SELECT *, lag(side) OVER o AS _side, lag(price) OVER o AS _price, lag(qty) OVER o AS _qty, lag(ts_ms) OVER o AS _ts FROM {source} WINDOW o AS (PARTITION BY instrument_id ORDER BY ts_ms, seq)))
    GROUP BY instrument_id, run, side, price HAVING {least}"""


BLOCK = "instrument_id STRING, t_start BIGINT, t_end BIGINT, side STRING, price DOUBLE, first_seq BIGINT, k BIGINT, volume DOUBLE"
TURN = "side <> _side OR price <> _price"


def _functions() -> dict[str, tuple[str, str, str]]:
    """Parameters, columns and body of each SQL function."""
    trades = "(SELECT * FROM trades WHERE " + RANGE + ")"
    inserts = "(SELECT * FROM depth WHERE action = 'insert' AND qty > 0 AND " + RANGE + ")"
    least = "count(*) >= {f}.p_min_trades AND sum(qty) >= {f}.p_min_qty"
    return {
        "audit_slicing_blocks": (f"{ASKED}, p_min_trades INT, p_min_qty DOUBLE", BLOCK, _runs(trades, TURN, least)),
        "audit_slicing_blocks_iceberg": (f"{ASKED}, p_min_trades INT, p_min_qty DOUBLE", BLOCK, _runs(trades, f"{TURN} OR qty <> _qty", least)),
        "audit_slicing_passive_blocks": (f"{ASKED}, p_gap_ms BIGINT DEFAULT 120, p_min_trades INT DEFAULT 6, p_min_qty DOUBLE DEFAULT 5.0", BLOCK, _runs(inserts, f"{TURN} OR ts_ms - _ts > " + "{f}.p_gap_ms", least) + " ORDER BY t_start LIMIT 100"),
        "audit_slicing_by_second": (f"{ASKED}", "instrument_id STRING, sec BIGINT, side STRING, price DOUBLE, k BIGINT, volume DOUBLE", f"SELECT instrument_id, floor(ts_ms / 1000), side, price, count(*), sum(qty) FROM {trades} GROUP BY instrument_id, floor(ts_ms / 1000), side, price"),
    }


@udtf(returnType="instrument_id string, seq long, side string, vol_exec double, price_drift_ticks double")
class AbsorptionExact:
    """Trades whose side's volume over the last ``dur_s`` seconds reaches ``vol`` while its prices stay within ``max_ticks`` ticks of each other.

    Over a table of (instrument_id, ts_ms, seq, side, price, qty) in order of (ts_ms, seq). State is the rows of the window.
    """

    def __init__(self):
        from collections import deque

        self.rows = {"buy": deque(), "sell": deque()}

    def eval(self, row, dur_s: float, vol: float, max_ticks: float, tick: float):
        from math import fsum

        held = self.rows.setdefault(row["side"], type(self.rows["buy"])())
        held.append((row["ts_ms"], row["price"], row["qty"]))
        while held[0][0] < row["ts_ms"] - round(dur_s * 1000):
            held.popleft()
        prices = [p for _, p, _ in held]
        volume, drift = fsum(q for _, _, q in held), (max(prices) - min(prices)) / tick
        if volume >= vol and drift <= max_ticks + 1e-6:
            yield row["instrument_id"], row["seq"], row["side"], volume, round(drift, 4)


def register(spark: SparkSession, trades: DataFrame, depth: DataFrame) -> None:
    """Make the functions known to the session, over the views ``trades`` and ``depth``."""
    trades.createOrReplaceTempView("trades")
    depth.createOrReplaceTempView("depth")
    for name, (parameters, columns, body) in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body.replace('{f}', name)}")
    spark.udtf.register("audit_absorption_exact", AbsorptionExact)
