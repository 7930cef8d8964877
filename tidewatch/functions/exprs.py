"""Scalar expressions and small relational steps of the surveillance queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.operators.blocks import clamp01, intensity, previous, running  # noqa: F401

from .metrics import resolve_metric  # noqa: F401


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def safe_divide(a: Column, b: Column) -> Column:
    """a over b, b being 1e-9 at least."""
    return a / F.greatest(b, F.lit(1e-9))


def close(a: Column, b: Column, absolute: float, relative: float) -> Column:
    return (F.abs(a - b) <= absolute) | (F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b)))


def ticks(a: Column, b: Column, tick: float) -> Column:
    return F.floor(F.abs(a - b) / tick).cast("long")


def json_has(column: str, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}").isNotNull()


def json_text(column: str, key: str) -> Column:
    return F.get_json_object(column, f"$.{key}")


def instrument_range(df: DataFrame, instrument: str, from_ms: int, to_ms: int) -> DataFrame:
    """Rows of an instrument in [from, to): plain comparisons, which reach the scan."""
    return df.where((F.col("instrument_id") == instrument) & (F.col("ts_ms") >= from_ms) & (F.col("ts_ms") < to_ms))


def with_instruments(ticker: DataFrame, instruments: DataFrame) -> DataFrame:
    """Ticks with their instrument's terms; Spark broadcasts the instruments while they are small and shuffles them beyond."""
    return ticker.join(instruments, "instrument_id")


def gate_options(rows: DataFrame, now_days: int, until_days: int, spot: float, band: float, low: float, high: float) -> DataFrame:
    return rows.where((F.col("expiry_days") > now_days) & (F.col("expiry_days") < until_days) & F.col("strike").between(spot * (1 - band), spot * (1 + band)) & F.abs("delta").between(low, high))


def quoted(rows: DataFrame, needed: bool) -> DataFrame:
    return rows.where("bid is not null and ask is not null") if needed else rows


def poll_grid(events: DataFrame, every_ms: int) -> DataFrame:
    """Poll instants of each instrument, from 0 up to the end of all events."""
    ends = events.groupBy("instrument_id").agg(F.max("ts_ms").alias("_m"))
    last = ends.agg(F.max("_m").alias("_end"))
    grid = ends.select("instrument_id").crossJoin(F.broadcast(last))
    return grid.where("_end > 0").select("instrument_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_end") - 1, F.lit(every_ms).cast("long"))).alias("ts_ms"))


def flow_per_second(trades: DataFrame) -> DataFrame:
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("qty")).otherwise(0.0))
    rows = trades.groupBy(F.floor(F.col("ts_ms") / 1000).alias("sec")).agg(side("buy").alias("buy"), side("sell").alias("sell"), F.count("*").alias("n"))
    return rows.withColumn("ofi", (F.col("buy") - F.col("sell")) / F.nullif(F.col("buy") + F.col("sell"), F.lit(0.0)))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))


def gamma_exposure(rows: DataFrame, most_gamma: float = 1.0, most_oi: float = 1e6) -> DataFrame:
    sign = F.when(F.col("option_type") == "C", 1).otherwise(-1)
    return rows.withColumn("gex", F.least("gamma", F.lit(most_gamma)) * F.least("open_interest", F.lit(most_oi)) * F.col("underlying_price") * F.col("underlying_price") * sign)


def running_oi(ticks: DataFrame) -> DataFrame:
    """Open interest of calls and puts per underlying after each tick, from the last of each instrument; ``nth`` numbers an underlying's ticks."""
    before = F.lag("open_interest").over(Window.partitionBy("instrument_id").orderBy("ts_ms", "seq", "seq2", "open_interest"))
    rows = ticks.withColumn("_x", F.col("open_interest") - F.coalesce(before, F.lit(0.0)))
    side = lambda t: F.when(F.col("option_type") == t, F.col("_x")).otherwise(0.0)
    order = ["ts_ms", "seq", "seq2", "instrument_id", "open_interest"]
    return running(rows, ["underlying"], order, calls=side("C"), puts=side("P"), nth=F.lit(1).cast("long")).drop("_x")


def telemetry(rows: DataFrame, reasons: tuple[str, ...]) -> DataFrame:
    """Counters per minute, rule and side: emitted (no reason) and discarded by reason."""
    kinds = [F.count_if(F.col("reason").isNull()).alias("emitted"), *(F.count_if(F.col("reason") == r).alias(f"disc_{r}") for r in reasons)]
    return rows.groupBy(F.floor(F.col("ts_ms") / 60_000).alias("minute"), "rule", "side").agg(*kinds)


def basis_bps() -> Column:
    return (F.col("mark_price") / F.nullif("index_price", F.lit(0.0)) - 1) * 1e4


def basis_velocity(marks: DataFrame) -> DataFrame:
    """basis and its change per second against the row before."""
    rows = previous(marks.withColumn("basis", basis_bps()), ["instrument_id"], ["ts_ms", "basis"], "_was")
    dt = F.greatest((F.col("ts_ms") - F.col("_was.ts_ms")) / 1000.0, F.lit(1e-6))
    return rows.withColumn("velocity", (F.col("basis") - F.col("_was.basis")) / dt).drop("_was")
