"""Events to rated rule alerts, their keys, suppression, texts and dispatch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

# Rule, kind of event, its side (None: any), its metric (None: any), further test, side of the alert (None: the event's),
# what is rated (value, size, velocity) or the fixed severity, and the thresholds of MEDIUM and HIGH.
RULES = [
    ("R1", "break_wall", "buy", None, "rising", None, "velocity", 2.0, 3.0),
    ("R2", "break_wall", "sell", None, "falling", None, "velocity", 2.0, 3.0),
    ("R3", "absorption", "buy", None, None, None, "value", 300.0, 600.0),
    ("R4", "absorption", "sell", None, None, None, "value", 300.0, 600.0),
    ("R5", "slicing_aggr", "buy", None, None, None, "value", 5.0, 10.0),
    ("R6", "slicing_aggr", "sell", None, None, None, "value", 5.0, 10.0),
    ("R7", "slicing_pass", "buy", None, None, None, "value", 10.0, 25.0),
    ("R8", "slicing_pass", "sell", None, None, None, "value", 10.0, 25.0),
    ("R9", "dominance", "buy", None, None, None, "value", 80.0, 90.0),
    ("R10", "dominance", "sell", None, None, None, "value", 80.0, 90.0),
    ("R11", "spoofing", "buy", None, None, None, "value", 50.0, 100.0),
    ("R12", "spoofing", "sell", None, None, None, "value", 50.0, 100.0),
    ("R13", "depletion", "buy", None, None, None, "value", 0.40, 0.60),
    ("R14", "depletion", "sell", None, None, None, "value", 0.40, 0.60),
    ("R15", "metric_trigger", None, "basis_bps", "above", "na", "value", 50.0, 100.0),
    ("R16", "metric_trigger", None, "basis_bps", "below", "na", "size", 50.0, 100.0),
    ("R17", "basis_mean_revert", "sell", None, None, None, "size", 2.0, 3.0),
    ("R18", "basis_mean_revert", "buy", None, None, None, "size", 2.0, 3.0),
    ("R19", "iv_spike", None, None, None, None, "value", 0.60, 0.80),
    ("R19", "iv_spike_up", None, None, None, "na", "HIGH", None, None),
    ("R20", "iv_spike_down", None, None, None, "na", "HIGH", None, None),
    ("R21", "oi_skew_bull", None, None, None, "na", "MEDIUM", None, None),
    ("R22", "oi_skew_bear", None, None, None, "na", "MEDIUM", None, None),
    ("R23", "tape_pressure", "buy", None, None, None, "value", 0.8, 0.9),
    ("R24", "tape_pressure", "sell", None, None, None, "value", 0.8, 0.9),
    ("R27", "metric_trigger", None, "spread_usd", None, "na", "size_or_0", 0.5, 1.0),
    ("R28", "oi_spike", "buy", None, None, None, "value", 0.60, 0.80),
    ("R29", "oi_spike", "sell", None, None, None, "value", 0.60, 0.80),
    ("R30", "top_traders", "long", None, None, None, "value", 0.60, 0.80),
    ("R31", "top_traders", "short", None, None, None, "value", 0.60, 0.80),
    ("R32", "liq_cluster", "sell", None, None, None, "value", 0.40, 0.80),
    ("R33", "liq_cluster", "buy", None, None, None, "value", 0.40, 0.80),
    ("R34", "basis_dislocation", None, None, None, "na", "value", 0.60, 0.80),
    ("R35", "skew_shock", None, None, None, "na", "value", 0.60, 0.80),
    ("R36", "gamma_flip", None, None, None, "na", "value", 0.60, 0.80),
    ("R37", "term_structure_invert", None, None, None, "na", "value", 0.60, 0.80),
]
OPTIONAL = {"metric": "string", "threshold": "double", "velocity": "double"}


def severity(value: Column, medium: Column, high: Column) -> Column:
    """HIGH, MEDIUM or LOW by value; MEDIUM where there is none. Rated by size, a value comes in as its absolute."""
    return F.when(value.isNull(), "MEDIUM").when(value >= high, "HIGH").when(value >= medium, "MEDIUM").otherwise("LOW")


def rated(events: DataFrame) -> DataFrame:
    """A row for each event and rule that fits it, with ``rule``, the alert's ``side`` and ``severity``; an event has none, one or more.

    Events have kind, side (null: na) and intensity, and may have metric, threshold and velocity. The rules are a fixed table.
    """
    columns = "rule string, kind string, _side string, _metric string, _test string, _out string, _mode string, _medium double, _high double"
    table = events.sparkSession.createDataFrame(RULES, columns)
    names = events.columns
    rows = events.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in names}).withColumn("side", F.lower(F.coalesce("side", F.lit("na"))))
    value, limit, speed = F.col("intensity"), F.coalesce("threshold", F.lit(0.0)), F.coalesce("velocity", F.lit(0.0))
    tests = {"rising": speed > 0, "falling": speed < 0, "above": (value >= limit) & (limit >= 0), "below": value <= -F.abs(limit)}
    passed = F.col("_test").isNull()
    for name, test in tests.items():
        passed |= (F.col("_test") == name) & F.coalesce(test, F.lit(False))
    rows = rows.join(F.broadcast(table), "kind").where((F.col("_side").isNull() | (F.col("_side") == F.col("side"))) & (F.col("_metric").isNull() | (F.col("_metric") == F.col("metric"))) & passed)
    mode = F.col("_mode")
    rating = F.when(mode == "value", value).when(mode == "size", F.abs(value)).when(mode == "size_or_0", F.abs(F.coalesce(value, F.lit(0.0)))).when(mode == "velocity", F.abs(speed))
    level = F.when(mode.isin("HIGH", "MEDIUM"), mode).otherwise(severity(rating, F.col("_medium"), F.col("_high")))
    rows = rows.withColumns({"side": F.coalesce("_out", "side"), "severity": level})
    return rows.select(*names, "rule", "severity")


def normal_severity(word: Column) -> Column:
    w = F.upper(F.trim(word))
    return F.when(w.isin("HIGH", "CRITICAL"), "HIGH").when(w.isin("LOW", "INFO"), "LOW").otherwise("MEDIUM")


def dedup_key(fields: Column) -> Column:
    """Instrument, rule, side, kind, price (2 places; na where there is none or 0), intensity (4 places) and a hash of the fields (a map) in order of
    their names, joined by bars; what is missing is na."""
    canonical = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))
    text = [F.coalesce(c, F.lit("na")) for c in ("instrument_id", "rule", "side", "kind")]
    price, value = F.nullif(F.col("price"), F.lit(0.0)), F.col("intensity")
    parts = [F.when(c.isNull(), F.lit(f"{mark}=na")).otherwise(F.format_string(f"{mark}=%.{places}f", c)) for mark, c, places in (("p", price, 2), ("i", value, 4))]
    return F.concat_ws("|", *text, *parts, F.substring(F.sha1(F.coalesce(canonical, F.lit("{}")).cast("binary")), 1, 8))


def suppressed(alerts: DataFrame, window_ms: int = 90_000) -> DataFrame:
    """An alert per key and suppression window: the first hit opens it, hits less than ``window_ms`` after that merge into it.

    Each key's hits stream in order past a fold that holds the open window alone.
    """
    kind = StructType([alerts.schema["dedup_key"], *(StructField(c, LongType()) for c in ("ts_first", "ts_last", "n_hits"))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(closed: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in closed], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=kind.names)

        window = None
        for batch in batches:
            closed = []
            for key, t in zip(batch.column("dedup_key").to_pylist(), batch.column("ts_ms").to_pylist(), strict=True):
                if window and key == window[0] and t - window[1] < window_ms:
                    window[2:] = t, window[3] + 1
                else:
                    closed += [window] if window else []
                    window = [key, t, t, 1]
            yield rows(closed)
        if window:
            yield rows([window])

    hits = alerts.where("ts_ms is not null").select("dedup_key", "ts_ms").repartition("dedup_key").sortWithinPartitions("dedup_key", "ts_ms")
    return hits.mapInArrow(fold, kind)


# What the text of each kind tells, as name, format, and column or field.
TEXTS = {
    "break_wall": (("price", "%.2f", "price"), ("k", "%.0f", "k")),
    "absorption": (("price", "%.2f", "price"), ("vol", "%.2f", "intensity")),
    "slicing_aggr": (("price", "%.2f", "price"), ("qty", "%.2f", "intensity")),
    "slicing_pass": (("price", "%.2f", "price"), ("qty", "%.2f", "intensity")),
    "dominance": (("share", "%.1f%%", "intensity"), ("price", "%.2f", "price")),
    "spoofing": (("qty", "%.2f", "intensity"), ("price", "%.2f", "price"), ("cancel", "%.2f", "cancel_rate")),
    "depletion": (("share", "%.2f", "intensity"),),
    "metric_trigger": (("value", "%.1f", "intensity"),),
    "basis_mean_revert": (("vel", "%.2f", "intensity"),),
    "iv_spike_up": (("move", "%.2f%%", "intensity"),),
    "iv_spike_down": (("move", "%.2f%%", "intensity"),),
    "oi_skew_bull": (("ratio", "%.2f", "intensity"),),
    "oi_skew_bear": (("ratio", "%.2f", "intensity"),),
    "tape_pressure": (("ratio", "%.2f", "intensity"), ("price", "%.2f", "price")),
    "oi_spike": (("oi", "%.2f%%", "oi_delta_pct"), ("mom", "%.2f USD", "momentum_usd"), ("i", "%.2f", "intensity")),
    "liq_cluster": (("sum", "%.0f USD", "liq_sum_usd"), ("k", "%.0f", "liq_orders"), ("low", "%.1f", "price_min"), ("high", "%.1f", "price_max"), ("i", "%.2f", "intensity")),
    "iv_spike": (("was", "%.3f", "iv_prev"), ("now", "%.3f", "iv_now"), ("dv", "%.3f", "dv"), ("vel", "%.5f/s", "velocity"), ("i", "%.2f", "intensity")),
    "top_traders": (("acc_long", "%.2f", "acc_long"), ("acc_short", "%.2f", "acc_short"), ("pos_long", "%.2f", "pos_long"), ("pos_short", "%.2f", "pos_short"), ("i", "%.2f", "intensity")),
    "basis_dislocation": (("basis", "%.2f", "basis_bps"), ("vel", "%.2f", "velocity"), ("trend", "%.6f", "funding_trend"), ("i", "%.2f", "intensity")),
    "skew_shock": (("drr", "%.4f", "delta_rr"), ("vel", "%.6f/s", "velocity"), ("i", "%.2f", "intensity")),
    "gamma_flip": (("net", "%.3e", "net_gex"), ("call", "%.3e", "call_gex"), ("put", "%.3e", "put_gex"), ("i", "%.2f", "intensity")),
    "term_structure_invert": (("short", "%.3f", "iv_short"), ("long", "%.3f", "iv_long"), ("spread", "%.3f", "spread"), ("i", "%.2f", "intensity")),
}
COLUMNS = ("price", "intensity")


def text() -> Column:
    """A line of text for an alert: rule, kind, side, and what its kind tells (TEXTS), from the columns price and intensity and the map ``fields`` of texts.

    What is missing or no number is na; a kind without an entry tells its intensity.
    """
    value = lambda source: F.col(source) if source in COLUMNS else F.col("fields")[source].try_cast("double")
    told = lambda parts: F.concat_ws(" ", *(F.concat(F.lit(f"{name}="), F.coalesce(F.when(value(source).isNotNull(), F.format_string(form, value(source))), F.lit("na"))) for name, form, source in parts))
    lines = reduce(lambda c, kind: c.when(F.col("kind") == kind, told(TEXTS[kind])), TEXTS, F)
    return F.concat(F.lit("#"), F.col("rule"), F.lit(" "), F.col("kind"), F.lit(" "), F.upper("side"), F.lit(" | "), lines.otherwise(told((("i", "%.2f", "intensity"),))))


def throttled(messages: DataFrame, most: int = 60) -> DataFrame:
    """``status`` of each message: sent, or rate_limit beyond ``most`` per router and minute."""
    rank = F.row_number().over(Window.partitionBy("router", F.floor(F.col("ts_ms") / 60_000)).orderBy("ts_ms", "seq"))
    return messages.withColumn("status", F.when(rank <= most, "sent").otherwise("rate_limit"))


def dispatch_log(messages: DataFrame, alerts: DataFrame) -> DataFrame:
    """Log rows of messages whose alert exists."""
    return messages.join(alerts.select("alert_id").distinct(), "alert_id", "left_semi")
