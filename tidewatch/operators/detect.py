"""Trade, depth and snapshot detectors. Each returns events: instrument_id, ts_ms, seq, kind, side, price, intensity and more."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.metrics import resolve_metric

from .blocks import asof_join, clamp01, cooled, held, intensity, last_known, previous, run_ids, trailing_sum

KEY = ["instrument_id"]


def slicing(trades: DataFrame, gap_ms: int, k_min: int, qty_min: float, equal: bool = False, mode: str = "hitting") -> DataFrame:
    """Runs of consecutive trades of one side and price at most ``gap_ms`` apart, of equal size if ``equal``; every trade of a run
    fires once the run has ``k_min`` trades and ``qty_min`` volume. A row that breaks the equality starts a run but never fires itself."""
    moved = lambda was, now: (now["side"] != was["side"]) | (now["price"] != was["price"]) | (now["ts_ms"] - was["ts_ms"] > gap_ms)
    breaks = (lambda was, now: moved(was, now) | (now["qty"] != was["qty"])) if equal else moved
    rows = trades.withColumn("_odd", F.lit(False))
    if equal:
        was, now = F.col("_was"), F.struct("ts_ms", "side", "price", "qty")
        rows = previous(trades, KEY, ["ts_ms", "side", "price", "qty"], "_was").withColumn("_odd", F.coalesce(~moved(was, now) & (F.col("qty") != was["qty"]), F.lit(False))).drop("_was")
    rows = run_ids(rows, KEY, ["side", "price", "qty"], breaks)
    inside = Window.partitionBy(*KEY, "run").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"k": F.count("*").over(inside), "volume": F.sum("qty").over(inside), "start_ms": F.col("run.ts_ms")})
    return rows.where((F.col("k") >= k_min) & (F.col("volume") >= qty_min) & ~F.col("_odd")).drop("_odd").withColumns({"kind": F.lit("slicing_aggr" if mode != "passive" else "slicing_pass"), "mode": F.lit(mode), "intensity": F.col("volume")})


def slicing_passive(depth: DataFrame, gap_ms: int, k_min: int, qty_min: float) -> DataFrame:
    return slicing(depth.where("action = 'insert' and qty > 0"), gap_ms, k_min, qty_min, mode="passive")


def absorption(trades: DataFrame, best: DataFrame, window_ms: int, volume_min: float, drift: float) -> DataFrame:
    """Trades of a side whose trailing volume reaches ``volume_min`` while the passive best price stays within ``drift`` of its anchor.

    The anchor is the passive best at the first trade of a side, and again at one that follows an opposite trade later than the
    side's trade before plus the window. ``best``: instrument_id, ts_ms, seq, best_bid, best_ask.
    """
    at = lambda side: F.when(F.col("side") == side, F.col("ts_ms"))
    rows = last_known(trades, KEY, False, _buy=at("buy"), _sell=at("sell"))
    own = F.when(F.col("side") == "buy", F.col("_buy")).otherwise(F.col("_sell"))
    opposite = F.when(F.col("side") == "buy", F.col("_sell")).otherwise(F.col("_buy"))
    start = own.isNull() | (opposite > own + window_ms)
    rows = last_known(rows, [*KEY, "side"], True, anchor_ms=F.when(start, F.col("ts_ms"))).drop("_buy", "_sell")
    rows = trailing_sum(rows, [*KEY, "side"], F.col("qty"), window_ms, "volume").where(F.col("volume") >= volume_min)
    passive = lambda book: F.when(F.col("side") == "buy", F.col(f"{book}.best_ask")).otherwise(F.col(f"{book}.best_bid"))
    both = F.struct("best_bid", "best_ask")
    rows = asof_join(rows, best, KEY, both, "_now").withColumn("passive", passive("_now")).drop("_now")
    rows = rows.withColumnRenamed("ts_ms", "_ts").withColumn("ts_ms", F.col("anchor_ms"))
    rows = asof_join(rows, best, KEY, both, "_then").withColumn("anchor", passive("_then")).drop("_then", "ts_ms").withColumnRenamed("_ts", "ts_ms")
    return rows.where(F.abs(F.col("passive") - F.col("anchor")) <= drift + 1e-9).withColumns({"kind": F.lit("absorption"), "intensity": F.col("volume")})


def tape_pressure(trades: DataFrame, window_ms: int, high: float, low: float, cooldown_ms: int) -> DataFrame:
    """Trailing share of bought volume at ``high`` or more (buy), ``low`` or less (sell), once per cooldown."""
    rows = trailing_sum(trades, KEY, F.when(F.col("side") == "buy", F.col("qty")), window_ms, "bought")
    rows = trailing_sum(rows, KEY, F.col("qty"), window_ms, "total").withColumn("ratio", F.try_divide("bought", "total"))
    hits = rows.where((F.col("ratio") >= high) | (F.col("ratio") <= low)).withColumn("side", F.when(F.col("ratio") >= high, "buy").otherwise("sell"))
    return cooled(hits, KEY, cooldown_ms).withColumns({"kind": F.lit("tape_pressure"), "intensity": F.col("ratio")})


def mean_revert(marks: DataFrame, near: float, speed: float, cooldown_ms: int) -> DataFrame:
    """The velocity of the basis turns (both signs set) close to zero and fast."""
    rows = previous(marks, KEY, ["velocity"], "_was")
    now, was = F.signum("velocity"), F.signum("_was.velocity")
    hit = (now != 0) & (was != 0) & (now != was) & (F.abs("basis") <= near) & (F.abs("velocity") >= speed)
    hits = rows.where(hit).drop("_was").withColumn("side", F.when(F.col("velocity") > 0, "buy").otherwise("sell"))
    return cooled(hits, KEY, cooldown_ms).withColumns({"kind": F.lit("basis_mean_revert"), "intensity": F.col("velocity")})


def metric_trigger(samples: DataFrame, metric: str, threshold: float, above: bool, hold_ms: int, cooldown_ms: int, source: str = "legacy", doc: str | None = None, flip_doc: bool = True) -> DataFrame:
    """``metric`` (or its documented form ``doc``, the sign turned if ``flip_doc``) beyond ``threshold`` for the hold time, once per cooldown."""
    rows = samples.withColumn("_m", resolve_metric(F.col(doc or metric), F.col(metric), doc or metric, metric, source, flip_doc))
    value = F.col("_m.value")
    rows = held(rows, KEY, value >= threshold if above else value <= threshold, hold_ms, cooldown_ms)
    return rows.withColumns({"kind": F.lit("metric_trigger"), "side": F.lit("na"), "metric": F.lit(metric), "threshold": F.lit(threshold), "metric_used": F.col("_m.used_key"), "metric_source": F.col("_m.used_source"), "intensity": value}).drop("_m")


def depletion(samples: DataFrame, side: str, source: str, share: float, warn: float, strong: float, clamp: float, hold_ms: int, cooldown_ms: int, mode: str = "linear", require_negative: bool = True) -> DataFrame:
    """A side of the book that empties: its depleted share (``dep_bid``, ``dep_ask``) at ``share`` or more, or, where the documented change of volume
    (``depletion_bid_doc``, ``depletion_ask_doc``) is used, a fall (or, without ``require_negative``, a change) of ``warn`` or more, held to ``clamp``."""
    end = "bid" if side == "buy" else "ask"
    rows = samples.withColumn("_m", resolve_metric(F.col(f"depletion_{end}_doc"), F.col(f"dep_{end}"), f"depletion_{end}_doc", f"dep_{end}", source))
    value, documented = F.col("_m.value"), F.col("_m.used_source") == "doc"
    fall = F.greatest(-value, F.lit(0.0)) if require_negative else F.abs(value)
    rows = rows.withColumn("amount", F.when(documented, F.least(fall, F.lit(clamp))))
    rows = held(rows, KEY, F.when(documented, F.col("amount") >= warn).otherwise(value >= share), hold_ms, cooldown_ms)
    if mode == "log":
        degree = clamp01(F.log1p(F.col("amount") / max(warn, 1e-9)) / F.log1p(F.lit(strong / max(warn, 1e-9))))
    else:
        degree = intensity(F.col("amount"), warn, strong)
    return rows.withColumns({"kind": F.lit("depletion"), "side": F.lit(side), "metric_used": F.col("_m.used_key"), "metric_source": F.col("_m.used_source"), "intensity": F.when(documented, degree).otherwise(value)}).drop("_m")


def dominance(samples: DataFrame, source: str, share_doc: float, share: float, most_spread: float, cooldown_ms: int) -> DataFrame:
    """A side that holds most of the book while the spread is tight; intensity in percent.

    The documented form (mean share of volume, ``dominance_bid_doc`` and ``dominance_ask_doc``) at ``share_doc`` fires at each sample; the level
    form (``dom_bid``, ``dom_ask``) at ``share`` fires unless it fired on the same side within the cooldown. ``auto`` takes the level form where the documented
    one doesn't fire.
    """
    tight = samples.where(F.col("spread_usd") <= most_spread)

    def form(bid: str, ask: str, least: float, name: str) -> DataFrame:
        side = F.when(F.col(bid) >= least, "buy").when(F.col(ask) >= least, "sell")
        rows = tight.withColumn("side", side)
        price = F.when(F.col("side") == "buy", F.col("best_bid")).otherwise(F.col("best_ask"))
        return rows.withColumns({"price": F.coalesce(price, F.lit(0.0)), "intensity": 100 * F.when(F.col("side") == "buy", F.col(bid)).otherwise(F.col(ask)), "metric_source": F.lit(name)})

    documented = form("dominance_bid_doc", "dominance_ask_doc", share_doc, "doc")
    levels = form("dom_bid", "dom_ask", share, "legacy").where("side is not null")
    if source == "auto":
        fired = documented.where("side is not null").select(*KEY, "ts_ms", "seq")
        levels = levels.join(fired, [*KEY, "ts_ms", "seq"], "left_anti")
    # A change of side fires at once, so each run of one side cools by itself.
    levels = run_ids(levels, KEY, ["side"], lambda was, now: was["side"] != now["side"])
    levels = cooled(levels, [*KEY, "run"], cooldown_ms).drop("run")
    documented = documented.where("side is not null")
    out = {"doc": documented, "legacy": levels}.get(source)
    out = documented.unionByName(levels) if out is None else out
    return out.withColumn("kind", F.lit("dominance"))


def spoofing(depth: DataFrame, trades: DataFrame, wall: float, ticks: int, window_ms: int, cancel_rate: float, most_executed: float, tick: float) -> DataFrame:
    """Walls (inserts of ``wall`` or more, ``ticks`` or more from the own side's best price at that row) that are cancelled, not executed, within the window.

    ``depth`` has ``best_bid`` and ``best_ask``, the best prices with the row itself applied; where a side has none, the distance is 0. A new wall
    insert on a level starts over. The first row of the level after the window closes the wall; a delete counts as cancelled up to and with that row.
    The cancel rate is cancelled over the wall and cancelled. Executions are trades within one and a half ticks of the wall between its start and its close.
    """
    best = F.when(F.col("side") == "buy", F.col("best_bid")).otherwise(F.col("best_ask"))
    away = F.coalesce(F.floor(F.round(F.abs(F.col("price") - best) / tick, 6)), F.lit(0))
    level = ["instrument_id", "side", "price"]
    rows = depth.withColumns({"_away": away, "_open": (F.col("action") == "insert") & (F.col("qty") >= wall) & (away >= ticks)})
    rows = last_known(rows, level, True, episode=F.when(F.col("_open"), F.struct("ts_ms", "seq", F.col("qty").alias("wall"), F.col("_away").alias("ticks")))).where("episode is not null")
    mine = Window.partitionBy(*level, "episode").orderBy("ts_ms", "seq")
    late = F.when(F.col("ts_ms") - F.col("episode.ts_ms") > window_ms, F.struct("ts_ms", "seq"))
    rows = rows.withColumn("_late", F.min(late).over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    upto = F.col("_late").isNull() | (F.struct("ts_ms", "seq") <= F.col("_late"))
    walls = rows.where(upto).groupBy(*level, "episode").agg(F.sum(F.when(F.col("action") == "delete", F.col("qty")).otherwise(0.0)).alias("cancelled"), F.min("_late").alias("t1")).where("t1 is not null")
    walls = walls.withColumn("cancel_rate", F.col("cancelled") / (F.col("episode.wall") + F.col("cancelled"))).where(F.col("cancel_rate") >= cancel_rate)
    # Trades near a wall: by price tick (the wall's and its neighbours) and second.
    near = walls.select(*level, "episode", "t1", F.explode(F.array(*(F.round(F.col("price") / tick).cast("long") + k for k in (-2, -1, 0, 1, 2)))).alias("_tick"))
    near = near.withColumn("_sec", F.explode(F.sequence(F.floor(F.col("episode.ts_ms") / 1000), F.floor(F.col("t1.ts_ms") / 1000))))
    prints = trades.select("instrument_id", F.col("ts_ms").alias("_t"), F.col("price").alias("_p"), F.col("qty").alias("_q"), F.round(F.col("price") / tick).cast("long").alias("_tick"), F.floor(F.col("ts_ms") / 1000).alias("_sec"))
    hit = near.join(prints, ["instrument_id", "_tick", "_sec"]).where((F.col("_t") >= F.col("episode.ts_ms")) & (F.col("_t") <= F.col("t1.ts_ms")) & (F.abs(F.col("_p") - F.col("price")) <= 1.5 * tick + 1e-9))
    executed = hit.groupBy(*level, "episode").agg(F.sum("_q").alias("executed"))
    out = walls.join(executed, [*level, "episode"], "left").withColumn("executed", F.coalesce("executed", F.lit(0.0))).where(F.col("executed") <= most_executed)
    return out.select("instrument_id", F.col("t1.ts_ms").alias("ts_ms"), F.col("t1.seq").alias("seq"), F.lit("spoofing").alias("kind"), "side", "price", F.col("episode.wall").alias("intensity"), F.col("cancelled").alias("dropped"), "cancel_rate", F.col("episode.ticks").alias("distance_ticks"), "executed")


def break_wall(slices: DataFrame, snapshots: DataFrame, k_min: int, speed: float, source: str, share: float = 0.4, refill_share: float = 0.6, warn: float = 20.0, most_refill: float = 10.0, clamp: float = 300.0, ticks: float = 20, tick: float = 0.1, require_negative: bool = True, require_depletion: bool = True) -> DataFrame:
    """Slicing events in a row on one side, a fast basis, a price near the best one and an opposite side that empties.

    ``snapshots`` as of each event give the basis velocity, the best prices and, of the opposite side, the depleted and refilled shares or the documented change
    of volume; ``source`` chooses: legacy, doc, or auto (documented where there is one). ``fired`` tells the events; of the others, ``gate`` names the
    reason, null where there is too little to go by.
    """
    rows = run_ids(slices.drop("run"), KEY, ["side"], lambda was, now: was["side"] != now["side"], "streak")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*KEY, "streak").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0))).drop("streak")
    fields = ["basis_vel_bps_s", "basis_vel_bps_s_doc", "best_bid", "best_ask", "dep_bid", "dep_ask", "refill_bid_3s", "refill_ask_3s", "depletion_bid_doc", "depletion_ask_doc"]
    rows = asof_join(rows, snapshots, KEY, F.struct(*fields), "m")
    m, buying = F.col("m"), F.col("side") == "buy"
    facing = lambda bid, ask: F.when(buying, m[ask]).otherwise(m[bid])
    rows = rows.withColumn("_v", resolve_metric(m["basis_vel_bps_s_doc"], m["basis_vel_bps_s"], "basis_vel_bps_s_doc", "basis_vel_bps_s", source))
    rows = rows.withColumns({"velocity": F.col("_v.value"), "change": resolve_metric(facing("depletion_bid_doc", "depletion_ask_doc"), F.lit(None).cast("double"), "", "", "doc")["value"]})
    velocity, change, documented = F.col("velocity"), F.col("change"), F.coalesce(F.col("_v.used_source"), F.lit(source)) != "legacy"
    rows = rows.withColumns({"depleted": F.least(F.greatest(-change, F.lit(0.0)), F.lit(clamp)), "refilled": F.least(F.greatest(change, F.lit(0.0)), F.lit(clamp)), "far": F.abs(F.col("price") - facing("best_bid", "best_ask")) / tick})
    silent, low, high = F.lit("silent"), F.lit("dep_low"), F.lit("refill_high")
    plain = F.when(F.coalesce(facing("dep_bid", "dep_ask"), F.lit(0.0)) < share, low).when(F.coalesce(facing("refill_bid_3s", "refill_ask_3s"), F.lit(0.0)) >= refill_share, high)
    amounts = F.when(F.col("depleted") < warn, low).when(F.col("refilled") > most_refill, high)
    if not require_depletion:
        plain = amounts = F.lit(None).cast("string")
    if require_negative:
        amounts = F.when(change >= 0, F.lit("no_depletion")).otherwise(amounts)
    missing = plain if source == "auto" else silent
    stop = F.when(F.col("n") < k_min, silent).when(velocity.isNull(), silent).when(F.abs(velocity) < speed, F.lit("basis_vel_low")).when(F.col("far") > ticks, F.lit("top_levels_gate"))
    stop = stop.otherwise(F.when(~documented, plain).when(change.isNull(), missing).otherwise(amounts))
    return rows.withColumn("_stop", stop).withColumns({"fired": F.col("_stop").isNull(), "gate": F.nullif("_stop", silent), "kind": F.lit("break_wall"), "metric_source": F.when(documented & change.isNotNull(), "doc").otherwise("legacy"), "intensity": F.col("volume")}).drop("m", "_v", "_stop")


def oi_skew(running: DataFrame, ratio: float, least_total: float, cooldown_ms: int) -> DataFrame:
    """Calls over puts (bull) or the reverse (bear) in running open interest, once per direction and cooldown; both must be above zero."""
    calls, puts = F.col("calls"), F.col("puts")
    turn = F.when(calls >= ratio * puts, "bull").when(puts >= ratio * calls, "bear")
    hits = running.where((calls > 0) & (puts > 0) & (calls + puts >= least_total)).withColumn("turn", turn).where("turn is not null")
    fired = cooled(hits, ["underlying", "turn"], cooldown_ms)
    return fired.withColumns({"kind": F.concat(F.lit("oi_skew_"), "turn"), "side": F.lit("na"), "intensity": F.greatest(calls, puts) / F.least(calls, puts)})


def iv_spike_ticks(ticks: DataFrame, up: float, down: float, window_ms: int, cooldown_ms: int) -> DataFrame:
    """Re-anchoring base of implied volatility per instrument; a move of ``up`` or ``down`` percent (above and below zero) against it fires once per
    direction and cooldown. The base moves on when it is older than the window, when it fired, and when the move is under half of ``up``. Ticks without a
    volatility above zero don't count.

    The state depends on every tick before: each instrument's ticks stream in order past a fold that holds the base and the last firings alone.
    """
    kind = "instrument_id string, ts_ms long, seq long, kind string, base double, intensity double"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["instrument_id", "ts_ms", "seq", "kind", "base", "intensity"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
        now = None
        for batch in batches:
            out: list[tuple] = []
            for key, ts, seq, iv in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != now:
                    now, base, since, last = key, None, None, {}
                if base is None or ts - since > window_ms:
                    base, since = iv, ts
                    continue
                move = (iv / base - 1) * 100
                turn = "up" if move >= up else "down" if move <= down else None
                if turn:
                    if turn not in last or ts - last[turn] >= cooldown_ms:
                        out.append((key, ts, seq, f"iv_spike_{turn}", base, move))
                        last[turn], base, since = ts, iv, ts
                elif abs(move) < abs(up) / 2:
                    base, since = iv, ts
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)

    rows = ticks.where("mark_iv > 0").select("instrument_id", "ts_ms", "seq", "mark_iv", "seq2")
    return rows.repartition("instrument_id").sortWithinPartitions("instrument_id", "ts_ms", "seq", "seq2").mapInArrow(fold, kind).withColumn("side", F.lit("na"))
