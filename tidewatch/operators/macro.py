"""Polled detectors: inputs as of each poll, conditions on them, once per cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import asof, asof_joins, clamp01, cooled, intensity

KEY = ["instrument_id"]


def _polled(grid: DataFrame, inputs: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    return asof_joins(grid, KEY, {name: (df, F.col(column)) for name, (df, column) in inputs.items()}).withColumn("seq", F.col("ts_ms"))


def oi_spike(grid: DataFrame, oi: DataFrame, fallback: DataFrame, mid: DataFrame, warn: float, strong: float, move_warn: float, move_strong: float, cooldown_ms: int) -> DataFrame:
    """Open interest (percent change; of the ``fallback`` series where the first has none) and mid price both moved far; the side is that of the price,
    the intensity the mean of both."""
    rows = _polled(grid, {"own": (oi, "pct"), "other": (fallback, "pct"), "move": (mid, "move")}).withColumns({"pct": F.coalesce("own", "other"), "used": F.when(F.col("own").isNotNull(), "series").otherwise("fallback")})
    hits = rows.where((F.abs("pct") >= warn) & (F.abs("move") >= move_warn)).withColumn("side", F.when(F.col("move") > 0, "buy").otherwise("sell"))
    both = (intensity(F.abs("pct"), warn, strong) + intensity(F.abs("move"), move_warn, move_strong)) / 2
    return cooled(hits, KEY, cooldown_ms).withColumns({"kind": F.lit("oi_spike"), "intensity": both})


def top_traders(grid: DataFrame, account: DataFrame, position: DataFrame, account_limits: tuple[float, float], position_limits: tuple[float, float], choose_by: str, require_both: bool, cooldown_ms: int) -> DataFrame:
    """Traders far on one side: a long (or short) ratio at the warn limit or more in the account or the position series, or, with ``require_both``, in both.

    The side is that of the greatest score (the ratio between its warn and strong limit) among those of ``choose_by``: account_only, position_only, or
    max_score, which needs both series; of equal ones the first of long account, long position, short account, short position.
    """
    pair = lambda df: df.withColumn("r", F.struct("long_ratio", "short_ratio"))
    rows = _polled(grid, {"a": (pair(account), "r"), "p": (pair(position), "r")})
    needed = {"max_score": "a is not null and p is not null", "account_only": "a is not null", "position_only": "p is not null"}[choose_by]
    rows = rows.where(needed)

    def over(side: str) -> Column:
        ratios = [F.coalesce(F.col(f"{s}.{side}_ratio") >= limits[0], F.lit(False)) for s, limits in (("a", account_limits), ("p", position_limits))]
        return ratios[0] & ratios[1] if require_both else ratios[0] | ratios[1]

    score = lambda s, side: F.when(over(side), F.coalesce(intensity(F.col(f"{s}.{side}_ratio"), *(account_limits if s == "a" else position_limits)), F.lit(0.0)))
    series = {"max_score": ("a", "p"), "account_only": ("a",), "position_only": ("p",)}[choose_by]
    scores = [(score(s, side), side) for side in ("long", "short") for s in series]
    best = F.greatest(*(c for c, _ in scores), F.lit(None).cast("double"))
    side = F.lit(None).cast("string")
    for c, name in reversed(scores):
        side = F.when(c == F.col("best"), F.lit(name)).otherwise(side)
    rows = rows.withColumn("best", best).where("best is not null").withColumn("side", side)
    return cooled(rows, KEY, cooldown_ms).withColumns({"kind": F.lit("top_traders"), "intensity": F.col("best")})


def basis_dislocation(grid: DataFrame, documented: DataFrame, legacy: DataFrame, funding: DataFrame, source: str, basis_limits: tuple[float, float], speed_limits: tuple[float, float], slope_limits: tuple[float, float], clamp_basis: float, clamp_speed: float, confirm: bool, without_funding: bool, cooldown_ms: int) -> DataFrame:
    """Far and fast basis, with a funding rate that trends if ``confirm``; where there is no trend yet, ``without_funding`` lets it pass.

    Both series have basis and velocity; ``auto`` takes the documented ones and, each by itself, the legacy ones where there are none. The intensity is the
    greatest of the parts.
    """
    pair = {"doc": [documented], "legacy": [legacy], "auto": [documented, legacy]}[source]
    inputs = {f"{name}_{i}": (df.where(F.col(name).isNotNull()), name) for i, df in enumerate(pair) for name in ("basis", "velocity")}
    rows = _polled(grid, inputs | {"trend": (funding, "trend")})
    held = lambda c, most: F.greatest(F.least(c, F.lit(most)), F.lit(-most))
    first = lambda name: F.coalesce(*(F.col(f"{name}_{i}") for i in range(len(pair))))
    rows = rows.withColumns({"basis": held(first("basis"), clamp_basis), "velocity": held(first("velocity"), clamp_speed)})
    hit = (F.abs("basis") >= basis_limits[0]) & (F.abs("velocity") >= speed_limits[0])
    trending = F.abs("trend") >= slope_limits[0]
    if confirm:
        hit &= F.coalesce(trending, F.lit(without_funding))
    parts = [intensity(F.abs("basis"), *basis_limits), intensity(F.abs("velocity"), *speed_limits)]
    if confirm:
        parts.append(F.coalesce(clamp01((F.abs("trend") - slope_limits[0]) / (slope_limits[1] - slope_limits[0])), F.lit(0.0)))
    return cooled(rows.where(hit), KEY, cooldown_ms).withColumns({"kind": F.lit("basis_dislocation"), "side": F.lit("na"), "intensity": F.greatest(*parts)})


def change_shock(buckets: DataFrame, kind: str, least: float, strong: float, slope: float, cooldown_ms: int, names=("bull", "bear")) -> DataFrame:
    """Minute buckets whose value changed by ``least`` against its reference (columns d and dt in ms), at ``slope`` per second or more."""
    hits = buckets.where((F.abs("d") >= least) & (F.abs("d") / (F.col("dt") / 1000.0) >= slope)).withColumn("side", F.when(F.col("d") > 0, names[0]).otherwise(names[1]))
    return cooled(hits, KEY, cooldown_ms).withColumns({"kind": F.lit(kind), "intensity": intensity(F.abs("d"), least, strong)})


def iv_spike(polls: DataFrame, warn: float, strong: float, clamp: tuple[float, float], positive_only: bool, cooldown_ms: int) -> DataFrame:
    """Implied volatility of the surface now (``now``) against one some minutes old (``before``); where either is missing, that of the tickers
    (``ticker_now``, ``ticker_before``). ``source`` tells which."""
    held = lambda c: F.greatest(F.least(F.col(c), F.lit(clamp[1])), F.lit(clamp[0]))
    surface = F.col("now").isNotNull() & F.col("before").isNotNull()
    rows = polls.withColumns({"d": F.when(surface, held("now") - held("before")).otherwise(F.col("ticker_now") - F.col("ticker_before")), "source": F.when(surface, "surface").otherwise("ticker_fallback")})
    hits = rows.where((F.col("d") >= warn) if positive_only else (F.abs("d") >= warn)).withColumn("side", F.when(F.col("d") > 0, "up").otherwise("down"))
    return cooled(hits, KEY, cooldown_ms).withColumns({"kind": F.lit("iv_spike"), "intensity": intensity(F.abs("d"), warn, strong)})


def _scanned(polls: DataFrame, columns: list[str], step, out: str, kinds: list[pa.DataType]) -> DataFrame:
    """Poll after poll of each key past ``step(state, poll)``, which returns a row or None: sorted partitions stream, the state is all that is held."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in out.split(", ")]
        now, state = None, {}
        for batch in batches:
            found = []
            for poll in zip(*(batch.column(c).to_pylist() for c in range(len(columns))), strict=True):
                if poll[0] != now:
                    now, state = poll[0], {}
                if row := step(state, *poll):
                    found.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], names=names)

    return polls.select(*columns).repartition(columns[0]).sortWithinPartitions(*columns[:2]).mapInArrow(fold, out)


def term_inversion(polls: DataFrame, warn: float, strong: float, clamp: float, cooldown_ms: int) -> DataFrame:
    """Short volatility over long (``spread`` per poll) by ``warn``; ``velocity`` is against the poll evaluated before, and polls within the cooldown are
    not evaluated."""

    def step(state, key, ts, spread):
        if spread is None or "fired" in state and ts - state["fired"] < cooldown_ms:
            return None
        spread = min(max(spread, -clamp), clamp)
        velocity = (spread - state["spread"]) / ((ts - state["at"]) / 1000) if "at" in state and ts > state["at"] else None
        state["spread"], state["at"] = spread, ts
        if spread < warn or spread <= 0:
            return None
        state["fired"] = ts
        return key, ts, spread, velocity, min(max((spread - warn) / max(strong - warn, 1e-9), 0.0), 1.0)

    out = "instrument_id string, ts_ms long, spread double, velocity double, intensity double"
    got = _scanned(polls, ["instrument_id", "ts_ms", "spread"], step, out, [pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()])
    return got.withColumns({"kind": F.lit("term_structure_invert"), "side": F.lit("na")})


def liq_cluster(polls: DataFrame, warn: float, strong: float, clamp: float, move: float, momentum_ms: int, rebound: float, confirm_ms: int, cooldown_ms: int) -> DataFrame:
    """Liquidation volume (columns buy, sell, held to ``clamp``, and mid per poll) of ``warn`` or more arms on its dominant side (sell if equal) with the
    mid as anchor. A poll below disarms, a change of side arms anew, a rebound beyond ``rebound`` from the anchor disarms. It fires, and disarms,
    when the mid has moved ``move`` on the side's way against the mid ``momentum_ms`` before and the arm is ``confirm_ms`` old; polls within the cooldown
    are not evaluated."""
    rows = asof(polls.withColumn("seq", F.col("ts_ms")).where("mid is not null"), KEY, F.col("mid"), momentum_ms, 10 * momentum_ms, "was")
    moved = rows.select(*KEY, "ts_ms", (F.col("mid") - F.col("was.v")).alias("momentum"))
    held = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(clamp)).alias(c)
    polls = polls.join(moved, [*KEY, "ts_ms"], "left").select(*KEY, "ts_ms", held("buy"), held("sell"), "mid", "momentum")

    def step(state, key, ts, buy, sell, mid, momentum):
        if "fired" in state and ts - state["fired"] < cooldown_ms:
            return None
        side = "sell" if sell >= warn and sell >= buy else "buy" if buy >= warn else None
        if side is None or side != state.get("side"):
            state["side"], state["armed"], state["anchor"] = side, ts, mid
            return None
        if state["anchor"] is None:
            state["anchor"] = mid
        sign = -1 if side == "sell" else 1
        if mid is not None and state["anchor"] is not None and sign * (state["anchor"] - mid) > rebound:
            state["side"] = None
            return None
        if momentum is None or sign * momentum < move or ts - state["armed"] < confirm_ms:
            return None
        volume = sell if side == "sell" else buy
        state["fired"], state["side"] = ts, None
        return key, ts, side, volume, momentum, min(max((volume - warn) / max(strong - warn, 1e-9), 0.0), 1.0)

    out = "instrument_id string, ts_ms long, side string, volume double, momentum double, intensity double"
    got = _scanned(polls, ["instrument_id", "ts_ms", "buy", "sell", "mid", "momentum"], step, out, [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64()])
    return got.withColumn("kind", F.lit("liq_cluster"))


def gamma_flip(polls: DataFrame, least: float, hysteresis: float, stable: int, warn: float, strong: float, cooldown_ms: int) -> DataFrame:
    """Sign of net gamma exposure (column net per poll, from ``least`` up) that turned and stayed for ``stable`` polls at ``least * (1 + hysteresis)`` or
    more; a weaker poll or one of the old sign starts over."""

    def step(state, key, ts, net):
        if net is None or abs(net) < least or net == 0:
            return None
        sign = 1 if net > 0 else -1
        if not state.get("sign"):
            state["sign"] = sign
        elif sign == state["sign"] or abs(net) < least * (1 + hysteresis):
            state["count"] = 0
        else:
            state["count"] = state.get("count", 0) + 1
            if state["count"] >= stable and ("fired" not in state or ts - state["fired"] >= cooldown_ms):
                was, state["sign"], state["count"], state["fired"] = state["sign"], sign, 0, ts
                return key, ts, was, sign, net, min(max((abs(net) - warn) / max(strong - warn, 1e-9), 0.0), 1.0)
        return None

    out = "underlying string, ts_ms long, sign_from int, sign_to int, net double, intensity double"
    got = _scanned(polls, ["underlying", "ts_ms", "net"], step, out, [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64()])
    return got.withColumns({"kind": F.lit("gamma_flip"), "side": F.lit("na")})
