"""Order books from level deltas, and the metrics on them.

The state of a level is a clamped running sum of its deltas. The best levels at any instants come from a replay: time is cut into buckets, the
level states at each bucket's start (its checkpoint) follow from sums by level and bucket, and a bucket's deltas run in order over a sorted
map that starts from its checkpoint. So buckets are replayed side by side, each delta once, and the cost is that of deltas and instants, not of
levels times instants. Where all levels of an instant are wanted, levels are cut into lifetimes, and these meet the instants.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import SPAN, carried, clamped_sum, cut, last_known, local
from .once import once

LEVEL = ["instrument_id", "side", "price"]


def levels(depth: DataFrame) -> DataFrame:
    """``level_qty`` of the row's level after each delta: never below zero, updates add like inserts."""
    signed = F.when(F.col("action") == "delete", -F.col("qty")).otherwise(F.col("qty"))
    return clamped_sum(depth, LEVEL, signed, "level_qty")


def absolute_books(messages: DataFrame, top: int) -> DataFrame:
    """The best ``top`` levels of each side at the end of each epoch of a feed of absolute quantities, with ``gapped``.

    ``messages``: instrument_id, ts_ms, seq, kind, first_u, u, pu and levels, an array of (side, price, qty). A ``snapshot`` starts an epoch: it is the whole book
    as of update u. A ``diff`` sets its levels, zero removes one. It must follow on: the first after a snapshot spans update u + 1, each later
    one names the last as pu. One that brings nothing new (its u has been seen) is left out. One that doesn't follow ends the epoch: the book is
    unknown from there to the next snapshot, and ``gapped`` is true. Diffs before the first snapshot don't count. ``epoch`` is the snapshot's (ts_ms, seq).
    """
    whole = F.when(F.col("kind") == "snapshot", F.struct("ts_ms", "seq", "u"))
    rows = last_known(messages, ["instrument_id"], inclusive=True, _snap=whole).where("_snap is not null")
    rows = cut(once(rows.withColumn("epoch", F.struct("_snap.ts_ms", "_snap.seq"))))
    epoch = ["instrument_id", "epoch"]
    rows = rows.withColumn("_near", F.max("u").over(local(epoch).rowsBetween(Window.unboundedPreceding, -1)))
    rows = carried(rows, epoch, _far=(F.max("u"), F.max)).withColumn("_last", F.greatest("_near", "_far"))
    diff = F.col("kind") == "diff"
    rows = once(rows.where(~diff | (F.col("u") > F.col("_last"))).drop("_bucket", "_near", "_far"))
    gap = diff & F.when(F.col("_last") == F.col("_snap.u"), F.col("first_u") > F.col("_last") + 1).otherwise(F.col("pu") != F.col("_last"))
    broken = rows.where(gap).groupBy(*epoch).agg(F.min(F.struct("ts_ms", "seq")).alias("_broken"))
    alive = rows.join(broken, epoch, "left").where(F.col("_broken").isNull() | (F.struct("ts_ms", "seq") < F.col("_broken")))
    levels_of = alive.select(*epoch, "ts_ms", "seq", F.col("_broken").isNotNull().alias("gapped"), F.explode("levels").alias("_l")).select(*epoch, "ts_ms", "seq", "gapped", "_l.side", "_l.price", "_l.qty")
    state = levels_of.groupBy(*epoch, "gapped", "side", "price").agg(F.max_by("qty", F.struct("ts_ms", "seq")).alias("qty")).where("qty > 0")
    return ranked(state, epoch, top)


def ranked(state: DataFrame, keys: list[str], top: int) -> DataFrame:
    """``level`` 1..top of each side, best first."""
    best = F.when(F.col("side") == "buy", -F.col("price")).otherwise(F.col("price"))
    return state.withColumn("level", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(best))).where(F.col("level") <= top)


def lifetimes(depth: DataFrame) -> DataFrame:
    """(level, qty, from_ms, to_ms) for each stretch of time in which a level holds a quantity above zero; open ones end never."""
    until = F.lead("ts_ms").over(Window.partitionBy(*LEVEL).orderBy("ts_ms", "seq"))
    rows = levels(depth).withColumn("to_ms", until).where("level_qty > 0")
    return rows.select(*LEVEL, F.col("level_qty").alias("qty"), F.col("ts_ms").alias("from_ms"), "to_ms").where("to_ms is null or to_ms > from_ms")


#: Quantities are replayed as whole numbers of this part of a unit, so what was added and taken leaves nothing.
UNIT = 1e8
FIRST, LAST = -(1 << 62), 1 << 62
HEADS = "instrument_id string, ts_ms bigint, seq bigint, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>, bid_levels bigint, ask_levels bigint"


def checkpoints(rows: DataFrame, last: int) -> DataFrame:
    """The levels above zero at the start of each bucket up to ``last``, from ``rows`` (instrument_id, bucket, ts_ms, seq, buy, price, units).

    A bucket changes a level's state S to T + max(S, -m), of its total T and its least running sum m <= 0. Over the buckets of a level that is
    the running total less its least value, in sums of a row a level and bucket.
    """
    level = ["instrument_id", "buy", "price"]
    running = F.sum("units").over(Window.partitionBy(*level, "bucket").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0))
    parts = rows.withColumn("_x", running).groupBy(*level, "bucket").agg(F.sum("units").alias("_total"), F.least(F.min("_x"), F.lit(0)).alias("_low"))
    of = Window.partitionBy(*level).orderBy("bucket")
    parts = parts.withColumn("_base", F.coalesce(F.sum("_total").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    least = F.least(F.lit(0), F.min(F.col("_base") + F.col("_low")).over(of.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.withColumns({"_state": F.col("_base") + F.col("_total") - least, "_next": F.lead("bucket").over(of)}).where("_state > 0")
    until = F.coalesce("_next", F.lit(last))
    parts = parts.where(F.col("bucket") < until).withColumn("bucket", F.explode(F.sequence(F.col("bucket") + 1, until)))
    return parts.select("instrument_id", "bucket", (F.col("bucket") * SPAN).alias("ts_ms"), F.lit(FIRST).alias("seq"), F.lit(0).alias("kind"), "buy", "price", F.col("_state").alias("units"))


def replay(depth: DataFrame, top: int, every_ms: int | None = None, at: DataFrame | None = None) -> DataFrame:
    """The best ``top`` levels of each side (HEADS) at multiples of ``every_ms`` up to the last row, and at the rows of ``at`` (instrument_id, ts_ms, seq).

    A row of ``at`` sees the deltas up to its place by (ts_ms, seq), an instant all of its own; an instant that ``at`` names with the seq LAST comes once. Where no
    level is open there is no row.
    """
    signed = F.when(F.col("action") == "delete", -F.col("qty")).otherwise(F.col("qty"))
    bucket = F.floor(F.col("ts_ms") / SPAN)
    deltas = depth.select("instrument_id", bucket.alias("bucket"), "ts_ms", "seq", (F.col("side") == "buy").alias("buy"), "price", F.round(signed * UNIT).cast("long").alias("units"))
    times = depth.select("ts_ms", F.col("ts_ms").alias("own")) if at is None else depth.select("ts_ms", F.col("ts_ms").alias("own")).unionByName(at.select("ts_ms"), allowMissingColumns=True)
    newest, stop = (x or 0 for x in times.agg(F.max("ts_ms"), F.max("own")).first())  # two numbers
    rows = deltas.select("instrument_id", "bucket", "ts_ms", "seq", F.lit(1).alias("kind"), "buy", "price", "units").unionByName(checkpoints(deltas, newest // SPAN))
    if at is not None:
        rows = rows.unionByName(at.select("instrument_id", bucket.alias("bucket"), "ts_ms", "seq", F.lit(2).alias("kind")), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left, insort

        import numpy as np

        now, due, limit = None, None, -1
        sides = (([], {}), ([], {}))  # asks, bids: prices in order, and their quantities
        heads, names, times, places, counts, stops, prices, units = None, [], [], [], ([], []), ([0], [0]), ([], []), ([], [])

        def emit(ts: int, seq: int) -> None:
            nonlocal heads
            if heads is None:
                (asks, a), (bids, b) = sides
                best = bids[: -top - 1 : -1]
                heads = (best, [b[p] for p in best], asks[:top], [a[p] for p in asks[:top]], len(bids), len(asks))
            if not heads[4] and not heads[5]:
                return
            names.append(now[0])
            times.append(ts)
            places.append(seq)
            for k in (0, 1):
                prices[k].extend(heads[2 * k])
                units[k].extend(heads[2 * k + 1])
                stops[k].append(len(prices[k]))
                counts[k].append(heads[4 + k])

        def grid(until: int) -> None:
            """The instants up to ``until``."""
            nonlocal due
            while due <= until:
                emit(due, due)
                due += every_ms

        def made() -> pa.RecordBatch:
            levels = [pa.ListArray.from_arrays(pa.array(stops[k], pa.int32()), pa.StructArray.from_arrays([pa.array(prices[k], pa.float64()), pa.array(np.array(units[k], np.float64) / UNIT)], ["price", "qty"])) for k in (0, 1)]
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int64()), pa.array(places, pa.int64()), *levels, *(pa.array(c, pa.int64()) for c in counts)], names=["instrument_id", "ts_ms", "seq", "bids", "asks", "bid_levels", "ask_levels"])
            for held in (names, times, places, *counts, *prices, *units):
                held.clear()
            for k in (0, 1):
                stops[k][:] = [0]
            return batch

        for batch in batches:
            for *key, ts, seq, kind, buy, price, size in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if key != now:
                    if now is not None and every_ms:
                        grid(limit)
                    now, heads = key, None
                    for held in sides:
                        held[0].clear()
                        held[1].clear()
                    if every_ms:
                        due, limit = -(-key[1] * SPAN // every_ms) * every_ms, min((key[1] + 1) * SPAN - 1, stop)
                if every_ms and due < ts:
                    grid(min(ts - 1, limit))
                if kind == 2:
                    emit(ts, seq)
                    if every_ms and ts == due and seq == LAST:
                        due += every_ms
                else:
                    order, held = sides[buy]
                    left = size if kind == 0 else held.get(price, 0) + size
                    if left > 0:
                        if price not in held:
                            insort(order, price)
                        held[price] = left
                        heads = None
                    elif price in held:
                        del held[price], order[bisect_left(order, price)]
                        heads = None
                if len(times) >= 10_000:
                    yield made()
        if now is not None and every_ms:
            while due <= limit:
                grid(min(limit, due + 10_000 * every_ms))
                yield made()
        if times:
            yield made()

    columns = ["instrument_id", "bucket", "ts_ms", "seq", "kind", "buy", "price", "units"]
    return rows.select(columns).repartition("instrument_id", "bucket").sortWithinPartitions("instrument_id", "bucket", "ts_ms", "seq", "kind").mapInArrow(run, HEADS)


def instants(rows: DataFrame) -> DataFrame:
    """The distinct instants of ``rows``, each after all deltas of its own."""
    return rows.select("instrument_id", "ts_ms").distinct().withColumn("seq", F.lit(LAST))


def with_best(depth: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of ``depth`` with ``best_bid`` and ``best_ask`` as of each, all deltas up to the row applied."""
    best = replay(depth, 1, at=rows.select("instrument_id", "ts_ms", "seq")).select("instrument_id", "ts_ms", "seq", F.get("bids", F.lit(0))["price"].alias("best_bid"), F.get("asks", F.lit(0))["price"].alias("best_ask"))
    return rows.join(best, ["instrument_id", "ts_ms", "seq"], "left")


def at_instants(depth: DataFrame, every_ms: int) -> DataFrame:
    """The live levels (instant, side, price, qty) at multiples of ``every_ms`` up to the last row, the instant's own rows included."""
    end = depth.agg((F.floor(F.max("ts_ms") / every_ms) * every_ms).alias("_end"))
    lives = lifetimes(depth).crossJoin(F.broadcast(end))
    first = F.ceil(F.col("from_ms") / every_ms) * every_ms
    last = F.when(F.col("to_ms").isNull(), F.col("_end")).otherwise(F.ceil(F.col("to_ms") / every_ms) * every_ms - every_ms)
    spans = lives.withColumns({"_a": first, "_z": F.least(last, F.col("_end"))}).where("_a <= _z")
    return spans.select(*LEVEL, "qty", F.explode(F.sequence("_a", "_z", F.lit(every_ms).cast("long"))).alias("instant"))


def summary(depth: DataFrame, every_ms: int | None, top: int = 5, at: DataFrame | None = None) -> DataFrame:
    """A row per instrument and instant (see ``replay``): best prices and quantities, volumes of the top levels, level counts and what follows from them."""
    got = replay(depth, top, every_ms, at)
    first = lambda side, field: F.get(side, F.lit(0))[field]
    volume = lambda side: F.aggregate(F.col(side)["qty"], F.lit(0.0), lambda sum_, q: sum_ + q)
    got = got.select(
        "instrument_id", F.col("ts_ms").alias("instant"), first("bids", "price").alias("best_bid"), first("asks", "price").alias("best_ask"), first("bids", "qty").alias("bid_qty"), first("asks", "qty").alias("ask_qty"),
        volume("bids").alias("bid_vol"), volume("asks").alias("ask_vol"), "bid_levels", "ask_levels",
    )
    total, count = F.col("bid_vol") + F.col("ask_vol"), F.col("bid_levels") + F.col("ask_levels")
    return got.withColumns({
        "imbalance": F.try_divide(F.col("bid_vol") - F.col("ask_vol"), total), "dominance_bid": F.try_divide(F.col("bid_vol"), total), "level_share_bid": F.try_divide(F.col("bid_levels").cast("double"), count),
        "spread": F.greatest(F.col("best_ask") - F.col("best_bid"), F.lit(0.0)), "wmid": (F.col("best_ask") + F.col("best_bid")) / 2,
    })


def depletion(now: Column, before: Column) -> Column:
    """Share of the earlier volume that is gone, none if it grew."""
    return F.greatest(F.lit(0.0), F.try_divide(before - now, before))


def padded(heads: DataFrame, top: int) -> DataFrame:
    """``heads`` (see ``replay``) with arrays of ``top`` prices and quantities per side, best first, padded with zeros."""
    filled = {f"{name}_{plural}": F.slice(F.concat(F.col(side)[field], F.array_repeat(F.lit(0.0), top)), 1, top) for name, side in (("bid", "bids"), ("ask", "asks")) for field, plural in (("price", "prices"), ("qty", "qtys"))}
    return heads.withColumns(filled).drop("bids", "asks")
