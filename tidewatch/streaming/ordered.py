"""Stateful folds over streams whose rows come out of order, also across micro-batches, with state that ends.

A key's rows wait in a list until the watermark has passed them; then no earlier row can come any more, and they are folded in order of (ts_ms, seq).
So the fold sees what a batch job would sort. Timers of event time release rows where no new ones come, and drop the state of a key that has been idle:
after ``idle_ms`` without a row the fold's state no longer matters to it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Quantities are summed as whole numbers of this part of a unit: what leaves a window takes away just what it brought.
UNIT = 1e8


def keep_state_in_files(spark: SparkSession) -> None:
    """The state store that lists, maps and timers need; holds for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Ordered(StatefulProcessor):
    """Folds a key's rows in order of (ts_ms, seq), the first two of ``fields``. A subclass says what one row does to the state."""

    fields: str
    state: str
    out: list[str]
    idle_ms: int

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.now = handle.getValueState("now", self.state)

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row: tuple) -> tuple[tuple, tuple | None]:
        """The state after a row, and what the row gives, if anything."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        names = [f.split()[0] for f in self.fields.split(", ")]
        new = [row for frame in rows for row in frame[names].itertuples(index=False, name=None)]
        old = list(self.waiting.get()) if self.waiting.exists() else []
        yield self._release(key, old + [tuple(x.item() if hasattr(x, "item") else x for x in row) for row in new], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield self._release(key, list(self.waiting.get()) if self.waiting.exists() else [], timerValues)

    def _release(self, key, rows: list[tuple], timer_values):
        import pandas as pd

        passed = timer_values.getCurrentWatermarkInMs()
        rows.sort(key=lambda r: r[:2])
        ready, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        state, last, out = self.start(), None, []
        if self.now.exists():
            *state, last = self.now.get()
            state = tuple(state)
        for row in ready:
            state, found = self.step(state, row)
            last = row[0]
            if found is not None:
                out.append((*key, *found))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None and last + self.idle_ms <= passed:
            self.now.clear()
        elif last is not None:
            self.now.update((*state, last))
            self.handle.registerTimer(last + self.idle_ms)
        if later:
            self.handle.registerTimer(later[0][0])
        return pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


class Runs(Ordered):
    """Runs of one side at most ``gap_ms`` apart: a row for each trade at which a run qualifies. A run that the gap has ended leaves no state."""

    fields = "ts_ms long, seq long, side string, qty double"
    state = "prev_ms long, side string, k long, volume long, last_ms long"
    out = ["user_id", "seq", "side", "k", "volume"]

    def __init__(self, gap_ms: int, k_min: int, qty_min: float):
        self.idle_ms, self.k_min, self.units_min = gap_ms + 1, k_min, round(qty_min * UNIT)

    def start(self):
        return (None, None, 0, 0)

    def step(self, state, row):
        last, side, k, volume = state
        ts, seq, now, qty = row
        if side != now or last is None or ts - last > self.idle_ms - 1:
            k, volume = 0, 0
        k, volume = k + 1, volume + round(qty * UNIT)
        return (ts, now, k, volume), (seq, now, k, volume / UNIT) if k >= self.k_min and volume >= self.units_min else None


class Trailing(Ordered):
    """The sum of a key's quantities in the last ``window_ms`` at each row. State is the rows of the window, none once it has passed."""

    fields = "ts_ms long, seq long, qty double"
    state = "times array<long>, sizes array<long>, last_ms long"
    out = ["user_id", "seq", "volume"]

    def __init__(self, window_ms: int):
        self.idle_ms = window_ms + 1

    def start(self):
        return ([], [])

    def step(self, state, row):
        times, sizes = list(state[0]), list(state[1])
        ts, seq, qty = row
        times.append(ts)
        sizes.append(round(qty * UNIT))
        begin = 0
        while times[begin] < ts - (self.idle_ms - 1):
            begin += 1
        times, sizes = times[begin:], sizes[begin:]
        return (times, sizes), (seq, sum(sizes) / UNIT)


class Suppressed(Ordered):
    """Alerts of one key within ``window_ms`` of the first are one: at each hit the alert as it stands by then, with its first and last time and number of hits."""

    fields = "ts_ms long, seq long"
    state = "first_ms long, n long, last_ms long"
    out = ["dedup_key", "ts_first", "ts_last", "n_hits"]

    def __init__(self, window_ms: int):
        self.idle_ms = window_ms

    def start(self):
        return (None, 0)

    def step(self, state, row):
        first, n = state
        if first is None or row[0] - first >= self.idle_ms:
            first, n = row[0], 0
        return (first, n + 1), (first, row[0], n + 1)


def suppressed(alerts: DataFrame, window_ms: int, late: str) -> DataFrame:
    """``Suppressed`` over a stream of (dedup_key, at, ts_ms, seq); an upsert by (dedup_key, ts_first) keeps the last state of each alert."""
    keep_state_in_files(alerts.sparkSession)
    return alerts.withWatermark("at", late).groupBy("dedup_key").transformWithStateInPandas(Suppressed(window_ms), "dedup_key string, ts_first long, ts_last long, n_hits long", "Append", "EventTime")


def sessions(trades: DataFrame, gap_ms: int, k_min: int, qty_min: float, late: str) -> DataFrame:
    """``Runs`` per user over a stream of (user_id, at, ts_ms, seq, side, qty); ``ts_ms`` is ``at`` in milliseconds, rows up to ``late`` behind still count."""
    keep_state_in_files(trades.sparkSession)
    return trades.withWatermark("at", late).groupBy("user_id").transformWithStateInPandas(Runs(gap_ms, k_min, qty_min), "user_id long, seq long, side string, k long, volume double", "Append", "EventTime")


def sliding(trades: DataFrame, window_ms: int, late: str) -> DataFrame:
    """``Trailing`` per user over a stream of (user_id, at, ts_ms, seq, qty)."""
    keep_state_in_files(trades.sparkSession)
    return trades.withWatermark("at", late).groupBy("user_id").transformWithStateInPandas(Trailing(window_ms), "user_id long, seq long, volume double", "Append", "EventTime")
