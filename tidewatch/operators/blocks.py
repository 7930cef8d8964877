"""Building blocks of the stateful operators: as-of references, windowed sums, runs, clamped sums, cooldowns.

Time is ``ts_ms`` (long milliseconds) and ties keep arrival order by ``seq``; keys are never null. A single busy instrument
spreads over as many tasks as it has time buckets:

* Blocks with a bounded horizon deal each row to its bucket and, if it lies within the horizon of the bucket's end, to
  the next one as a halo.
* Blocks without one work in two levels: windows within (key, bucket), and a row per (key, bucket) that carries the last value,
  sum or run over from bucket to bucket. Only these few rows of a key meet in one task. Such a block reads its input twice; if that is more than a scan, it
  is evaluated once and stored (see ``once``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .once import once

MS = 1000
#: Time bucket of the two-level blocks.
SPAN = 600_000
TIME = ("ts_ms", "seq")


def bucketed(df: DataFrame, horizon_ms: int, ts: str = "ts_ms") -> DataFrame:
    """``df`` with ``_bucket`` and ``_own``: false on copies that only serve rows of the next bucket."""
    span = max(60_000, 8 * horizon_ms)
    own = F.floor(F.col(ts) / span)
    near = F.floor((F.col(ts) + horizon_ms) / span)
    return df.withColumn("_at", F.explode(F.array_distinct(F.array(own, near)))).withColumn("_own", F.col("_at") == own).withColumnRenamed("_at", "_bucket")


def unbucketed(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_bucket", "_own")


def asof(df: DataFrame, keys: list[str], value: Column, back_ms: int, max_age_ms: int, name: str = "ref") -> DataFrame:
    """``name``: struct(ts_ms, seq, v) of the newest row at least ``back_ms`` and at most ``max_age_ms`` older; null if none."""
    # The frame only grows, so a row costs no more in a dense feed; the newest row of it is dropped where it is too old.
    w = Window.partitionBy(*keys, "_bucket").orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -back_ms)
    df = bucketed(df, max_age_ms).withColumn(name, F.max(F.struct("ts_ms", "seq", value.alias("v"))).over(w))
    return unbucketed(df.withColumn(name, F.when(F.col(name)["ts_ms"] >= F.col("ts_ms") - max_age_ms, F.col(name))))


def cut(df: DataFrame) -> DataFrame:
    """``df`` with the ``_bucket`` that its rows lie in."""
    return df.withColumn("_bucket", F.floor(F.col("ts_ms") / SPAN))


def local(keys: list[str], order=TIME):
    """The rows of a key and bucket in order."""
    return Window.partitionBy(*keys, "_bucket").orderBy(*order)


def carried(df: DataFrame, keys: list[str], **parts: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
    """``df`` (see ``cut``) with a column for each part (aggregate, fold): the fold, over a key's earlier buckets, of the aggregate by bucket."""
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_bucket").agg(*(a.alias(f"{name}_part") for name, (a, _) in parts.items()))
    sums = sums.select(*keys, "_bucket", *(fold(F.col(f"{name}_part")).over(earlier).alias(name) for name, (_, fold) in parts.items()))
    return df.join(sums, [*keys, "_bucket"])


def newest(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def last_known(df: DataFrame, keys: list[str], inclusive: bool = True, **values: Column) -> DataFrame:
    """``df`` with the newest non-null of each value among a key's rows up to this one, or before it."""
    names = list(values)
    df = cut(once(df)).withColumns({f"{n}_now": F.when(values[n].isNotNull(), F.struct(*TIME, values[n].alias("v"))) for n in names})
    frame = local(keys).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    df = df.withColumns({f"{n}_near": newest(F.col(f"{n}_now")).over(frame) for n in names})
    df = carried(df, keys, **{f"{n}_far": (F.max(f"{n}_now"), newest) for n in names})
    return df.withColumns({n: F.coalesce(f"{n}_near", f"{n}_far")["v"] for n in names}).drop("_bucket", *(f"{n}_{x}" for n in names for x in ("now", "near", "far")))


def previous(df: DataFrame, keys: list[str], columns: list[str], name: str = "was") -> DataFrame:
    """``name``: struct of ``columns`` of the key's row before; null at the first."""
    df = cut(once(df)).withColumn("_now", F.struct(*TIME, F.struct(*columns).alias("v")))
    df = df.withColumn("_near", F.lag("_now").over(local(keys)))
    df = carried(df, keys, _far=(F.max("_now"), newest))
    return df.withColumn(name, F.coalesce("_near", "_far")["v"]).drop("_bucket", "_now", "_near", "_far")


def running(df: DataFrame, keys: list[str], order: list[str], **values: Column) -> DataFrame:
    """``df`` with the running sum of each value over a key's rows in ``order``, which begins with ts_ms."""
    frame = local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    df = cut(once(df)).withColumns({f"{n}_add": v for n, v in values.items()})
    df = df.withColumns({f"{n}_near": F.sum(f"{n}_add").over(frame) for n in values})
    df = carried(df, keys, **{f"{n}_far": (F.sum(f"{n}_add"), F.sum) for n in values})
    return df.withColumns({n: F.col(f"{n}_near") + F.coalesce(f"{n}_far", F.lit(0)) for n in values}).drop("_bucket", *(f"{n}_{x}" for n in values for x in ("add", "near", "far")))


def asof_joins(left: DataFrame, keys: list[str], rights: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """``left`` with, for each name, the newest value of its right side at or before its time: all sides in one ordered stream, no range join."""
    names, sides = left.columns, list(rights)
    kinds = {n: rights[n][0].select(rights[n][1].alias("v")).schema for n in sides}
    rows = left.select(*keys, "ts_ms", F.lit(None).cast("long").alias("_q"), F.lit(len(sides)).alias("_kind"), F.struct(*names).alias("_row"), *(F.lit(None).cast(kinds[n]).alias(f"_v{i}") for i, n in enumerate(sides)))
    kind_of_row = rows.schema["_row"].dataType
    for at, n in enumerate(sides):
        right, value = rights[n]
        values = [F.struct(value.alias("v")) if i == at else F.lit(None).cast(kinds[m]) for i, m in enumerate(sides)]
        rows = rows.unionByName(right.select(*keys, "ts_ms", F.col("seq").alias("_q"), F.lit(at).alias("_kind"), F.lit(None).cast(kind_of_row).alias("_row"), *(v.alias(f"_v{i}") for i, v in enumerate(values))))
    frame = local(keys, ("ts_ms", "_kind", "_q")).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut(once(rows)).withColumns({f"_near{i}": newest(F.col(f"_v{i}")).over(frame) for i in range(len(sides))})
    rows = carried(rows, keys, **{f"_far{i}": (F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.struct("ts_ms", "_q"))), newest) for i in range(len(sides))})
    found = [F.coalesce(f"_near{i}", f"_far{i}")["v"].alias(n) for i, n in enumerate(sides)]
    return rows.where(F.col("_kind") == len(sides)).select("_row.*", *found)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``left`` with the newest ``value`` of ``right`` at or before its time."""
    return asof_joins(left, keys, {name: (right, value)})


def asof_growing(df: DataFrame, keys: list[str], value: Column, back_ms: int, name: str = "ref") -> DataFrame:
    """``asof`` without an age limit."""
    df = once(df)
    probes = df.select(*keys, (F.col("ts_ms") - back_ms).alias("ts_ms"), F.struct(*df.columns).alias("_all"))
    return asof_join(probes, df, keys, F.struct(*TIME, value.alias("v")), name).select("_all.*", name)


def asof_forward(df: DataFrame, keys: list[str], value: Column, ahead_ms: int, name: str = "ahead") -> DataFrame:
    """``name``: struct(ts_ms, seq, v) of the first row at least ``ahead_ms`` later: an as-of join in reversed time."""
    df = once(df)
    probes = df.select(*keys, (-(F.col("ts_ms") + ahead_ms)).alias("ts_ms"), F.struct(*df.columns).alias("_all"))
    turned = df.select(*keys, (-F.col("ts_ms")).alias("ts_ms"), (-F.col("seq")).alias("seq"), F.struct(*TIME, value.alias("v")).alias("_found"))
    return asof_join(probes, turned, keys, F.col("_found"), name).select("_all.*", name)


def trailing_sum(df: DataFrame, keys: list[str], value: Column, window_ms: int, name: str) -> DataFrame:
    """Sum of ``value`` over rows up to this one that are at most ``window_ms`` older; later rows of the same instant don't count."""
    exact = F.coalesce(value, F.lit(0)).cast("decimal(28,8)")
    df = bucketed(df, window_ms).withColumn("_cum", F.sum(exact).over(Window.partitionBy(*keys, "_bucket").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*keys, "_bucket").orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, -window_ms - 1)
    df = df.withColumn(name, (F.col("_cum") - F.coalesce(F.max(F.struct("ts_ms", "seq", "_cum")).over(before)["_cum"], F.lit(0))).cast("double"))
    return unbucketed(df.drop("_cum"))


def run_ids(df: DataFrame, keys: list[str], columns: list[str], breaks: Callable[[Column, Column], Column], name: str = "run") -> DataFrame:
    """``name`` tells the runs of each key apart: struct(ts_ms, seq) of the first row of the row's run.

    ``breaks(was, now)`` says, of the structs (ts_ms, seq, ``columns``) of a row and the one before, whether a run starts at it; it does where
    that is null too, and at the first row.
    """
    starts = lambda was, now: F.when(F.coalesce(breaks(was, now), F.lit(True)), F.struct(*(now[c].alias(c) for c in TIME)))
    now, near = F.col("_now"), F.col("_near")
    df = cut(once(df)).withColumn("_now", F.struct(*dict.fromkeys((*TIME, *columns)))).withColumn("_near", F.lag("_now").over(local(keys)))
    df = df.withColumn("_start", F.when(near.isNotNull(), starts(near, now)))
    earlier = Window.partitionBy(*keys).orderBy("_bucket")
    sums = df.groupBy(*keys, "_bucket").agg(F.min("_now").alias("_first"), F.max("_now").alias("_last"), F.max("_start").alias("_within"))
    sums = sums.withColumn("_before", F.lag("_last").over(earlier))
    sums = sums.withColumn("_head", F.when(F.col("_before").isNull(), F.struct(*(F.col("_first")[c].alias(c) for c in TIME))).otherwise(starts(F.col("_before"), F.col("_first"))))
    far = newest(F.coalesce("_within", "_head")).over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    df = df.join(sums.select(*keys, "_bucket", "_head", far.alias("_far")), [*keys, "_bucket"])
    df = df.withColumn("_start", F.when(near.isNull(), F.col("_head")).otherwise(F.col("_start")))
    within = newest(F.col("_start")).over(local(keys).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.coalesce(within, "_far")).drop("_bucket", "_now", "_near", "_start", "_head", "_far")


def clamped_sum(df: DataFrame, keys: list[str], delta: Column, name: str) -> DataFrame:
    """Running sum that never falls below zero: the plain running sum less its least value so far, if that is negative."""
    frame = local(keys).rowsBetween(Window.unboundedPreceding, 0)
    df = cut(once(df)).withColumn("_add", delta.cast("decimal(28,8)"))
    df = df.withColumn("_x", F.sum("_add").over(frame)).withColumn("_low", F.min("_x").over(frame))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "_bucket").agg(F.sum("_add").alias("_total"), F.min("_x").alias("_least"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    sums = sums.select(*keys, "_bucket", "_base", F.min(F.col("_base") + F.col("_least")).over(earlier).alias("_floor"))
    df = df.join(sums, [*keys, "_bucket"])
    least = F.least(F.lit(0), F.col("_floor"), F.col("_base") + F.col("_low"))
    return df.withColumn(name, (F.col("_base") + F.col("_x") - least).cast("double")).drop("_bucket", "_add", "_x", "_low", "_base", "_floor")


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key by ``order`` (all descending); partial maxima combine before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def cooled(candidates: DataFrame, keys: list[str], cooldown_ms: int) -> DataFrame:
    """The candidates that fire: the first, then each that comes at least ``cooldown_ms`` after the last that fired.

    Each key's candidates stream in order past a fold that holds the last firing alone, however dense they are.
    """
    candidates = once(candidates)
    names = candidates.columns
    times = candidates.select(*keys, "ts_ms", "seq")

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            held = [batch.column(k).to_pylist() for k in range(len(keys))]
            chosen = []
            for row, (key, ts) in enumerate(zip(zip(*held, strict=True), batch.column("ts_ms").to_pylist(), strict=True)):
                if ts is not None and (now is None or key != now or ts - last >= cooldown_ms):
                    now, last = key, ts
                    chosen.append(row)
            yield batch.take(pa.array(chosen, pa.int64()))

    fired = times.repartition(*keys).sortWithinPartitions(*keys, "ts_ms", "seq").mapInArrow(fire, times.schema)
    return candidates.join(fired, [*keys, "ts_ms", "seq"], "left_semi").select(*names)


def held(samples: DataFrame, keys: list[str], condition: Column, hold_ms: int, cooldown_ms: int) -> DataFrame:
    """The samples that fire, with ``armed_ms``: the condition arms at a sample, holds at all samples since, and fires once it has held ``hold_ms``,
    at the next sample at the earliest. Firing disarms, and so does a sample where the condition is false or null; within ``cooldown_ms`` of a firing
    nothing arms.

    Runs of true samples are found in two levels; the true samples' times stream in order past a fold that holds the arm and the last firing alone.
    """
    samples = once(samples)
    names = samples.columns
    rows = run_ids(samples.withColumn("_on", F.coalesce(condition, F.lit(False))), keys, ["_on"], lambda was, now: was["_on"] != now["_on"], "_run").where("_on")
    times = rows.select(*keys, *TIME, F.col("_run.ts_ms").alias("_run_ms"), F.col("_run.seq").alias("_run_seq"), F.lit(0).cast("long").alias("armed_ms"))

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = run = armed = last = None
        for batch in batches:
            chosen, since = [], []
            columns = [batch.column(k).to_pylist() for k in range(len(keys))], [batch.column(c).to_pylist() for c in ("_run_ms", "_run_seq")]
            for row, (key, this, ts) in enumerate(zip(zip(*columns[0], strict=True), zip(*columns[1], strict=True), batch.column("ts_ms").to_pylist(), strict=True)):
                if key != now:
                    now, run, last = key, None, None
                if this != run:
                    run, armed = this, None
                if last is not None and ts - last < cooldown_ms:
                    continue
                if armed is None:
                    armed = ts
                elif ts - armed >= hold_ms:
                    chosen.append(row)
                    since.append(armed)
                    last, armed = ts, None
            fired = batch.take(pa.array(chosen, pa.int64()))
            yield pa.RecordBatch.from_arrays([*fired.columns[:-1], pa.array(since, pa.int64())], names=batch.schema.names)

    fired = times.repartition(*keys).sortWithinPartitions(*keys, *TIME).mapInArrow(fire, times.schema).select(*keys, *TIME, "armed_ms")
    return samples.join(fired, [*keys, *TIME]).select(*names, "armed_ms")


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def intensity(x: Column, warn: float, strong: float) -> Column:
    """Share of the way from ``warn`` to ``strong``, held to 0..1."""
    return clamp01((x - warn) / max(strong - warn, 1e-9))
