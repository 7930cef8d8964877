"""Rolling metrics over samples (ts_ms, seq, a value) and continuity of update ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import asof, asof_growing, bucketed, carried, cut, local, unbucketed


def clean(df: DataFrame, value: str) -> DataFrame:
    """Samples with a finite value."""
    c = F.col(value)
    return df.where(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))


def mean(df: DataFrame, keys: list[str], value: str, window_ms: int, name: str = "mean") -> DataFrame:
    """Mean of the samples in [t - window, t]."""
    # A window is the end of one stretch of its length and the beginning of the next: both are sums that only grow, so nothing is taken away again.
    # An instant's rows all count, so stretches begin after it: the earlier part is summed from its end, the later one up to this instant.
    df = bucketed(df, window_ms).withColumn("_s", F.floor(F.col("ts_ms") / (window_ms + 1)))
    here = Window.partitionBy(*keys, "_bucket", "_s")
    up = here.orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, 0)
    down = here.orderBy(F.desc("ts_ms")).rangeBetween(Window.unboundedPreceding, 0)
    both = {f"{name}{at}": f(value).over(w) for name, f in (("_sum", F.sum), ("_n", F.count)) for at, w in (("_up", up), ("_down", down))}
    df = df.withColumns(both)
    # The first instant at or after the window's begin, in the stretch before; frames in falling time grow too.
    since = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("ts_ms")).rangeBetween(Window.unboundedPreceding, window_ms)
    df = df.withColumn("_tail", F.min(F.struct("ts_ms", "_s", "_sum_down", "_n_down")).over(since))
    earlier = F.col("_tail._s") < F.col("_s")
    total = F.when(earlier & F.col("_tail._sum_down").isNotNull(), F.coalesce("_sum_up", F.lit(0.0)) + F.col("_tail._sum_down")).otherwise(F.col("_sum_up"))
    count = F.col("_n_up") + F.when(earlier, F.col("_tail._n_down")).otherwise(0)
    return unbucketed(df.withColumn(name, F.try_divide(total, count)).drop("_s", "_tail", *both))


def delta(df: DataFrame, keys: list[str], value: str, window_ms: int, max_age_ms: int) -> DataFrame:
    """``ref``, the newest sample at least the window old, and ``delta`` against it."""
    return asof(df, keys, F.col(value), window_ms, max_age_ms).withColumn("delta", F.col(value) - F.col("ref.v"))


def derivative(df: DataFrame, keys: list[str], value: str, window_ms: int, max_age_ms: int) -> DataFrame:
    dt = F.greatest((F.col("ts_ms") - F.col("ref.ts_ms")) / 1000.0, F.lit(1e-6))
    return delta(df, keys, value, window_ms, max_age_ms).withColumn("slope", F.col("delta") / dt)


def second_derivative(df: DataFrame, keys: list[str], value: str, window_ms: int, max_age_ms: int) -> DataFrame:
    """Change per second between the slope here and the slope at the reference sample, which the reference carries along."""
    first = derivative(df, keys, value, window_ms, max_age_ms).drop("ref", "delta")
    both = asof(first, keys, F.col("slope"), window_ms, max_age_ms)
    dt = F.greatest((F.col("ts_ms") - F.col("ref.ts_ms")) / 1000.0, F.lit(1e-6))
    return both.withColumn("accel", (F.col("slope") - F.col("ref.v")) / dt)


def percent_change(df: DataFrame, keys: list[str], value: str, window_ms: int) -> DataFrame:
    ref = asof_growing(df, keys, F.col(value), window_ms)
    return ref.withColumn("pct", (F.col(value) - F.col("ref.v")) / F.nullif(F.col("ref.v"), F.lit(0.0)) * 100)


def trend(df: DataFrame, keys: list[str], value: str, window_ms: int) -> DataFrame:
    """Slope per second against the sample as of the window ago, over one second at least."""
    ref = asof_growing(df, keys, F.col(value), window_ms)
    return ref.withColumn("trend", (F.col(value) - F.col("ref.v")) / F.greatest((F.col("ts_ms") - F.col("ref.ts_ms")) / 1000.0, F.lit(1.0)))


def _with_last(df: DataFrame) -> DataFrame:
    """``_last``: the greatest id among the instrument's rows before."""
    frame = local(["instrument_id"]).rowsBetween(Window.unboundedPreceding, -1)
    df = carried(cut(df).withColumn("_near", F.max("u").over(frame)), ["instrument_id"], _far=(F.max("u"), F.max))
    return df.withColumn("_last", F.greatest("_near", "_far")).drop("_bucket", "_near", "_far")


def continuity(df: DataFrame, huge: int = 500_000) -> DataFrame:
    """kind of each update by its previous id against the last one seen: first, in_sync, stale, huge_gap (rebase) or gap (resync)."""
    last, pu = F.col("_last"), F.col("pu")
    kind = F.when(last.isNull(), "first").when(pu == last, "in_sync").when(pu < last, "stale").when(pu - last >= huge, "huge_gap").otherwise("gap")
    return _with_last(df).withColumn("kind", kind).drop("_last")


def continuity_overlap(df: DataFrame) -> DataFrame:
    """The stricter rule, by which an update that spans the next expected id is in sync."""
    last = F.col("_last")
    inside = (F.col("first_u") <= last + 1) & (F.col("u") >= last + 1)
    kind = F.when(last.isNull(), "first").when((F.col("pu") == last) | inside, "in_sync").when(F.col("u") <= last, "stale").otherwise("gap")
    return _with_last(df).withColumn("kind", kind).drop("_last")


def option_gap(df: DataFrame, w: WindowSpec) -> DataFrame:
    return df.withColumn("gap", F.coalesce(F.col("prev_change_id") != F.lag("seq").over(w), F.lit(False)))
