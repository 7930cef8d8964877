"""Implied-volatility surface by minute from option ticks joined with their instruments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Tenor buckets (up to days) and half-open moneyness bands.
TENORS = (("0_7d", 7), ("7_30d", 30), ("30_90d", 90), ("90_180d", 180))
BANDS = ((0.90, 0.95), (0.95, 1.00), (1.00, 1.05), (1.05, 1.10))


def tenor(days: Column) -> Column:
    out = F.when(days <= 0, F.lit(None).cast("string"))
    for name, most in TENORS:
        out = out.when(days <= most, name)
    return out


def band(moneyness: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high in BANDS:
        out = out.when((moneyness >= low) & (moneyness < high), f"{low:.2f}_{high:.2f}")
    return out


def spot(ticks: DataFrame, prefix: str) -> DataFrame:
    """The newest underlying price of instruments whose id begins with ``prefix``."""
    return ticks.where(F.col("instrument_id").startswith(prefix)).agg(F.max_by("underlying_price", F.struct("ts_ms", "seq", "seq2")).alias("spot"))


def expiries(instruments: DataFrame, per_tenor: int = 3) -> DataFrame:
    """The nearest expiries of each tenor."""
    days = instruments.select("underlying", "expiry_days", tenor(F.col("expiry_days")).alias("tenor")).distinct().where("tenor is not null")
    return days.withColumn("n", F.row_number().over(Window.partitionBy("underlying", "tenor").orderBy("expiry_days"))).where(F.col("n") <= per_tenor)


def _order(score: Column) -> list[Column]:
    """By score, ties the newest first."""
    return [score, -F.col("ts_ms"), -F.col("seq"), -F.col("seq2"), F.col("mark_iv"), F.col("open_interest"), F.col("instrument_id")]


def _nearest(score: Column, when: Column):
    """Id, IV and open interest of the row of least score (ties: the newest) among those where ``when`` holds."""
    pick = F.struct(*(c.alias(name) for name, c in zip(("s", "t", "q", "q2", "iv", "oi", "id"), _order(score), strict=True)))
    return F.min(F.when(when, pick))


def _gap(target: float = 0.25) -> Column:
    return F.round(F.abs(F.abs("delta") - target), 9)


def _has_delta(side: str, gap: Column, within: float = 0.05) -> Column:
    return (F.col("delta") >= 0 if side == "C" else F.col("delta") <= 0) & (gap <= within)


def _off_money() -> Column:
    return F.round(F.coalesce(F.abs(F.abs("delta") - 0.5), F.abs(F.col("strike") / F.col("underlying_price") - 1)), 9)


def by_delta(side: str, target: float = 0.25, within: float = 0.05):
    """The option whose delta, above zero for a call (C) and below for a put (P), is nearest to ``target`` in size."""
    return _nearest(_gap(target), _has_delta(side, _gap(target), within))


def at_the_money():
    """The option whose delta is nearest to a half in size; one without a delta counts by its distance from the spot."""
    return _nearest(_off_money(), _off_money().isNotNull())


def held(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def components(ticks: DataFrame, keys: list[str], most_iv: float = 5.0, most: float = 2.0) -> DataFrame:
    """Risk reversal and butterfly per key, the 25-delta picks and the money held to sensible ranges; ``weight`` is the open interest of the picks, one
    without any; ``n`` the options seen."""
    return _components(ticks.groupBy(*keys).agg(by_delta("C").alias("c"), by_delta("P").alias("p"), at_the_money().alias("a"), F.count("*").alias("n")), keys, most_iv, most)


def _components(got: DataFrame, keys: list[str], most_iv: float = 5.0, most: float = 2.0) -> DataFrame:
    iv = {k: held(F.col(f"{k}.iv"), 0.0, most_iv) for k in "cpa"}
    oi = sum((F.greatest(F.coalesce(f"{k}.oi", F.lit(0.0)), F.lit(0.0)) for k in "pa"), F.greatest(F.coalesce("c.oi", F.lit(0.0)), F.lit(0.0)))
    return got.select(
        *keys, iv["c"].alias("iv_call"), iv["p"].alias("iv_put"), iv["a"].alias("iv_atm"), held(iv["c"] - iv["p"], -most, most).alias("rr_25d"), held(0.5 * (iv["c"] + iv["p"]) - iv["a"], -most, most).alias("bf_25d"),
        F.coalesce(F.nullif(oi, F.lit(0.0)), F.lit(1.0)).alias("weight"), "n", *(F.col(k).isNull().cast("long").alias(f"no_{name}") for k, name in (("c", "call"), ("p", "put"), ("a", "atm"))),
    )


def band_iv(ticks: DataFrame, keys: list[str], spot: Column | None = None, least_oi: float = 0.0, most_iv: float = 5.0) -> DataFrame:
    """Volatility by moneyness band, weighted by open interest; without any open interest it is zero. ``weight`` is the open interest, one without any."""
    price = F.col("underlying_price") if spot is None else spot
    rows = ticks.withColumn("band", band(F.col("strike") / F.greatest(price, F.lit(1e-9)))).where(F.col("band").isNotNull() & F.col("mark_iv").isNotNull() & (F.coalesce("open_interest", F.lit(0.0)) >= least_oi))
    oi = F.greatest(F.coalesce("open_interest", F.lit(0.0)), F.lit(0.0))
    iv = held(F.col("mark_iv"), 0.0, most_iv)
    return _band_iv(rows.groupBy(*keys, "band").agg(F.sum(iv * oi).alias("_num"), F.sum(oi).alias("_den"), F.count("*").alias("n_used")))


def _band_iv(got: DataFrame) -> DataFrame:
    return got.withColumns({"iv": F.coalesce(F.try_divide("_num", "_den"), F.lit(0.0)), "weight": F.coalesce(F.nullif("_den", F.lit(0.0)), F.lit(1.0))}).drop("_num", "_den")


#: Minutes that are dealt to a task together.
STRETCH = 60
#: Tasks up to which rows are dealt out as they come; to more, Spark sorts them first, which spills where a file is large. Ticks of a task on average, until there are MOST tasks.
TASKS, FULL, MOST = 200, 1_500_000, 10_000


def _tasks(times: DataFrame) -> int:
    """Tasks for the stretches between the first and the last ``ts_ms``; beyond TASKS, ticks and stretches that hold any count, gaps don't."""
    least = int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("ts_ms") / (60_000 * STRETCH)).alias("_s")
    first, last, held, rows = times.groupBy(stretch).count().agg(F.min("_s"), F.max("_s"), F.count("*"), F.sum("count")).first()
    return least if first is None else max(least, min(4 * (last - first + 2), TASKS), min(rows // FULL, held, MOST))


def serving(ticks: DataFrame, back_ms: int, ahead_ms: int, times: DataFrame | None = None, **ranks: list[Column]) -> DataFrame:
    """A row per tick and ``minute`` that it serves: its window [minute - back, minute + ahead] holds the tick and no newer one of the instrument.

    Ticks are dealt to the stretches of minutes (``_part``) that they serve, once each, before their minutes are made: what is grouped by ``_part`` and minute needs no
    shuffle of a row a minute. Tasks grow in number with the ticks, so a longer table doesn't make a task larger, nor does a stray time make many; ``times``, a table with
    the same ``ts_ms`` that costs less to read, tells how many. ``ranks``: columns with a tick's place in an order within its stretch.
    """
    first, last = F.greatest(F.ceil((F.col("ts_ms") - ahead_ms) / 60_000), F.lit(0)), F.floor((F.col("ts_ms") + back_ms) / 60_000)
    part = F.explode(F.sequence(F.floor(F.col("_a") / STRETCH), F.floor(F.col("_z") / STRETCH)))
    rows = ticks.withColumns({"_a": first, "_z": last}).where("_a <= _z").withColumn("_part", part)
    rows = rows.repartition(_tasks(ticks if times is None else times), "_part")
    # A tick serves from its first minute to the one before the first minute of the instrument's next tick; one that comes within the stretch is dealt to it too.
    after = F.lead("_a").over(Window.partitionBy("_part", "instrument_id").orderBy("ts_ms", "seq", "seq2"))
    rows = rows.withColumns({"_z": F.least(F.col("_z"), F.coalesce(after - 1, "_z"), F.col("_part") * STRETCH + STRETCH - 1), "_a": F.greatest("_a", F.col("_part") * STRETCH)}).where("_a <= _z")
    rows = rows.withColumns({name: F.row_number().over(Window.partitionBy("_part").orderBy(*order)) for name, order in ranks.items()})
    return rows.withColumn("minute", F.explode(F.sequence("_a", "_z"))).drop("_a", "_z")


def build(ticks: DataFrame, back_ms: int = 600_000, ahead_ms: int = 5_000, per_tenor: int = 3, quotes: bool = False, weigh: bool = True, times: DataFrame | None = None) -> DataFrame:
    """The surface of every minute at once, a row per underlying, tenor and band: ``NA`` for the 25-delta picks, and the moneyness bands.

    The nearest ``per_tenor`` expiries of a tenor count, with ``quotes`` only options with a bid and an ask. Expiries weigh by the open interest of their picks
    (of their band), or alike without ``weigh``. An expiry without a call, a put or the money gives nothing to the NA row but its missing parts. Spot is the
    newest underlying price of the minute. A row without any value is left out. ``times`` as in ``serving``.
    """
    near = expiries(ticks.select("underlying", "expiry_days").distinct(), per_tenor).select("underlying", "expiry_days", "tenor")
    rows = ticks.join(F.broadcast(near), ["underlying", "expiry_days"])  # at most per_tenor rows a tenor and underlying
    rows = serving(rows, back_ms, ahead_ms, times, _delta=_order(_gap()), _money=_order(_off_money()), _age=[F.desc(c) for c in ("ts_ms", "seq", "seq2", "underlying_price")])
    if quotes:
        rows = rows.where("coalesce(bid, 0) <> 0 and coalesce(ask, 0) <> 0")
    keys = ["_part", "minute", "underlying", "tenor", "expiry_days"]
    # A row a strike, made where the minutes are. All is picked by rank, so an aggregate holds numbers alone and neither sorts nor spills a row a minute.
    oi, used = F.greatest(F.coalesce("open_interest", F.lit(0.0)), F.lit(0.0)), F.col("mark_iv").isNotNull() & (F.coalesce("open_interest", F.lit(0.0)) >= 0)
    ranks = {"c": F.when(_has_delta("C", _gap()), F.col("_delta")), "p": F.when(_has_delta("P", _gap()), F.col("_delta")), "a": F.when(_off_money().isNotNull(), F.col("_money"))}
    pick = lambda k, rank, iv, oi: (F.min(rank).alias(k), F.min_by(iv, rank).alias(f"{k}_iv"), F.min_by(oi, rank).alias(f"{k}_oi"))
    rows = rows.groupBy(*keys, "strike").agg(
        *(c for k, rank in ranks.items() for c in pick(k, rank, "mark_iv", "open_interest")), F.count("*").alias("n"), F.min("_age").alias("_newest"), F.min_by("underlying_price", "_age").alias("_price"),
        F.sum(F.when(used, held(F.col("mark_iv"), 0.0, 5.0) * oi)).alias("_num"), F.sum(F.when(used, oi)).alias("_den"), F.count_if(used).alias("n_used"),
    )
    rows = rows.withColumn("spot", F.min(F.struct("_newest", "_price")).over(Window.partitionBy("_part", "minute", "underlying"))["_price"])
    # A strike counts for the NA row and, where it has one, for its band: both are made in the task that holds its minute.
    own = band(F.col("strike") / F.greatest("spot", F.lit(1e-9)))
    rows = rows.withColumn("band", F.explode(F.array_compact(F.array(F.lit("NA"), F.when(F.col("n_used") > 0, own)))))
    rows = rows.groupBy(*keys, "band").agg(*(c for k in "cpa" for c in pick(k, k, f"{k}_iv", f"{k}_oi")), *(F.sum(c).alias(c) for c in ("n", "_num", "_den", "n_used")))
    rows = rows.withColumns({k: F.when(F.col(k).isNotNull(), F.struct(F.col(f"{k}_iv").alias("iv"), F.col(f"{k}_oi").alias("oi"))) for k in "cpa"})
    rows = _band_iv(_components(rows, [*keys, "band", "_num", "_den", "n_used"]).withColumnRenamed("weight", "w"))
    na, missing = F.col("band") == "NA", F.col("no_call") + F.col("no_put") + F.col("no_atm")
    both = rows.withColumns({
        "iv": F.when(~na, F.col("iv")).when(missing == 0, F.col("iv_atm")), **{c: F.when(na & (missing == 0), F.col(c)) for c in ("rr_25d", "bf_25d")},
        "w": F.when(na, F.col("w")).otherwise(F.col("weight")) if weigh else F.lit(1.0), "n_used": F.when(na, F.col("n")).otherwise(F.col("n_used")), **{c: F.when(na, F.col(c)) for c in ("no_call", "no_put", "no_atm")},
    })
    given = F.coalesce("iv", "rr_25d", "bf_25d").isNotNull()
    mean = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c)
    many = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c.replace("no_", "missing_"))
    got = both.groupBy("_part", "minute", "underlying", "tenor", "band").agg(
        mean("iv"), mean("rr_25d"), mean("bf_25d"), F.count_if(given).alias("n_expiries_used"), F.coalesce(F.sum(F.when(given, F.col("n_used"))), F.lit(0)).alias("n_used"), F.sum(F.when(given, F.col("w"))).alias("sum_weights"),
        F.min(F.when(given, F.col("expiry_days"))).alias("expiry_min"), F.max(F.when(given, F.col("expiry_days"))).alias("expiry_max"), *(many(c) for c in ("no_call", "no_put", "no_atm")),
    )
    return got.where(F.coalesce("iv", "rr_25d", "bf_25d").isNotNull()).drop("_part")


def meta(weigh: bool = True) -> Column:
    """JSON that tells what a row of ``build`` rests on."""
    fields = ["minute", "tenor", "band", "n_expiries_used", "n_used", "sum_weights", "expiry_min", "expiry_max", "missing_call", "missing_put", "missing_atm"]
    return F.to_json(F.struct(*fields, F.lit("oi" if weigh else "equal").alias("weights_used")))


def by_minute(surface: DataFrame) -> DataFrame:
    """Minute means over an underlying's rows: iv_avg, rr_25d_avg, bf_25d_avg."""
    return surface.groupBy(F.col("minute").alias("bucket"), "underlying").agg(*(F.avg(c).alias(f"{c}_avg") for c in ("iv", "rr_25d", "bf_25d")))


def violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def option_parts(instrument: Column) -> Column:
    """struct(underlying, strike, option_type) of an id like ``X:BTC-28NOV25-50000-C``."""
    pattern = r"^(?:[^:]*:)*([A-Z]+)-[0-9A-Z]+-([0-9.]+)-([CP])$"
    part = lambda k: F.regexp_extract(instrument, pattern, k)
    return F.when(instrument.rlike(pattern), F.struct(part(1).alias("underlying"), part(2).cast("double").alias("strike"), part(3).alias("option_type")))
