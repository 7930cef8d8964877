"""Exchange-feed tables derived from the general test tables, in Spark and as SQL for the cross-check.

A synthetic clock spaces events evenly at every scale factor; ``ts_ms`` is strictly increasing.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Epoch milliseconds of 2024-01-01, the day that options' expiries count from.
DAY0_MS = 1_704_067_200_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if its files are too few to keep them busy; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Views:
    """The feed tables over one set of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.table("events").select(
            "event_id", "user_id", "event_type", "value", k.alias("k"),
            (F.col("event_id") * 50 + k % 20).alias("ts_ms"),
            F.concat(F.lit("SIM:PERP:"), (F.col("user_id") % 4).cast("string")).alias("instrument_id"),
        )

    @cached_property
    def trades(self) -> DataFrame:
        e = F.col("event_id")
        return self.ev.where(F.col("event_type").isin("click", "view", "purchase")).select(
            "instrument_id", "ts_ms", e.alias("seq"),
            F.when(F.floor(e / 128) % 2 == 0, "buy").otherwise("sell").alias("side"),
            (F.lit(100.0) + F.lit(0.1) * (F.floor(e / 64) % 5)).alias("price"),
            F.ceil(F.col("value") / 50).cast("double").alias("qty"),
        )

    @cached_property
    def depth(self) -> DataFrame:
        buy = F.col("event_id") % 2 == 0  # not of the user, which also gives the instrument
        return self.ev.select(
            "instrument_id", "ts_ms", F.col("event_id").alias("seq"),
            F.when(buy, "buy").otherwise("sell").alias("side"),
            F.when(F.col("event_type").isin("error", "signup"), "delete").otherwise("insert").alias("action"),
            F.when(buy, F.lit(100.0) - F.lit(0.1) * (F.col("k") % 10)).otherwise(F.lit(100.1) + F.lit(0.1) * (F.col("k") % 10)).alias("price"),
            F.ceil(F.col("value") / 10).cast("double").alias("qty"),
        )

    @cached_property
    def depth_abs(self) -> DataFrame:
        """Depth rows with absolute quantities, zero for a delete."""
        return self.depth.withColumn("qty", F.when(F.col("action") == "delete", F.lit(0.0)).otherwise(F.col("qty"))).drop("action")

    @cached_property
    def book_feed(self) -> DataFrame:
        """Messages of a book by absolute quantities: each 50th of an instrument is a snapshot, the others set a level; some don't follow the one before."""
        e, k = F.col("event_id"), F.col("k")
        snapshot = F.floor(e / 4) % 50 == 0
        level = lambda side, price, qty: F.struct(F.lit(side).alias("side") if isinstance(side, str) else side.alias("side"), price.alias("price"), qty.alias("qty"))
        whole = F.array(*(level("buy", F.lit(100.0) - 0.1 * j, F.lit(5.0 + j)) for j in range(3)), *(level("sell", F.lit(100.1) + 0.1 * j, F.lit(6.0 + j)) for j in range(3)))
        buy = F.floor(e / 4) % 2 == 0
        one = level(F.when(buy, "buy").otherwise("sell"), F.when(buy, F.lit(100.0) - 0.1 * (k % 10)).otherwise(F.lit(100.1) + 0.1 * (k % 10)), F.when(F.col("event_type").isin("error", "signup"), F.lit(0.0)).otherwise(F.ceil(F.col("value") / 10).cast("double")))
        return self.ev.select(
            F.concat(F.lit("SIM:PERP:"), (e % 4).cast("string")).alias("instrument_id"), "ts_ms", e.alias("seq"), F.when(snapshot, "snapshot").otherwise("diff").alias("kind"),
            (e * 10 - 39).alias("first_u"), (e * 10).alias("u"), (e * 10 - 40 + F.when(k == 17, 5).otherwise(0)).alias("pu"), F.when(snapshot, whole).otherwise(F.array(one)).alias("levels"),
        )

    @cached_property
    def depth_seq(self) -> DataFrame:
        """Update ids with gaps, stale and huge jumps."""
        shift = F.when(F.col("k") == 7, 50).when(F.col("k") == 13, -50).when(F.col("k") == 17, 600_000).otherwise(0)
        u = F.col("event_id") * 10
        return self.ev.select("instrument_id", "ts_ms", F.col("event_id").alias("seq"), (u - 10 + shift + 1).alias("first_u"), u.alias("u"), (u - 10 + shift).alias("pu"))

    @cached_property
    def mark_funding(self) -> DataFrame:
        return self.ev.where("event_type = 'view'").select(
            "instrument_id", "ts_ms", F.col("event_id").alias("seq"), (F.lit(100.0) + F.col("value") / 100).alias("mark_price"), (F.lit(100.0) + F.col("k") / 100.0).alias("index_price"), ((F.col("k") - 50) / 1e6).alias("funding_rate")
        )

    @cached_property
    def liquidations(self) -> DataFrame:
        return self.ev.where("event_type = 'error'").select(
            "instrument_id", "ts_ms", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(100.0).alias("price"), F.col("value").alias("qty"),
            F.when(F.col("k") % 10 != 0, F.col("value") * 100).alias("quote_qty_usd"),
        )

    @cached_property
    def open_interest(self) -> DataFrame:
        return self.ev.where("event_type = 'signup'").select("instrument_id", "ts_ms", F.col("event_id").alias("seq"), (F.lit(1000.0) + F.col("value")).alias("open_interest"))

    def _ratio(self, kind: str) -> DataFrame:
        return self.ev.where(F.col("event_type") == kind).select("instrument_id", "ts_ms", F.col("event_id").alias("seq"), (F.col("k") / 100.0).alias("long_ratio"), (1 - F.col("k") / 100.0).alias("short_ratio"))

    @cached_property
    def account_ratio(self) -> DataFrame:
        return self._ratio("click")

    @cached_property
    def position_ratio(self) -> DataFrame:
        return self._ratio("purchase")

    @cached_property
    def options_instruments(self) -> DataFrame:
        return self.table("part").select(
            F.concat(F.lit("OPT:"), F.col("p_partkey").cast("string")).alias("instrument_id"), F.lit("BTC").alias("underlying"), (3 + 25 * (F.floor(F.col("p_partkey") / 2) % 6)).cast("int").alias("expiry_days"),  # calls and puts at every expiry
            (80 + F.col("p_size")).cast("double").alias("strike"), F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("P").alias("option_type"),
        )

    def _tick_ms(self) -> Column:
        return (F.col("l_orderkey") * 4 + F.col("l_linenumber")) * 50

    @cached_property
    def option_times(self) -> DataFrame:
        """The times of ``options_ticker``, read without dealing its rows out."""
        return self.table("lineitem").select(self._tick_ms().alias("ts_ms"))

    @cached_property
    def options_ticker(self) -> DataFrame:
        q = F.col("l_quantity").cast("double")
        iv = F.lit(0.3) + 4 * F.col("l_discount").cast("double")
        return spread(self.table("lineitem").select(
            F.concat(F.lit("OPT:"), F.col("l_partkey").cast("string")).alias("instrument_id"), self._tick_ms().alias("ts_ms"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_suppkey").alias("seq2"), iv.alias("mark_iv"), F.when(F.col("l_partkey") % 2 == 0, q / 51).otherwise(-q / 51).alias("delta"),
            F.col("l_tax").cast("double").alias("gamma"), q.alias("open_interest"), (iv - 0.01).alias("bid"), (iv + 0.01).alias("ask"), F.lit(105.0).alias("underlying_price"),
        ))


#: The same tables for the cross-check engine.
SQL_VIEWS = """
ev AS (SELECT event_id, user_id, event_type, value, json_extract(props, '$.k')::INTEGER AS k, event_id * 50 + json_extract(props, '$.k')::INTEGER % 20 AS ts_ms, 'SIM:PERP:' || (user_id % 4)::VARCHAR AS instrument_id FROM events),
trades AS (SELECT instrument_id, ts_ms, event_id AS seq, CASE WHEN (event_id // 128) % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, 100::DOUBLE + 0.1::DOUBLE * ((event_id // 64) % 5) AS price, ceil(value / 50) AS qty
           FROM ev WHERE event_type IN ('click', 'view', 'purchase')),
depth AS (SELECT instrument_id, ts_ms, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN event_type IN ('error', 'signup') THEN 'delete' ELSE 'insert' END AS action,
          CASE WHEN event_id % 2 = 0 THEN 100::DOUBLE - 0.1::DOUBLE * (k % 10) ELSE 100.1::DOUBLE + 0.1::DOUBLE * (k % 10) END AS price, ceil(value / 10) AS qty FROM ev),
depth_abs AS (SELECT instrument_id, ts_ms, seq, side, price, CASE WHEN action = 'delete' THEN 0::DOUBLE ELSE qty END AS qty FROM depth),
book_feed AS (SELECT 'SIM:PERP:' || (event_id % 4)::VARCHAR AS instrument_id, ts_ms, event_id AS seq, CASE WHEN event_id // 4 % 50 = 0 THEN 'snapshot' ELSE 'diff' END AS kind, event_id * 10 - 39 AS first_u, event_id * 10 AS u, event_id * 10 - 40 + CASE WHEN k = 17 THEN 5 ELSE 0 END AS pu,
              CASE WHEN event_id // 4 % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN event_id // 4 % 2 = 0 THEN 100::DOUBLE - 0.1::DOUBLE * (k % 10) ELSE 100.1::DOUBLE + 0.1::DOUBLE * (k % 10) END AS price, CASE WHEN event_type IN ('error', 'signup') THEN 0::DOUBLE ELSE ceil(value / 10) END AS qty FROM ev),
depth_seq AS (SELECT instrument_id, ts_ms, event_id AS seq, event_id * 10 - 10 + s + 1 AS first_u, event_id * 10 AS u, event_id * 10 - 10 + s AS pu FROM (SELECT *, CASE k WHEN 7 THEN 50 WHEN 13 THEN -50 WHEN 17 THEN 600000 ELSE 0 END AS s FROM ev)),
mark_funding AS (SELECT instrument_id, ts_ms, event_id AS seq, 100::DOUBLE + value / 100 AS mark_price, 100::DOUBLE + k / 100::DOUBLE AS index_price, (k - 50) / 1e6 AS funding_rate FROM ev WHERE event_type = 'view'),
liquidations AS (SELECT instrument_id, ts_ms, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, 100::DOUBLE AS price, value AS qty, CASE WHEN k % 10 <> 0 THEN value * 100 END AS quote_qty_usd FROM ev WHERE event_type = 'error'),
open_interest AS (SELECT instrument_id, ts_ms, event_id AS seq, 1000::DOUBLE + value AS open_interest FROM ev WHERE event_type = 'signup'),
account_ratio AS (SELECT instrument_id, ts_ms, event_id AS seq, k / 100::DOUBLE AS long_ratio, 1 - k / 100::DOUBLE AS short_ratio FROM ev WHERE event_type = 'click'),
position_ratio AS (SELECT instrument_id, ts_ms, event_id AS seq, k / 100::DOUBLE AS long_ratio, 1 - k / 100::DOUBLE AS short_ratio FROM ev WHERE event_type = 'purchase'),
options_instruments AS (SELECT 'OPT:' || p_partkey::VARCHAR AS instrument_id, 'BTC' AS underlying, (3 + 25 * (p_partkey // 2 % 6))::INTEGER AS expiry_days, (80 + p_size)::DOUBLE AS strike, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END AS option_type FROM part),
options_ticker AS (SELECT 'OPT:' || l_partkey::VARCHAR AS instrument_id, (l_orderkey * 4 + l_linenumber) * 50 AS ts_ms, l_orderkey * 8 + l_linenumber AS seq, l_suppkey AS seq2, 0.3::DOUBLE + 4 * l_discount::DOUBLE AS mark_iv,
          CASE WHEN l_partkey % 2 = 0 THEN l_quantity::DOUBLE / 51 ELSE -l_quantity::DOUBLE / 51 END AS delta, l_tax::DOUBLE AS gamma, l_quantity::DOUBLE AS open_interest, 0.3::DOUBLE + 4 * l_discount::DOUBLE - 0.01::DOUBLE AS bid,
          0.3::DOUBLE + 4 * l_discount::DOUBLE + 0.01::DOUBLE AS ask, 105::DOUBLE AS underlying_price FROM lineitem)
"""
