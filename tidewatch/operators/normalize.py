"""Raw exchange messages (a JSON string column ``raw``) to time-series tables, catalogue upkeep and sink helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    """``raw`` with ``m``; what is no JSON object or list is dropped, by a look at its first character, so that no message is parsed twice."""
    return raw.where(F.col("raw").rlike(r"^\s*[\[{]")).withColumn("m", F.from_json("raw", schema, {"mode": "PERMISSIVE"}))


def envelope(raw: DataFrame, schema: str = "e string, u long") -> DataFrame:
    """``msg``: the message itself or what its envelope ``data`` holds; messages without an event type go."""
    rows = _parsed(raw, f"data struct<{','.join(f.replace(' ', ':') for f in schema.split(', '))}>, {schema}")
    fields = [f.split(" ")[0] for f in schema.split(", ")]
    return rows.withColumn("msg", F.coalesce("m.data", F.struct(*(F.col(f"m.{f}") for f in fields)))).where("msg.e is not null").drop("m")



def trades(raw: DataFrame) -> DataFrame:
    """Futures trades; a maker buyer means a seller took."""
    rows = raw.select("*", *(F.get_json_object("raw", f"$.{k}").cast(t).alias(n) for k, t, n in (("T", "long", "ts_ms"), ("t", "long", "trade_id"), ("p", "double", "price"), ("q", "double", "qty"))), F.get_json_object("raw", "$.m").cast("boolean").alias("maker"))
    return rows.where("trade_id is not null").withColumn("side", F.when(F.col("maker"), "sell").otherwise("buy")).drop("maker")


def spot_trades(raw: DataFrame) -> DataFrame:
    return trades(raw).withColumns({"buyer_order_id": F.get_json_object("raw", "$.b").cast("long"), "seller_order_id": F.get_json_object("raw", "$.a").cast("long")})


def agg_trades(raw: DataFrame) -> DataFrame:
    got = lambda k: F.get_json_object("raw", f"$.{k}")
    return trades(raw).withColumns({"is_best_match": got("M").cast("boolean"), "meta": F.to_json(F.struct(got("f").cast("long").alias("f"), got("l").cast("long").alias("l")))})


def depth_levels(raw: DataFrame) -> DataFrame:
    """A row per level of both ladders with its absolute quantity."""
    rows = _parsed(raw, "e string, u long, b array<array<string>>, a array<array<string>>")
    side = lambda field, name: rows.select("instrument_id", F.col("m.u").alias("seq"), F.lit(name).alias("side"), F.explode(f"m.{field}").alias("x"))
    return side("b", "buy").unionByName(side("a", "sell")).select("instrument_id", "seq", "side", F.col("x")[0].cast("double").alias("price"), F.col("x")[1].cast("double").alias("qty"))


def absolute_to_delta(levels: DataFrame) -> DataFrame:
    """Absolute quantities to signed changes by level: inserts and deletes with the change; unchanged rows go."""
    before = F.lag("qty").over(Window.partitionBy("instrument_id", "side", "price").orderBy("seq"))
    rows = levels.withColumn("_d", F.col("qty") - F.coalesce(before, F.lit(0.0))).where("_d <> 0")
    return rows.withColumns({"action": F.when(F.col("_d") > 0, "insert").otherwise("delete"), "qty": F.abs("_d")}).drop("_d")


def marks(raw: DataFrame) -> DataFrame:
    got = lambda k, t: F.get_json_object("raw", f"$.{k}").cast(t)
    rows = raw.select("*", got("E", "long").alias("ts_ms"), got("p", "double").alias("mark_price"), got("i", "double").alias("index_price"), got("r", "double").alias("funding_rate"), got("T", "long").alias("next_funding_ms"))
    return rows.withColumn("basis_bps", (F.col("mark_price") - F.col("index_price")) / F.nullif(F.col("index_price"), F.lit(0.0)) * 1e4)


def liquidations(raw: DataFrame) -> DataFrame:
    """Forced orders at their average price and filled quantity, where given."""
    rows = _parsed(raw, "o struct<S:string,p:string,ap:string,q:string,z:string,T:long>").select("*", F.lower("m.o.S").alias("side"), F.col("m.o.T").alias("ts_ms"))
    rows = rows.withColumns({"price": F.coalesce(F.col("m.o.ap"), F.col("m.o.p")).cast("double"), "qty": F.coalesce(F.col("m.o.z"), F.col("m.o.q")).cast("double")})
    return rows.withColumns({"quote_qty_usd": F.col("price") * F.col("qty"), "external_id": F.concat_ws("-", "instrument_id", F.col("ts_ms").cast("string"), "side")}).drop("m")


def open_interest(raw: DataFrame) -> DataFrame:
    return _parsed(raw, "openInterest string, time long").select("instrument_id", F.col("m.time").alias("ts_ms"), F.col("m.openInterest").cast("double").alias("open_interest"))


def trader_ratios(raw: DataFrame) -> DataFrame:
    return _parsed(raw, "longAccount string, shortAccount string, timestamp long").select("instrument_id", F.col("m.timestamp").alias("ts_ms"), F.col("m.longAccount").cast("double").alias("long_ratio"), F.col("m.shortAccount").cast("double").alias("short_ratio"))


def _listed(raw: DataFrame, schema: str) -> DataFrame:
    """A row per message of a list, or of a single one."""
    text = F.when(F.ltrim("raw").startswith("["), F.col("raw")).otherwise(F.concat(F.lit("["), "raw", F.lit("]")))
    return raw.select(F.explode(F.from_json(text, f"array<struct<{schema}>>")).alias("m"))


def option_trades(raw: DataFrame) -> DataFrame:
    rows = _listed(raw, "instrument_name:string,timestamp:long,trade_id:long,price:double,amount:double,direction:string,iv:double,index_price:double,mark_price:double")
    return rows.select(F.col("m.instrument_name").alias("instrument_id"), F.col("m.timestamp").alias("ts_ms"), F.col("m.trade_id").alias("trade_id"), F.col("m.price").alias("price"), F.col("m.amount").alias("qty"), F.col("m.direction").alias("side"), F.col("m.index_price").alias("underlying_price"), F.to_json(F.struct("m.iv", "m.mark_price")).alias("meta"))


def option_book(raw: DataFrame) -> DataFrame:
    """Book changes; an entry is [action, price, qty] or [price, qty], the latter a delete if its quantity is zero."""
    rows = _parsed(raw, "instrument_id string, timestamp long, change_id long, bids array<array<string>>, asks array<array<string>>")
    # Both sides in one array, so a message is parsed once.
    tagged = lambda field, name: F.transform(F.coalesce(f"m.{field}", F.array().cast("array<array<string>>")), lambda x: F.struct(F.lit(name).alias("side"), x.alias("x")))
    both = rows.select(F.col("m.instrument_id").alias("instrument_id"), F.col("m.timestamp").alias("ts_ms"), F.col("m.change_id").alias("seq"), F.explode(F.concat(tagged("bids", "buy"), tagged("asks", "sell"))).alias("_s")).select("instrument_id", "ts_ms", "seq", "_s.side", "_s.x")
    three = F.size("x") >= 3
    qty = F.when(three, F.get("x", F.lit(2))).otherwise(F.get("x", F.lit(1))).cast("double")
    word = F.when(three, F.lower(F.col("x")[0]))
    action = F.when(word.isin("new", "insert", "add"), "insert").when(word.isin("change", "update"), "update").when(word.isin("delete", "remove"), "delete").when(qty == 0, "delete").otherwise("insert")
    return both.select("instrument_id", "ts_ms", "seq", "side", action.alias("action"), F.when(three, F.get("x", F.lit(1))).otherwise(F.col("x")[0]).cast("double").alias("price"), qty.alias("qty"))


def option_ticker(raw: DataFrame) -> DataFrame:
    rows = _parsed(raw, "instrument_id string, timestamp long, mark_iv double, greeks struct<delta:double,gamma:double,vega:double,theta:double>, best_bid_price double, best_ask_price double, open_interest double, stats struct<open_interest:double>, underlying_price double, index_price double")
    return rows.select(
        "m.instrument_id", F.col("m.timestamp").alias("ts_ms"), "m.mark_iv", "m.greeks.delta", "m.greeks.gamma", "m.greeks.vega", "m.greeks.theta", F.col("m.best_bid_price").alias("bid"), F.col("m.best_ask_price").alias("ask"),
        F.coalesce("m.open_interest", "m.stats.open_interest").alias("open_interest"), F.coalesce("m.underlying_price", "m.index_price").alias("underlying_price"),
    )


def option_marks(raw: DataFrame) -> DataFrame:
    rows = _listed(raw, "instrument_name:string,timestamp:long,mark_price:double,index_price:double,iv:double")
    return rows.select(F.col("m.instrument_name").alias("instrument_id"), F.col("m.timestamp").alias("ts_ms"), "m.mark_price", F.col("m.index_price").alias("underlying_price"), F.col("m.iv").alias("iv_mark"))


def option_instruments(raw: DataFrame) -> DataFrame:
    rows = _parsed(raw, "instrument_name string, base_currency string, expiration_timestamp long, strike double, option_type string, tick_size double, contract_size double")
    kind = F.upper(F.substring("m.option_type", 1, 1))
    return rows.select(F.col("m.instrument_name").alias("instrument_id"), F.col("m.base_currency").alias("underlying"), F.to_date(F.timestamp_millis("m.expiration_timestamp")).alias("expiry"), "m.strike", kind.alias("option_type"), "m.tick_size", F.col("m.contract_size").alias("lot_size"))


def upsert_catalog(now: DataFrame, new: DataFrame) -> DataFrame:
    """New values win by instrument; metadata maps merge, new keys winning."""
    a, b = now.alias("a"), new.alias("b")
    none = F.create_map().cast("map<string,string>")
    old, fresh = F.coalesce("a.meta", none), F.coalesce("b.meta", none)
    meta = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    return a.join(b, "instrument_id", "full").select("instrument_id", F.coalesce("b.strike", "a.strike").alias("strike"), meta.alias("meta"))


def universe(instruments: DataFrame, spot: float, now_days: int, expiries: int = 3, strikes: int = 5) -> DataFrame:
    """Live instruments of the first expiries, and of each the ``strikes + 1`` nearest to the spot price."""
    live = instruments.where(F.col("expiry_days") > now_days)
    front = live.select("underlying", "expiry_days").distinct().withColumn("_e", F.row_number().over(Window.partitionBy("underlying").orderBy("expiry_days"))).where(F.col("_e") <= expiries).drop("_e")
    near = F.row_number().over(Window.partitionBy("underlying", "expiry_days").orderBy(F.abs(F.col("strike") - spot), "strike", "instrument_id"))
    return live.join(front, ["underlying", "expiry_days"]).withColumn("_n", near).where(F.col("_n") <= strikes + 1).drop("_n")


def append_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` after an append of ``rows`` that ignores keys it has: what a batch sink writes, and then holds."""
    fresh = rows.dropDuplicates(keys).join(table, keys, "left_anti")
    return table.unionByName(fresh)


def event_rows(events: DataFrame) -> DataFrame:
    """Events as rows of the events table: duration in milliseconds, fields as JSON."""
    dur = F.try_element_at("fields", F.lit("dur_s")).cast("double")
    return events.select("instrument_id", "ts_ms", F.col("kind").alias("event_type"), "side", "intensity", "price", (dur * 1000).cast("long").alias("duration_ms"), F.to_json("fields").alias("fields"))


def add_counters(table: DataFrame, more: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Additive upsert of counters."""
    return table.unionByName(more).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counters))


def drop_stale(df: DataFrame, most_ms: int) -> DataFrame:
    """Rows that waited no longer than ``most_ms`` between the event and its ingest."""
    return df.where(F.col("ingest_ms") - F.col("ts_ms") <= most_ms)

