"""Streaming queries, run over the events to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.operators import sinks as K
from tidewatch.sources.views import DAY0_MS
from tidewatch.streaming import jobs as J
from tidewatch.streaming import ordered as O

from .alerts import KEYED, UPSERT, keyed
from .registry import query


def events(v):
    return J.source(v.spark, v.sf_dir, "events")


@query("stream_tumbling", "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(v):
    rows = J.finished(J.tumbling(events(v)), "update")
    newest = rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return newest.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("minute"), "event_type", "n")


@query("stream_dedup", "SELECT DISTINCT event_id, event_type FROM events")
def stream_dedup(v):
    twice = events(v).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return J.finished(J.deduplicated(twice.drop("copy"), ["event_id"])).select("event_id", "event_type")


# Events in four chunks by arrival; one in ten comes two chunks late.
CHUNKS = """
mx AS (SELECT max(event_id) + 1 AS n FROM ev),
ch AS (SELECT ev.*, event_id * 50 AS t, least(3, event_id * 4 // n + CASE WHEN k % 10 = 0 THEN 2 ELSE 0 END) AS chunk FROM ev, mx)"""


def arriving(v):
    size = v.ev.agg((F.max("event_id") + 1).alias("_n"))  # one row
    chunk = F.least(F.lit(3), F.floor(F.col("event_id") * 4 / F.col("_n")) + F.when(F.col("k") % 10 == 0, 2).otherwise(0)).cast("int")
    return v.ev.crossJoin(F.broadcast(size)).select("event_id", "user_id", "event_type", "value", F.timestamp_millis(F.lit(DAY0_MS) + F.col("event_id") * 50).alias("at"), chunk.alias("chunk"))


@query("stream_watermark", f"{CHUNKS}, wm AS (SELECT c.chunk, max(p.t) - 15000 AS w FROM (SELECT DISTINCT chunk FROM ch) c LEFT JOIN ch p ON p.chunk < c.chunk GROUP BY 1) SELECT event_id, user_id FROM ch JOIN wm USING (chunk) WHERE w IS NULL OR t > w")
def stream_watermark(v):
    """Late rows, 15 s behind what has been seen, are dropped."""
    make = lambda stream: stream.withWatermark("at", "15 seconds").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")
    return J.in_chunks(arriving(v), 4, make)


@query("stream_backpressure", f"""{CHUNKS}, n AS (SELECT chunk, count(*) AS rows_in, max(t) AS top FROM ch GROUP BY 1), wm AS (SELECT c.chunk, max(p.top) - 15000 AS w FROM n c LEFT JOIN n p ON p.chunk < c.chunk - 1 GROUP BY 1),
l AS (SELECT chunk, count(*) FILTER (WHERE w IS NOT NULL AND t <= w) AS late FROM ch JOIN wm USING (chunk) GROUP BY 1)
SELECT chunk::BIGINT AS batch, rows_in, late, (SELECT count(*) FROM ch) - sum(rows_in) OVER (ORDER BY chunk)::BIGINT AS waiting FROM n JOIN l USING (chunk)""")
def stream_backpressure(v):
    """A backlog of four files, one a micro-batch: nothing is dropped for being too much, and what comes too late is counted.

    A batch's rows are held against the watermark of the batch before it, which the batches before that one made; between files of a backlog no batch without
    data moves it on.
    """
    make = lambda stream: stream.withWatermark("at", "15 seconds").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")
    return J.worked_off(arriving(v), 4, make)


# Trades in three chunks by arrival: each comes up to 9.5 s after its time, so rows near the chunks' borders come a chunk late and out of order. What lies
# within the delay of 15 s behind the last row still waits at the end.
SHUFFLED = "mx AS (SELECT max(event_id) * 50 - 15000 AS w FROM events), t AS (SELECT user_id, event_id AS seq, event_id * 50 AS ts_ms, CASE WHEN event_type IN ('click', 'view') THEN 'buy' ELSE 'sell' END AS side, ceil(value / 50) AS qty FROM events, mx WHERE event_id * 50 <= w)"


def shuffled(v):
    size = v.ev.agg((F.max("event_id") + 1).alias("_n"))  # one row
    e, t = F.col("event_id"), F.lit(DAY0_MS) + F.col("event_id") * 50
    chunk = F.least(F.lit(2), F.floor((e + F.col("k") % 20 * 10) * 3 / F.col("_n"))).cast("int")
    side = F.when(F.col("event_type").isin("click", "view"), "buy").otherwise("sell")
    return v.ev.crossJoin(F.broadcast(size)).select("user_id", t.alias("ts_ms"), F.timestamp_millis(t).alias("at"), e.alias("seq"), side.alias("side"), F.ceil(F.col("value") / 50).cast("double").alias("qty"), chunk.alias("chunk"))


SESSION = f"""{SHUFFLED},
b AS (SELECT *, coalesce(side <> lag(side) OVER w OR ts_ms - lag(ts_ms) OVER w > 20000, true) AS brk FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, seq)),
r AS (SELECT *, sum(brk::INT) OVER (PARTITION BY user_id ORDER BY ts_ms, seq) AS run FROM b),
c AS (SELECT *, count(*) OVER w AS k, sum(qty) OVER w AS volume FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY ts_ms, seq))"""


@query("stream_session", f"{SESSION} SELECT user_id, seq, side, k, volume FROM c WHERE k >= 2 AND volume >= 2")
def stream_session(v):
    return J.in_chunks(shuffled(v), 3, lambda stream: O.sessions(stream, 20_000, 2, 2.0, "15 seconds"))


@query("stream_stateful_detect", f"{SESSION} SELECT user_id, seq, CASE WHEN volume >= 10 THEN 'HIGH' WHEN volume >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM c WHERE k >= 3 AND volume >= 3")
def stream_stateful_detect(v):
    """The run detector on a stream, rated by the fixed rules table in a stream-static join."""
    from tidewatch.operators.rules import rated

    made = lambda stream: rated(O.sessions(stream, 20_000, 3, 3.0, "15 seconds").withColumns({"kind": F.lit("slicing_aggr"), "intensity": F.col("volume")})).select("user_id", "seq", "severity")
    return J.in_chunks(shuffled(v), 3, made)


@query("stream_sliding", f"{SHUFFLED} SELECT user_id, seq, sum(qty) OVER (PARTITION BY user_id ORDER BY ts_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS volume FROM t")
def stream_sliding(v):
    return J.in_chunks(shuffled(v), 3, lambda stream: O.sliding(stream, 60_000, "15 seconds"))


ALERTS = KEYED.replace("al AS", "all_al AS") + ", wl AS (SELECT max(ts_ms) - 15000 AS w FROM all_al), al AS (SELECT all_al.* FROM all_al, wl WHERE ts_ms <= w)"


@query("stream_alert_suppress", UPSERT.replace(KEYED, ALERTS) + " SELECT dedup_key, first AS ts_first, max(t) AS ts_last, count(*) AS n_hits FROM rf GROUP BY ALL")
def stream_alert_suppress(v):
    """Alerts that come in three chunks, up to 9.5 s after their time: the open alert of a key lives on in state, and each batch is merged into a table by key, twice."""
    alerts = keyed(v).select("dedup_key", "ts_ms", "seq")
    size = alerts.agg((F.max("ts_ms") + 10_000).alias("_n"))  # one row
    t = F.lit(DAY0_MS) + F.col("ts_ms")
    chunk = F.floor((F.col("ts_ms") + F.col("seq") % 20 * 500) * 3 / F.col("_n")).cast("int")
    rows = alerts.crossJoin(F.broadcast(size)).select("dedup_key", t.alias("ts_ms"), F.timestamp_millis(t).alias("at"), "seq", chunk.alias("chunk"))
    path, merge = f"{J.shared_dir(v.spark)}/alerts-{uuid.uuid4().hex}", K.upsert(["dedup_key", "ts_first", "minute"], ["n_hits"])

    def sink(part, batch):
        part = part.withColumn("minute", F.floor(F.col("ts_first") / 60_000))
        for _ in range(2):  # as after a failure between the write and the stream's own commit
            K.write(part, batch, path, "minute", merge, J.query_of(part))

    J.in_chunks(rows, 3, lambda stream: O.suppressed(stream, 90_000, "15 seconds"), sink=sink)
    return K.read(v.spark, path).select("dedup_key", (F.col("ts_first") - DAY0_MS).alias("ts_first"), (F.col("ts_last") - DAY0_MS).alias("ts_last"), "n_hits")


IN_ORDER = """
mx AS (SELECT max(event_id) + 1 AS n FROM ev), s AS (SELECT user_id, event_id * 50 AS t, ceil(value / 50) AS qty FROM ev), wm AS (SELECT max(t) - 1000 AS w FROM s),
nx AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM s),
pl AS (SELECT user_id, qty, t, nxt, unnest(range(CASE WHEN t % 3000 = 0 THEN t ELSE (t // 3000 + 1) * 3000 END, coalesce(nxt, t + 600001), 3000)) AS poll_ms FROM nx)"""


@query("stream_timer_poll", f"{IN_ORDER} SELECT user_id, poll_ms, qty FROM pl, wm WHERE poll_ms <= t + 600000 AND (nxt IS NOT NULL OR poll_ms < w)")
def stream_timer_poll(v):
    """Polls each 3 s; those after a user's last row come by timers, up to the watermark. Stretches of polls are stored, and taken apart as they are read."""
    size = v.ev.agg((F.max("event_id") + 1).alias("_n"))
    t = F.lit(DAY0_MS) + F.col("event_id") * 50
    rows = v.ev.crossJoin(F.broadcast(size)).select("user_id", t.alias("ts_ms"), F.timestamp_millis(t).alias("at"), F.ceil(F.col("value") / 50).cast("double").alias("qty"), F.floor(F.col("event_id") * 3 / F.col("_n")).cast("int").alias("chunk"))
    found = J.in_chunks(rows, 3, lambda stream: J.stretches(stream, 3_000))
    return J.taken_apart(found, 3_000).withColumn("poll_ms", F.col("poll_ms") - DAY0_MS)


RULES = [[("click", 40.0), ("error", 10.0)], [("click", 20.0), ("error", 30.0)], [("view", 25.0)], [("view", 25.0), ("click", 60.0)]]


@query("stream_rules_update", f"{CHUNKS}, ru(chunk, event_type, threshold) AS (VALUES {', '.join(f'({i}, {chr(39)}{t}{chr(39)}, {x})' for i, rules in enumerate(RULES) for t, x in rules)}) SELECT event_id, event_type FROM ch JOIN ru USING (chunk, event_type) WHERE value >= threshold")
def stream_rules_update(v):
    """The rules change ahead of each chunk."""
    path, schema = f"{J.shared_dir(v.spark)}/rules-{uuid.uuid4().hex}", "event_type string, threshold double"
    change = lambda chunk: v.spark.createDataFrame(RULES[chunk], schema).write.mode("overwrite").parquet(path)
    return J.in_chunks(arriving(v), 4, lambda stream: J.over_threshold(stream, path, schema).select("event_id", "event_type"), change)
