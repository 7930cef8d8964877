"""Structured Streaming forms of the surveillance operators, and a driver that runs one over files to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators.once import shared_dir


def source(spark: SparkSession, sf_dir: str, table: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream, a bounded number a trigger: back-pressure without loss."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet" if folder else f"{table}.parquet").parquet(path if folder else sf_dir)
    return files.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over all there is, writing each micro-batch once by its number; the rows of all batches with ``batch``."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/rows/batch={batch}/part")

    query = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, batch: put(rows.drop("batch"), batch)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(f"{stream.drop('batch').schema.simpleString()[7:-1].replace(':', ' ')}, batch int").parquet(f"{base}/rows")


def query_of(rows: DataFrame) -> str:
    """The id of the streaming query that a micro-batch belongs to: the same from restart to restart on one checkpoint."""
    return rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def in_chunks(rows: DataFrame, chunks: int, make: Callable[[DataFrame], DataFrame], before: Callable[[int], None] = lambda chunk: None, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Rows (with a column ``chunk``) as they arrive: a chunk lands in the source's folder, then the query runs on from its checkpoint over what is new.

    So each chunk is a micro-batch, whatever the number of its files, and state, watermark and timers live on from run to run. ``before`` runs
    ahead of each chunk. Returns the output of all batches; with a ``sink``, that gets the batches, and nothing is returned.
    """
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    schema = rows.drop("chunk").schema
    for chunk in range(chunks):
        before(chunk)
        rows.where(F.col("chunk") == chunk).drop("chunk").write.parquet(f"{base}/in/{chunk}")
        stream = make(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/in"))
        put = lambda out, batch: out.write.mode("overwrite").parquet(f"{base}/out/batch={batch}/part")
        stream.writeStream.foreachBatch(sink or put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return None if sink else spark.read.option("recursiveFileLookup", "true").schema(stream.schema).parquet(f"{base}/out")


def worked_off(rows: DataFrame, chunks: int, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What becomes of a backlog: ``rows`` (with a column ``chunk``) lie there in a file a chunk before the stream starts, which takes in one file a micro-batch and
    loses none. A row per micro-batch with input: batch, rows_in, late (rows that came behind the watermark) and waiting (rows not yet taken in).

    The counts are those that the query reports of itself.
    """
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/backlog-{uuid.uuid4().hex}"
    for chunk in range(chunks):
        rows.where(F.col("chunk") == chunk).drop("chunk").coalesce(1).write.mode("append").parquet(f"{base}/in")
    total = rows.count()
    stream = make(spark.readStream.schema(rows.drop("chunk").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))
    put = lambda out, batch: out.write.mode("overwrite").parquet(f"{base}/out/batch={batch}/part")
    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    told, before = [], 0
    for p in query.recentProgress:
        if p.numInputRows:
            before += p.numInputRows
            told.append((p.batchId, p.numInputRows, sum(op.numRowsDroppedByWatermark for op in p.stateOperators), total - before))
    return spark.createDataFrame(told, "batch long, rows_in long, late long, waiting long")


def tumbling(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events per minute and type; update mode, so a minute may come again with its new count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stretches(samples: DataFrame, every_ms: int, late: str = "1 second", idle_ms: int = 600_000) -> DataFrame:
    """The last ``qty`` of each user at multiples of ``every_ms`` in event time (``at``, as ``ts_ms``), whether rows come or not: a row for each stretch of polls
    of one value, with its first and its final poll. ``taken_apart`` makes polls of them.

    State is the last sample and the next poll. Rows bring the polls before them; a timer at the next poll brings those that the watermark has passed
    while no row came. A row that comes late, older than the last sample, brings no poll back and doesn't replace the newer value. A user without rows for ``idle_ms`` is forgotten, and polled anew when rows come again.

    A row brings one stretch at most, and so does a timer, at most one a user in a micro-batch; a stretch may hold ``idle_ms / every_ms + 1`` polls. So Python's share, and what a
    sink stores of stretches, grow with the rows, not with the polls.
    """

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        value, due, last = state.get if state.exists else (None, None, None)
        out = []

        def until(t: int) -> None:
            nonlocal due
            if due is not None and due <= (end := min(t, last + idle_ms)):
                final = due + (end - due) // every_ms * every_ms
                out.append((key[0], due, final, value))
                due = final + every_ms

        if state.hasTimedOut:
            until(state.getCurrentWatermarkMs() - 1)
        else:
            for ts, qty in sorted(row for frame in frames for row in zip(frame["ts_ms"].tolist(), frame["qty"].tolist(), strict=True)):
                until(ts - 1)
                if last is not None and ts < last:
                    continue
                value, last = qty, ts
                if due is None or due < ts:
                    due = -(-ts // every_ms) * every_ms
        if due > last + idle_ms:
            state.remove()
        else:
            state.update((value, due, last))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=kind) for i, (c, kind) in enumerate((("user_id", "int64"), ("_first", "int64"), ("_final", "int64"), ("qty", "float64")))})

    return samples.withWatermark("at", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, _first long, _final long, qty double", "value double, due long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def taken_apart(found: DataFrame, every_ms: int) -> DataFrame:
    """A row for each poll of ``stretches``, in Spark: the fold's share in Python grows with the rows."""
    return found.select("user_id", F.explode(F.sequence("_first", "_final", F.lit(every_ms).cast("long"))).alias("poll_ms"), "qty")


def polled(samples: DataFrame, every_ms: int, late: str = "1 second", idle_ms: int = 600_000) -> DataFrame:
    """The polls themselves as a stream. A sink that keeps them should keep ``stretches`` and take them apart as they are read."""
    return taken_apart(stretches(samples, every_ms, late, idle_ms), every_ms)


def over_threshold(events: DataFrame, path: str, schema: str) -> DataFrame:
    """Events at or over the threshold of their type. The rules are a table of files, read anew by every micro-batch, so changed rules reach a running
    stream."""
    return events.join(events.sparkSession.read.schema(schema).parquet(path), "event_type").where("value >= threshold")


def into(stream: DataFrame, name: str, partition: str, merge) -> DataFrame:
    """Run the stream over all there is into a keyed table of files (see ``operators.sinks``), a merge a micro-batch; the table's rows."""
    from tidewatch.operators import sinks

    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:
        sinks.write(rows, batch, f"{base}/table", partition, merge, query_of(rows))

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return sinks.read(spark, f"{base}/table")
