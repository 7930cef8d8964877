"""Keyed tables in plain Parquet files, written batch by batch, by any number of writers in turn.

A table is a folder of partitions by one column (for series a time bucket, so a batch touches few of them). Writing a batch merges it
with the partitions it touches and replaces those alone. ``merge`` decides what a key's rows become.

Each partition carries a ledger: for each writer (a streaming query's id, or a name of the caller's own) the number of the last of its batches that was merged
into it. It is written with the rows, so rows and ledger can't differ. A batch that is written again (a stream restarted after a failure) changes
nothing; a writer the partition doesn't know yet, such as a second stream or the same one on a new checkpoint, is merged like any other; a
number below the writer's last is an error, since a writer whose numbers start anew would lose its rows.

A write has two steps: the merged rows are written whole into ``<path>-staged/<writer>-<batch>``, then moved in by a dynamic partition overwrite. Every write
first ends what an earlier one left: a whole staged folder is moved in (again), an unfinished one is dropped. Writers take turns; two at
once on one partition are told apart by the ledger, which is read again before the move.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import latest

LEDGER = "last_batches"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, path)
    return files.exists(at)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows."""
    return spark.read.parquet(path).drop(LEDGER)


def ledger(spark: SparkSession, path: str, partition: str) -> DataFrame:
    """(partition, last_batches) of each partition."""
    return spark.read.parquet(path).groupBy(partition).agg(F.first(LEDGER).alias(LEDGER))


@dataclass(frozen=True)
class Merge:
    """``rows(new, old)`` gives the rows that replace those of the partitions that ``new`` touches; ``keys`` tell rows apart."""

    keys: tuple[str, ...]
    rows: Callable[[DataFrame, DataFrame | None], DataFrame]


def _move_in(spark: SparkSession, staged: str, path: str, partition: str) -> None:
    rows = spark.read.parquet(staged).hint("rebalance", partition)  # else each task leaves a file in each partition
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    files, at = _at(spark, staged)
    files.delete(at, True)


def recover(spark: SparkSession, path: str, partition: str) -> None:
    """End what a write left between its steps: move whole staged folders in, drop the others."""
    files, at = _at(spark, f"{path}-staged")
    if not files.exists(at):
        return
    for folder in sorted(str(f.getPath()) for f in files.listStatus(at)):
        if exists(spark, f"{folder}/_SUCCESS"):
            _move_in(spark, folder, path, partition)
        else:
            files.delete(_at(spark, folder)[1], True)


def write(rows: DataFrame, batch: int, path: str, partition: str, merge: Merge, writer: str = "batch") -> None:
    """Merge the writer's batch into the table at ``path``. An empty batch writes nothing.

    The partition must be among the merge's keys: a key's rows then meet in one partition.
    """
    if partition not in merge.keys:
        raise ValueError(f"{partition} isn't a key: rows of a key could lie in several partitions, where they don't meet")
    recover(rows.sparkSession, path, partition)
    rows = rows.persist()  # a micro-batch is read several times: its stateful operators run once
    try:
        if not rows.isEmpty():
            _write(rows, batch, path, partition, merge, writer)
    finally:
        rows.unpersist()


def _write(rows: DataFrame, batch: int, path: str, partition: str, merge: Merge, writer: str) -> None:
    spark, names = rows.sparkSession, rows.columns
    old = None
    known = F.create_map().cast("map<string,bigint>")
    if exists(spark, path):
        touched = ledger(spark, path, partition).join(rows.select(partition).distinct(), partition, "left_semi")
        last = F.try_element_at(LEDGER, F.lit(writer))
        ahead = touched.agg(F.max(last)).first()[0]
        if ahead is not None and ahead > batch:
            raise ValueError(f"batch {batch} of writer {writer} comes after its batch {ahead}: numbers that start anew are another writer's")
        rows = rows.join(touched.where(last >= batch).select(partition), partition, "left_anti")
        old = spark.read.parquet(path).join(rows.select(partition).distinct(), partition, "left_semi")
        before = touched.select(partition, F.col(LEDGER).alias("_before"))
        merged = merge.rows(rows, old.select(names)).select(names).join(before, partition, "left")
        known = F.coalesce("_before", known)
    else:
        merged = merge.rows(rows, None).select(names)
    others = F.map_filter(known, lambda k, _: k != writer)
    staged = f"{path}-staged/{writer}-{batch}"
    merged = merged.withColumn(LEDGER, F.map_concat(others, F.create_map(F.lit(writer), F.lit(batch).cast("bigint")))).select(*names, LEDGER)
    merged.write.mode("overwrite").parquet(staged)
    if old is not None:
        now = ledger(spark, path, partition).withColumnRenamed(LEDGER, "_now")
        as_text = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
        if not before.join(now, partition).where(as_text(F.col("_before")) != as_text(F.col("_now"))).isEmpty():
            files, at = _at(spark, staged)
            files.delete(at, True)
            raise RuntimeError("another writer has changed a partition meanwhile; write the batch again")
    _move_in(spark, staged, path, partition)


def append_once(keys: list[str]) -> Merge:
    """Rows whose key isn't there yet are added; of several in a batch one."""

    def merge(new: DataFrame, old: DataFrame | None) -> DataFrame:
        new = new.dropDuplicates(keys)
        return new if old is None else old.unionByName(new.join(old.select(*keys), keys, "left_anti"))

    return Merge(tuple(keys), merge)


def upsert(keys: list[str], order: list[str]) -> Merge:
    """The newest row of each key by ``order`` stays."""
    return Merge(tuple(keys), lambda new, old: latest(new if old is None else old.unionByName(new), keys, *order))


def add(keys: list[str], counters: list[str]) -> Merge:
    """Counters of a key add up."""

    def merge(new: DataFrame, old: DataFrame | None) -> DataFrame:
        both = new if old is None else old.unionByName(new)
        return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counters))

    return Merge(tuple(keys), merge)
