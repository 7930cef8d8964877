"""Tailing a table by an ascending id, with a cursor that is stored.

A tail hands out the rows past its cursor, at most ``limit`` of them (more only where rows share the last id), in batches whose number follows from the
cursor. The cursor moves when the caller commits, after it has put the rows away. A tail that stops between the two hands the same batch out
again, and a sink that knows batches by number (see ``operators.sinks``) takes it once. The id's condition reaches the table's scan.

A backlog is worked off in stretches: many batches are put away by one write and one commit, under the number of the last of them, so its cost is that of its rows
and not of a few jobs a batch. A stretch that is handed out again may have grown; its number then has too, and a sink that appends by key takes what is new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import sinks


class Tail:
    """``table`` past the cursor stored at ``path``; one that isn't stored begins before ``start``, or at the newest row with ``latest``."""

    def __init__(self, table: Callable[[], DataFrame], id_column: str, path: str, limit: int = 2000, start: int | None = None, latest: bool = False):
        self.table, self.id, self.path, self.limit = table, id_column, path, limit
        self.spark: SparkSession = table().sparkSession
        self.end, self.span = None, 1
        if sinks.exists(self.spark, path):
            self.batch, self.cursor = self.spark.read.schema("batch long, cursor long").json(path).agg(F.max(F.struct("batch", "cursor")).alias("x")).select("x.*").first()
        else:
            self.batch, self.cursor = 0, table().agg(F.max(id_column)).first()[0] if latest else start

    def take(self, at_once: int = 1) -> DataFrame | None:
        """The next rows, or None; the same until they are committed. Up to ``at_once`` batches of a backlog come together."""
        rows = self.table()
        if self.cursor is not None:
            rows = rows.where(F.col(self.id) > self.cursor)
        ids = rows.select(self.id).where(F.col(self.id).isNotNull())
        self.end, self.span = None, 1
        if at_once > 1:
            # The first cells of ids, each as wide as a batch: so many small rows at most, whatever the table's size.
            cells = ids.groupBy(F.floor(F.col(self.id) / self.limit).alias("cell")).agg(F.count("*").alias("n"), F.max(self.id).alias("last")).orderBy("cell").limit(at_once).collect()
            seen = 0
            for cell in cells:
                seen += cell.n
                if seen > at_once * self.limit:
                    break
                if seen >= self.limit:
                    self.end, self.span = cell.last, -(-seen // self.limit)
        if self.end is None:
            self.end = ids.orderBy(self.id).limit(self.limit).agg(F.max(self.id)).first()[0]
        return None if self.end is None else rows.where(F.col(self.id) <= self.end)

    def commit(self) -> None:
        """The rows handed out last are done."""
        self.batch, self.cursor = self.batch + self.span, self.end
        self.spark.range(1).select(F.lit(self.batch).alias("batch"), F.lit(self.cursor).cast("long").alias("cursor")).coalesce(1).write.mode("append").json(self.path)


def drain(tail: Tail, put: Callable[[DataFrame, int], None], batches: int | None = None, at_once: int = 1) -> int:
    """Hand batch after batch, or up to ``at_once`` together, to ``put`` (rows, number of the last) until there is none or ``batches`` are done; how many were."""
    done = 0
    while (batches is None or done < batches) and (rows := tail.take(at_once if batches is None else min(at_once, batches - done))) is not None:
        put(rows, tail.batch + tail.span - 1)
        tail.commit()
        done += tail.span
    return done
