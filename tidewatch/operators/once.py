"""Results that are written once and read by all that need them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a plan must not hold to be evaluated more than once: all but scans, projections, filters and unions.
COSTLY = re.compile(r"\b(Aggregate|Join|Window|Generate|Sort|Distinct|Deduplicate|RepartitionByExpression|MapInArrow|MapInPandas|FlatMapGroupsInPandas|FlatMapGroupsInArrow|Expand|Intersect|Except)\b")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only where none is named and driver and executors are one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def once(df: DataFrame) -> DataFrame:
    """``df``, to be read several times: as it is where that means no more than to scan and project again, else written to the shared folder and read back.

    Blocks that read their input twice call it, so stacked blocks cost the sum of their levels, not two to the power of their number. It also cuts
    lineage: a lost executor costs a scan of the table, not the work before it.
    """
    if df.isStreaming or not COSTLY.search(df._jdf.queryExecution().analyzed().toString()):
        return df
    path = f"{shared_dir(df.sparkSession)}/once-{uuid.uuid4().hex}"
    typed = [c for c, kind in df.dtypes if kind != "void"]  # a column without a type can't be stored and holds nothing
    kept = df.select(typed)
    kept.write.option("compression", "lz4").parquet(path)
    back = df.sparkSession.read.schema(kept.schema).parquet(path)
    return back if len(typed) == len(df.columns) else back.select(*(c if c in typed else F.lit(None).alias(c) for c in df.columns))
