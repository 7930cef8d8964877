"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the code points 09 to 0D.
WHITE = " \t\n\x0b\f\r"
WHITE_RUN = "[ \\t-\\r]+"


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for a text without words."""
    spaced = text
    for character in WHITE[1:]:
        spaced = F.replace(spaced, F.lit(character), F.lit(" "))
    return let(F.split(spaced, " "), lambda w: F.when(F.array_contains(w, ""), F.filter(w, lambda x: x != "")).otherwise(w))


def count_of(text: Column, characters: str) -> Column:
    """How often the listed ASCII characters occur: each is one byte, so byte lengths tell."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters[1:]), F.octet_length(text) - F.octet_length(F.replace(text, F.lit(characters[0]), F.lit(""))))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet: ``name``, with underscores before it as needed."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only where none is named and driver and executors are one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
