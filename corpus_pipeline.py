"""From documents to tokenized training text, in stages that each write their result.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of documents.

In every stage a null text counts as empty, a very long text is worked on whole, repeated rows are rows of their own (the near-dedup keeps one of
them), an empty table gives an empty one, and further columns pass through, whatever their names, up to the last stage, which
returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, mixing, near_copies, quality_classifier, quality_rules
from tidewatch.llm.common import stored, table
from tidewatch.llm.queries import tokenizer


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; sites are sources, paths their languages, nulls a group of their own."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"), docs["source"], docs["lang"])


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; empty ones have too few words."""
    return quality_rules.quality_filter(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more), the one of the least doc_id."""
    return near_copies.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each pass over it; documents without words are never taken."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and the text decoded from the ids; an empty text has none."""
    path = tokenizer("word_bpe_49k.json")
    found = bpe.round_trip(docs.select("doc_id", "source", "text"), path)
    return found.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: The classifier's fit and the shingle hashes have no SQL twin; tests/llm runs each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
