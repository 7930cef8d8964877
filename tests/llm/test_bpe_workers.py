"""Encoding and decoding in one Python worker a task, in bounded slices."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import bpe, queries
from tidewatch.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts = [None, "", " \n", "Hello, WORLD it's 12 cafés", "naïve 中文 <unk> x" * 50, "a" * 3000]
    rows = [(i, "s", texts[i % len(texts)], 7) for i in range(3 * bpe.SLICE + 5)]
    path = str(tmp_path_factory.mktemp("bpe"))
    spark.createDataFrame(rows, "doc_id long, source string, text string, _found int").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def python_nodes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_one_python_node(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert python_nodes(corpus_pipeline.tokenize(spark, docs, folder)) == 1
    assert python_nodes(queries.op9_bpe(spark, folder)) == 1


def test_round_trip_is_encode_then_decode(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("ids", F.lit("old"))
    wanted = bpe.decode(bpe.encode(docs, PATH), PATH)
    found = bpe.round_trip(docs, PATH)
    assert found.columns == wanted.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_slices():
    assert [len(x) for x in bpe.slices(pa.array(["a"] * (2 * bpe.SLICE + 1)))] == [bpe.SLICE, bpe.SLICE, 1]
