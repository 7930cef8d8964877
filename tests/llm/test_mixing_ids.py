"""The mix takes its pieces from the right rows even where a later scan splits the table otherwise."""

import pytest

from tidewatch.llm import mixing


@pytest.fixture
def other_splits(spark, monkeypatch):
    """Once the sizes are written, files are split and packed in another way, as with other executors."""
    settings = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1"}
    before, write = {k: spark.conf.get(k) for k in settings}, mixing.stored

    def stored(df, name, **options):
        found = write(df, name, **options)
        if name == "sizes":
            for k, v in settings.items():
                spark.conf.set(k, v)
        return found

    monkeypatch.setattr(mixing, "stored", stored)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_pieces_meet_their_documents(spark, other_splits):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(i % 37)), f"s{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    got = {}
    for r in mixing.mixed_documents(docs, block=4).collect():
        words = r.text.split()
        assert all(w.startswith(f"d{r.doc_id}w") for w in words)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words)
    taken = {r.doc_id: r.taken for r in mixing.report(docs, block=4).collect()}
    assert got == {i: n for i, n in taken.items() if n}
