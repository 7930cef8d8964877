"""The fit of the toxicity model: repeated ids, one class, no labels."""

from tidewatch.llm import toxicity

SCHEMA = "doc_id long, text string"


def test_repeated_ids_give_one_fit(spark):
    docs = [(i, f"plain words number {i} and some more of them" if i % 2 else f"awful scum number {i} you vile scum") for i in range(60)]
    more = [(i, f"another text under the id {i}") for i in range(0, 60, 5)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, toxic int")
    odds = []
    for rows in (docs + more, more + docs[::-1]):
        frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
        fitted = toxicity.fit(frame, labels)
        odds.append({(r.doc_id, r.score) for r in toxicity.score(spark.createDataFrame(docs, SCHEMA), fitted).collect()})
    assert odds[0] == odds[1]


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(i, f"some words here {i}") for i in range(20)] + [(None, None), (30, "")], SCHEMA)
    for labels in ([(i, 0) for i in range(20)], [(i, 1) for i in range(20)], []):
        fitted = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        rows = toxicity.score(docs, fitted).collect()
        assert len(rows) == 22
        assert all(0.0 <= r.score <= 1.0 for r in rows)
