"""A tail goes on from its stored cursor, hands a batch out again until it is committed, and starts at the newest row if asked to."""

from tidewatch.streaming.tail import Tail, drain


def test_each_row_once_over_stops_and_restarts(spark, tmp_path):
    rows = [(i, i % 3) for i in range(1, 40) if i % 7]
    table = lambda: spark.createDataFrame(rows, "id long, x int").repartition(3)
    path, seen = str(tmp_path / "cursor"), []
    put = lambda part, batch: seen.append((batch, sorted(r.id for r in part.collect())))
    assert drain(Tail(table, "id", path, 10, start=4), put, 2) == 2
    again = Tail(table, "id", path, 10, start=4)
    first = sorted(r.id for r in again.take().collect())
    assert first == sorted(r.id for r in Tail(table, "id", path, 10).take().collect())  # not committed
    assert drain(Tail(table, "id", path, 10), put) == 1
    assert [b for b, _ in seen] == [0, 1, 2]
    assert [i for _, part in seen for i in part] == [i for i, _ in rows if i > 4]
    rows += [(50, 0), (50, 1), (51, 1)]
    assert drain(Tail(table, "id", path, 1), put) == 2
    assert seen[-2:] == [(3, [50, 50]), (4, [51])]
    assert Tail(table, "id", path, 10).take() is None


def test_latest_begins_after_what_is_there(spark, tmp_path):
    rows = [(1,), (2,)]
    tail = Tail(lambda: spark.createDataFrame(rows, "id long"), "id", str(tmp_path / "cursor"), 10, latest=True)
    assert tail.take() is None
    rows.append((3,))
    assert [r.id for r in tail.take().collect()] == [3]
    plan = Tail(lambda: spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "event_id", str(tmp_path / "other"), 5, start=100).take()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,100)" in plan


def test_a_backlog_is_put_away_in_few_writes(spark, tmp_path):
    """Every row once, over ties, gaps and a stretch that is handed out again; the batch numbers go on behind it."""
    rows = [(i, i % 3) for i in range(1, 400) if i % 7 and not 100 < i < 160] + [(200, 5)] * 30
    table = lambda: spark.createDataFrame(rows, "id long, x int").repartition(3)
    path, seen = str(tmp_path / "cursor"), []
    put = lambda part, batch: seen.append((batch, sorted(tuple(r) for r in part.collect())))
    assert drain(Tail(table, "id", path, 10), put, 2) == 2
    again = Tail(table, "id", path, 10).take(12)
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in Tail(table, "id", path, 10).take(12).collect())
    drain(Tail(table, "id", path, 10), put, at_once=12)
    assert len(seen) <= 7  # 34 of one batch each
    assert sorted(x for _, part in seen for x in part) == sorted(rows)
    numbers = [b for b, _ in seen]
    assert numbers == sorted(set(numbers))
