"""Keyed tables of files: appends once, keeps the newest, adds up, and a batch written twice changes nothing."""

import pytest

from tidewatch.operators import sinks

KIND = "k string, day int, t int, n long"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def rows(spark, *values):
    return spark.createDataFrame(list(values), KIND)


def state(spark, path):
    return sorted(tuple(r[c] for c in ("k", "day", "t", "n")) for r in sinks.read(spark, path).collect())


def test_append_once(spark, path):
    merge = sinks.append_once(["k", "day"])
    sinks.write(rows(spark, ("a", 1, 1, 1), ("b", 1, 1, 1), ("c", 2, 1, 1)), 0, path, "day", merge)
    sinks.write(rows(spark, ("a", 1, 9, 9), ("d", 1, 2, 2), ("d", 1, 2, 2), ("e", 3, 1, 1)), 1, path, "day", merge)
    assert state(spark, path) == [("a", 1, 1, 1), ("b", 1, 1, 1), ("c", 2, 1, 1), ("d", 1, 2, 2), ("e", 3, 1, 1)]


def test_upsert(spark, path):
    merge = sinks.upsert(["k", "day"], ["t"])
    sinks.write(rows(spark, ("a", 1, 5, 1), ("b", 1, 5, 1)), 0, path, "day", merge)
    sinks.write(rows(spark, ("a", 1, 7, 2), ("b", 1, 3, 2), ("a", 2, 1, 3)), 1, path, "day", merge)
    assert state(spark, path) == [("a", 1, 7, 2), ("a", 2, 1, 3), ("b", 1, 5, 1)]


def test_counters_add_up_once_a_batch(spark, path):
    merge = sinks.add(["k", "day"], ["n", "t"])
    first, second = rows(spark, ("a", 1, 1, 10), ("b", 2, 1, 1)), rows(spark, ("a", 1, 1, 5), ("c", 3, 1, 7))
    sinks.write(first, 0, path, "day", merge)
    sinks.write(second, 1, path, "day", merge)
    want = [("a", 1, 2, 15), ("b", 2, 1, 1), ("c", 3, 1, 7)]
    assert state(spark, path) == want
    sinks.write(second, 1, path, "day", merge)  # again, as after a failure
    sinks.write(first.limit(0), 2, path, "day", merge)
    assert state(spark, path) == want


def test_second_writer_and_new_checkpoint_lose_nothing(spark, path):
    merge = sinks.append_once(["k", "day"])
    sinks.write(rows(spark, ("a", 1, 1, 1)), 0, path, "day", merge, "first")
    sinks.write(rows(spark, ("b", 1, 1, 1)), 1, path, "day", merge, "first")
    sinks.write(rows(spark, ("c", 1, 1, 1), ("a", 1, 9, 9)), 0, path, "day", merge, "second")
    want = [("a", 1, 1, 1), ("b", 1, 1, 1), ("c", 1, 1, 1)]
    assert state(spark, path) == want
    sinks.write(rows(spark, ("b", 1, 1, 1)), 1, path, "day", merge, "first")  # again
    sinks.write(rows(spark, ("c", 1, 1, 1)), 0, path, "day", merge, "second")
    assert state(spark, path) == want
    with pytest.raises(ValueError, match="another writer"):
        sinks.write(rows(spark, ("d", 1, 1, 1)), 0, path, "day", merge, "first")
    assert state(spark, path) == want
    with pytest.raises(ValueError, match="isn't a key"):
        sinks.write(rows(spark, ("d", 1, 1, 1)), 2, path, "day", sinks.append_once(["k"]), "first")


def test_counters_of_two_writers_add_up(spark, path):
    merge = sinks.add(["k", "day"], ["n", "t"])
    for batch in (0, 1, 1):
        for writer in ("x", "y"):
            sinks.write(rows(spark, ("a", 1, 1, 10)), batch, path, "day", merge, writer)
    assert state(spark, path) == [("a", 1, 4, 40)]


@pytest.mark.parametrize("whole", [True, False])
def test_crash_between_the_steps(spark, path, monkeypatch, whole):
    """A whole staged batch is moved in by the next write, an unfinished one is dropped; the batch itself may be written again either way."""
    import shutil

    merge = sinks.add(["k", "day"], ["n", "t"])
    sinks.write(rows(spark, ("a", 1, 1, 10)), 0, path, "day", merge, "w")

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "_move_in", crash)
        with pytest.raises(RuntimeError, match="lost"):
            sinks.write(rows(spark, ("a", 1, 1, 5), ("b", 2, 1, 5)), 1, path, "day", merge, "w")
    if not whole:
        import os

        os.remove(f"{path}-staged/w-1/_SUCCESS")
    else:  # the move itself had begun: a partition was gone already
        shutil.rmtree(f"{path}/day=1")
    sinks.write(rows(spark, ("c", 3, 1, 1)), 0, path, "day", merge, "other")
    sinks.write(rows(spark, ("a", 1, 1, 5), ("b", 2, 1, 5)), 1, path, "day", merge, "w")
    assert state(spark, path) == [("a", 1, 2, 15), ("b", 2, 1, 5), ("c", 3, 1, 1)]
    assert not os.listdir(f"{path}-staged") if not whole else not sinks.exists(spark, f"{path}-staged/w-1")


def test_an_empty_first_batch_leaves_no_table(spark, path):
    merge = sinks.upsert(["k", "day"], ["t"])
    sinks.write(rows(spark, ("a", 1, 1, 1)).limit(0), 0, path, "day", merge, "w")
    assert not sinks.exists(spark, path)
    sinks.write(rows(spark, ("a", 1, 1, 1)), 1, path, "day", merge, "w")
    assert state(spark, path) == [("a", 1, 1, 1)]
