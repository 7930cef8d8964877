"""The replay of the book against a loop over the deltas."""

import random

import pytest

from tidewatch.operators import book

SPAN = 600_000


def loop(deltas, top, every, at):
    """Heads by plain code: {(instrument, ts, seq): (bids, asks, counts)}."""
    found = {}
    for instrument in {d[0] for d in deltas}:
        own = sorted((d for d in deltas if d[0] == instrument), key=lambda d: (d[1], d[2]))
        last = max(d[1] for d in deltas)
        probes = {(t, s) for i, t, s in at if i == instrument}
        if every:
            probes |= {(t, t if (t, book.LAST) not in probes else book.LAST) for t in range(0, last + 1, every)}
        for ts, seq in probes:
            levels = {}
            for _, t, s, side, action, price, units in own:
                if (t, s) <= (ts, seq) if (instrument, ts, seq) in at and seq != book.LAST else t <= ts:
                    left = max(0, levels.get((side, price), 0) + (-units if action == "delete" else units))
                    levels[side, price] = left
            live = {k: q for k, q in levels.items() if q > 0}
            if live:
                bids = sorted(((p, q) for (s, p), q in live.items() if s == "buy"), reverse=True)
                asks = sorted((p, q) for (s, p), q in live.items() if s == "sell")
                found[instrument, ts, seq] = (bids[:top], asks[:top], len(bids), len(asks))
    return found


@pytest.mark.parametrize("every", [None, 7_000])
def test_replay(spark, every):
    rng = random.Random(6)
    deltas = []
    for seq in range(600):
        ts = rng.choice([rng.randrange(0, 3 * SPAN), SPAN, 2 * SPAN - 1, 7_000 * rng.randrange(0, 250)])
        side = rng.choice(["buy", "sell"])
        deltas.append((rng.choice("AAAB"), ts, seq, side, rng.choice(["insert", "delete", "update"]), round((99 if side == "buy" else 100) + rng.randrange(10) / 10, 1), rng.randrange(1, 60)))
    at = {(d[0], d[1], d[2]) for d in rng.sample(deltas, 60)} | {("A", 7_000 * k, book.LAST) for k in range(0, 300, 9)} | {("B", 5 * SPAN, book.LAST), ("C", 5, book.LAST)}
    depth = spark.createDataFrame([(i, t, s, side, a, p, u / 10) for i, t, s, side, a, p, u in deltas], "instrument_id string, ts_ms long, seq long, side string, action string, price double, qty double").repartition(3)
    probes = spark.createDataFrame(list(at), "instrument_id string, ts_ms long, seq long")
    want = {k: ([(p, q / 10) for p, q in b], [(p, q / 10) for p, q in a], nb, na) for k, (b, a, nb, na) in loop(deltas, 3, every, at).items()}
    got = {(r.instrument_id, r.ts_ms, r.seq): ([tuple(x) for x in r.bids], [tuple(x) for x in r.asks], r.bid_levels, r.ask_levels) for r in book.replay(depth, 3, every, probes).collect()}
    assert got == want


def test_a_level_that_stays_is_known_in_every_bucket(spark):
    depth = spark.createDataFrame([("A", 10, 1, "buy", "insert", 9.0, 0.1), ("A", 20, 2, "buy", "insert", 9.0, 0.2), ("A", 4 * SPAN + 5, 3, "buy", "delete", 9.0, 0.3), ("A", 4 * SPAN + 9, 4, "sell", "insert", 11.0, 1.0)], "instrument_id string, ts_ms long, seq long, side string, action string, price double, qty double")
    got = book.replay(depth, 1, SPAN // 2).orderBy("ts_ms").collect()
    assert [(r.ts_ms, [tuple(x) for x in r.bids]) for r in got] == [(k * SPAN // 2, [(9.0, 0.3)]) for k in range(1, 9)]
    assert book.replay(depth.limit(0), 1, 1_000).count() == 0


FEED = "instrument_id string, ts_ms long, seq long, kind string, first_u long, u long, pu long, levels array<struct<side:string,price:double,qty:double>>"


def test_snapshot_then_diffs(spark):
    """Documented values: a diff of update 101 over a snapshot of update 100."""
    snapshot = [("buy", 100.0, 1.0), ("buy", 99.5, 2.0), ("sell", 100.5, 1.5), ("sell", 101.0, 3.0)]
    diff = [("buy", 100.0, 1.2), ("buy", 99.5, 0.0), ("sell", 100.5, 0.0), ("sell", 100.7, 1.0)]
    feed = spark.createDataFrame([("A", 1, 1, "snapshot", None, 100, None, snapshot), ("A", 2, 2, "diff", 101, 101, 100, diff)], FEED)
    got = sorted((r.side, r.level, r.price, r.qty, r.gapped) for r in book.absolute_books(feed, 2).collect())
    assert got == [("buy", 1, 100.0, 1.2, False), ("sell", 1, 100.7, 1.0, False), ("sell", 2, 101.0, 3.0, False)]


def test_epochs_end_at_gaps_and_snapshots(spark):
    one = lambda price, qty: [("buy", price, qty)]
    feed = [
        ("diff", 1, 5, 0, one(1.0, 9.0)),  # before any snapshot
        ("snapshot", None, 10, None, [("buy", 9.0, 1.0), ("sell", 11.0, 1.0)]),
        ("diff", 8, 9, 7, one(5.0, 5.0)),  # older than the snapshot
        ("diff", 8, 12, 7, one(8.0, 2.0)),  # spans update 11
        ("diff", 13, 14, 12, one(9.0, 0.0)),
        ("diff", 13, 14, 12, one(9.0, 7.0)),  # again
        ("diff", 17, 18, 16, one(7.0, 3.0)),  # 15 and 16 are missing
        ("diff", 19, 20, 18, one(6.0, 3.0)),
        ("snapshot", None, 30, None, [("sell", 12.0, 4.0)]),
        ("diff", 32, 33, 31, one(3.0, 3.0)),  # doesn't span update 31
        ("snapshot", None, 40, None, one(2.0, 2.0)),
    ]
    rows = [("A", 900_000 * i, i, kind, a, u, pu, levels) for i, (kind, a, u, pu, levels) in enumerate(feed)]
    got = sorted((r.epoch.seq, r.gapped, r.side, r.price, r.qty) for r in book.absolute_books(spark.createDataFrame(rows, FEED).repartition(3), 5).collect())
    assert got == [(1, True, "buy", 8.0, 2.0), (1, True, "sell", 11.0, 1.0), (8, True, "sell", 12.0, 4.0), (10, False, "buy", 2.0, 2.0)]
