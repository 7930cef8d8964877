"""The mix against plain loops: the words taken of each document, replayed block by block, and the draws by shard."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewatch.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{i}.{k}" for k in range((i * 7) % 23)), f"s{min(i % 7, 3)}" if i % 11 else None, "en", 0) for i in range(400)]
    rows += [(7, rows[7][1], rows[7][2], "en", 0)] * 3 + [(9001, None, "s0", "en", 0), (9002, " \n\t", "s1", None, None), (9003, "long " * 5000, "s2", "de", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int").repartition(3)


def test_taken_by_replay(docs):
    """Each source's words in the plan's order, cut into blocks; a draw of a block gives a pass over each of its words."""
    plan = mixing.mix(docs, block=5, shard_slots=16)
    streams = defaultdict(list)
    for r in sorted(plan.docs.collect(), key=lambda r: (r["_s"], r["_at"], r["_size"])):
        assert r["_at"] == len(streams[r["_s"]])
        streams[r["_s"]] += [r["_uid"]] * r["_size"]
    for i, source in enumerate(plan.sources):
        assert len(streams[i]) == source.size and source.blocks == -(-source.size // 5)
    totals = [round(s.target * s.blocks / s.size) if s.size else 0 for s in plan.sources]
    shards = -(-sum(totals) // 16)
    taken, seen, drawn = Counter(), Counter(), [0] * len(totals)
    for shard, counts, before in mixing.dealt(totals, 16, 0, shards, 17):
        assert list(before) == drawn and sum(counts) == min(16, sum(totals) - 16 * shard)
        for i, n in enumerate(counts):
            for j in range(drawn[i], drawn[i] + n):
                block = int(mixing.permuted([j % plan.sources[i].blocks], plan.sources[i].blocks, 17 * 1_000_003 + i)[0])
                seen[i, block] += 1
                for uid in streams[i][block * 5 : block * 5 + 5]:
                    taken[uid] += 1
            drawn[i] += int(n)
    assert drawn == totals
    assert {(r["_s"], r["block"]): r["times"] for r in plan.times.collect()} == seen
    got = Counter()
    for r in mixing._pieces(plan).collect():
        got[r["_uid"]] += r["n"] * r["times"]
    assert got == taken
    # A block is taken again only after all others of its source.
    for i, source in enumerate(plan.sources):
        times = [seen[i, b] for b in range(source.blocks)]
        assert max(times) - min(times) <= 1 and max(times) <= 3


def test_report_meets_targets_and_reruns_agree(docs):
    rows = mixing.report(docs, block=5, shard_slots=16).collect()
    assert len(rows) == docs.count()
    by_source = defaultdict(list)
    for r in rows:
        assert r.taken <= 3 * r["size"] or r["size"] == 0 and r.taken == 0
        by_source[r.source_size, r.target].append(r.taken)
    for (_, target), taken in by_source.items():
        assert abs(sum(taken) - target) <= max(0.1 * target, 10)
    again = mixing.report(docs.repartition(5, "lang"), block=5, shard_slots=16)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_extra_columns_of_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", "x", 5, 6, 7), (2, "g h i", "y", 5, 6, 7)], "doc_id long, text string, source string, _uid int, _s int, pieces int")
    got = mixing.mixed_documents(rows, block=2)
    assert got.columns == rows.columns and {(r["_uid"], r["_s"], r["pieces"]) for r in got.collect()} == {(5, 6, 7)}
    assert {r.doc_id for r in mixing.report(rows, block=2).collect()} == {1, 2}


def test_any_part_of_the_shards_is_dealt_alike():
    totals = [900, 250, 0, 77]
    whole = [(s, list(c), list(f)) for s, c, f in mixing.dealt(totals, 10, 0, 123, 3)]
    assert len(whole) == 123 and np.sum([c for _, c, _ in whole], axis=0).tolist() == totals
    for a, b in ((0, 1), (5, 31), (60, 123), (122, 123)):
        assert [(s, list(c), list(f)) for s, c, f in mixing.dealt(totals, 10, a, b, 3)] == whole[a:b]


def test_draws_spread_as_multinomials_do():
    """Over many seeds a shard's count has the mean and the variance of draws without putting back."""
    totals, width = [600, 300, 100], 20
    counts = np.array([next(c for s, c, _ in mixing.dealt(totals, width, 31, 32, seed)) for seed in range(1500)])
    share = np.array(totals) / 1000
    assert np.allclose(counts.mean(axis=0), width * share, atol=0.3)
    assert np.allclose(counts.var(axis=0), width * share * (1 - share) * (1000 - width) / 999, rtol=0.2)


def test_huge_totals():
    totals = [3 * 10**12, 10**12, 5]
    shards = -(-sum(totals) // 1024)
    got = list(mixing.dealt(totals, 1024, shards - 2, shards, 1))
    assert [int(sum(c)) for _, c, _ in got] == [1024, sum(totals) - 1024 * (shards - 1)] and (got[1][1] + got[1][2]).tolist() == totals
