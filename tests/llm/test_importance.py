"""Importance resampling against plain code."""

import hashlib
import math
import random
import re
import zlib

import pytest

from tidewatch.llm import importance, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def expected(docs, target, percent=25, least=20):
    """All rows by plain code: (doc_id, n_features, weight, score, rank)."""
    bucket = lambda x: zlib.crc32(x.encode()) % 10_000
    source, wanted = [0] * 10_000, [0] * 10_000
    for counts, texts in ((source, [t for _, t in docs]), (wanted, target)):
        for text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] += 1
    s_all, t_all = sum(source), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10_000) / ((s + 1) * (t_all + 10_000)))) for s, t in zip(source, wanted)]
    rows = []
    for doc_id, text in docs:
        w, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    ranks = {id(r): i for i, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


def test_crcs_of_all_ngrams_come_from_prefixes():
    rng = random.Random(5)
    texts = ["", "One", "a b", "ünï Çode 漢字 x1 y-2", "q" * 70_000 + " tail " + "r" * 3000, "\x00..\x7f", " ".join("ab" * rng.randrange(1, 40) for _ in range(300))]
    counts, grams = importance.ngram_crcs([t.encode() for t in texts], 3)
    for text, n, found in zip(texts, counts, grams, strict=True):
        w, _ = features(text)
        assert n == len(w)
        want = [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
        assert sorted(found.tolist()) == sorted(zlib.crc32(x.encode()) for x in want)


def test_query_equals_plain_code(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = queries.op11_importance(spark, d)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(docs, target)


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_nulls_repeats_ties_and_clashing_columns(spark, percent):
    long = " ".join(f"w{i % 999}" for i in range(60_000))
    words = " ".join(f"Term{i}" for i in range(25))
    texts = [words, None, "", " .,! ", long, words + " more", "ÀÉ ß漢字 " * 12, "x" * 100_000]
    docs = [*enumerate(texts), (0, words), (0, words), (4, "short"), (None, words), (None, None)]
    frame = spark.createDataFrame([(*x, 1, "clash", 2, 3) for x in docs], "doc_id long, text string, n_words int, buckets string, score int, rank int").repartition(3)
    target = spark.createDataFrame([(words,), (None,), ("漢字 ß",)], "text string")
    got = importance.resample(frame, target, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(docs, [words, None, "漢字 ß"], percent)
    assert importance.resample(frame.limit(0), target).count() == 0
    bare = importance.resample(frame, target.limit(0), percent=percent)
    assert sorted((tuple(r) for r in bare.collect()), key=str) == expected(docs, [], percent)


def test_the_draw_follows_the_target(spark):
    """Documents like the target are drawn far more often than others."""
    rng = random.Random(3)
    like, other = [f"near{i}" for i in range(60)], [f"far{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(like if i % 4 == 0 else other, k=40))) for i in range(400)]
    target = spark.createDataFrame([(" ".join(rng.choices(like, k=200)),) for _ in range(10)], "text string")
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), target).where("rank is not null").collect()
    assert len(got) == 100
    assert sum(r.doc_id % 4 == 0 for r in got) >= 60  # by chance 25
