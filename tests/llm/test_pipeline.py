"""The pipeline stage by stage against plain code, over documents with nulls, copies, junk and further columns."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tidewatch.llm import mixing, quality_rules
from tidewatch.llm.queries import tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = ["river", "stone", "quiet", "garden", "seven", "bridge", "market", "window", "candle", "forest", "paper", "winter", "harbour", "silver", "engine", "basket", "Letter", "morning", "ticket", "yellow"]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 250)), "en", f"s{i % 4}" if i % 9 else None, 0, 7, "x") for i in range(120)]
    near = rows[5][1].split()
    near[30] = "changed"
    rows += [(200, rows[5][1], "en", "s1", 0, 7, "x"), (201, " ".join(near), "en", "s2", 0, 7, "x"), (202, rows[5][1].upper(), "en", None, 0, 7, "x"), rows[7], rows[7]]
    rows += [(300 + i, "#$%& !!! " * rng.randint(20, 60) + "BUY NOW " * 40, "en", "s9", 0, 7, "x") for i in range(30)]
    rows += [(400, None, None, None, None, None, None), (401, "", "en", "s0", 0, 7, "x"), (402, "too few words", "de", "s0", 0, 7, "x"), (None, prose(90), "en", "s1", 0, 7, "x"), (403, prose(20_000), "fr", "s3", 0, 7, "x")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _uid int, pieces string").repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 330, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def tables(spark, folder):
    """The rows that enter each stage, and those of the last."""
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        found.append([r.asDict() for r in docs.collect()])
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "stage")
    return [*found, [r.asDict() for r in docs.collect()]]


def keyed(rows):
    return Counter(tuple(sorted(r.items(), key=lambda x: x[0])) for r in rows)


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near-dedup", "mixing", "bpe"]


def test_classifier_and_rules(tables):
    before, classified, ruled = tables[:3]
    assert keyed(classified) <= keyed(before) and keyed(ruled) <= keyed(classified)
    clean = [r for r in before if (r["doc_id"] or 0) < 300 and len(WORD.findall(r["text"] or "")) >= 50]
    assert keyed(clean) <= keyed(classified) and not any(r["doc_id"] and 300 <= r["doc_id"] < 330 for r in classified)
    for r in classified:
        text, w = r["text"] or "", WORD.findall(r["text"] or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(grams)
        inside = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        chars, n = sum(map(len, w)), len(w)
        bad = n < 50 or 100 * len(inside) > 50 * n or 100 * sum(text.count(c) for c in quality_rules.SYMBOLS) > 20 * n or 100 * sum("A" <= c <= "Z" for c in text) > 30 * chars
        bad = bad or 100 * text.count("!") > 50 * n or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or 10 * chars > 120 * n or 10 * chars < 25 * n
        assert (keyed([r]) <= keyed(ruled)) == (not bad)


def test_near_dedup(tables):
    before, after = tables[2:4]
    sets, group = [shingles(r["text"]) for r in before], list(range(len(before)))
    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    rank = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    best = {}
    for r, g in zip(before, group, strict=True):
        if g not in best or rank(r) < rank(best[g]):
            best[g] = r
    assert keyed(after) == keyed(best.values()) and len(after) < len(before)


def test_mixing(spark, folder, tables):
    before, after = tables[3:5]
    assert set(after[0]) == set(before[0])
    texts = {r["doc_id"]: (r["text"], r) for r in before}
    taken = Counter()
    for r in after:
        whole, row = texts[r["doc_id"]]
        assert {k: v for k, v in r.items() if k not in ("text", "n_chars")} == {k: v for k, v in row.items() if k not in ("text", "n_chars")} and r["n_chars"] == len(r["text"])
        words = iter(WORD.findall(whole))
        assert r["text"] == whole or all(w in words for w in WORD.findall(r["text"]))  # stretches in order
        taken[r["doc_id"]] += len(WORD.findall(r["text"]))
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "source")) for r in before], "doc_id long, text string, source string")
    plan = mixing.report(docs).collect()
    assert sum(r.taken for r in plan) == sum(taken.values()) and all(taken[r.doc_id] <= 3 * r["size"] for r in plan)


def test_tokens(tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    before, after = tables[4:6]
    want = Counter((r["doc_id"], r["source"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in before)
    assert Counter((r["doc_id"], r["source"], tuple(r["ids"])) for r in after) == want
    assert all(r["n_tokens"] == len(r["ids"]) and r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in after)


def test_run_gives_the_last_stage(spark, folder, tables):
    got = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["decoded"]) for r in got) == sorted((r["doc_id"] or -1, r["n_tokens"], r["decoded"]) for r in tables[5])


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "empty")
        assert docs.count() == 0, name
