"""The pipeline's near-dedup against Jaccard similarities of all pairs."""

import random

import pytest

import corpus_pipeline
from tidewatch.llm import near_copies


def grams(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Pairs of rows (doc_id, text) with Jaccard 0.8 or more, and the least doc_id of each row's component."""
    sets, at = [grams(t) for _, t in rows], {}
    for k, s in enumerate(sets):
        for g in s or {b""}:
            at.setdefault(g, []).append(k)
    pairs, parent = set(), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for ks in at.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                if (a, b) not in pairs and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    pairs.add((a, b))
                    parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return pairs, {i for i in least.values()}


def edited(rng, words, share):
    return " ".join("x" + w if rng.random() < share else w for w in words)


@pytest.mark.parametrize("few, volume", [(24, 250_000), (2, 900)])
def test_near_copies_of_changed_words(spark, monkeypatch, few, volume):
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "VOLUME", volume)
    rng, texts = random.Random(5), [None, "", " \n", "one two", "One  two", "two one"]
    for n in (30, 80, 200, 60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [edited(rng, base, rng.choice((0, 0.01, 0.02, 0.04, 0.3))) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == brute(rows)[1]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_near_copies_of_the_tables(spark):
    """Each pair at 0.8 of the 0.01 tables, those many bits of a SimHash apart included."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs, want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(pairs) > 90
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").select("doc_id").collect()} == want


def test_simhash_links_what_shares_no_cell(spark):
    """Pairs of the grid are candidates of their own, exactly checked: of sets without a common cell those at 0.8 are linked, the others not."""
    sets = {1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4, 5, 6], 3: [1, 2, 3, 4, 5], 4: [7, 8, 9, 10, 11], 5: [1, 2, 3, 4, 5]}
    prints = {1: 0b1011, 2: 0b1000, 3: 0b1011, 4: 0b1001, 5: -1}
    members = spark.createDataFrame([(k, len(v), prints[k], [k]) for k, v in sets.items()], "sig long, size long, fp long, cells array<long>")
    words = spark.createDataFrame(list(sets.items()), "sig long, words array<long>")
    roots = near_copies.roots_of(members, lambda sigs: words.join(sigs, "sig", "left_semi"), 0.8)
    assert sorted((r.node, r.root) for r in roots.collect()) == [(2, 1), (3, 1)]
