"""SimHash fingerprints and components, and the classifier's posteriors, against plain code of the tests' own."""

import math
import random
import re
from collections import defaultdict

import pytest

from tidewatch.llm import quality_classifier, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)] + ["Zürich", "É", "ABC", "x\u00a0y"]
    out = []
    for i in range(90):
        w = [rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 2, 3, 40, 200)))]
        out.append(rng.choice((" ", "  ", "\n", "\t")).join(w))
        if i % 3 == 0 and w:  # a near copy and an exact one in capitals
            w[rng.randrange(len(w))] = "changed"
            out += [" ".join(w), out[-1].upper() if out[-1].isascii() else out[-1]]
    return [*out, None, "", " \n"]


def fingerprint(text):
    import xxhash

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash(spark, texts):
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {1000 - i: fingerprint(t) for i, t in enumerate(texts)}
    assert {d: f for d, (f, _) in got.items()} == prints
    least = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and least[b] < least[a]:
                    least[a], changed = least[b], True
    assert {d: c for d, (_, c) in got.items()} == least and len(set(least.values())) < len(least)


def test_classifier(spark, texts):
    """Groups, strengths of the priors and final scores from the documents' own scores, by the formulas in plain code."""
    rng = random.Random(2)
    rows = [(i, t, rng.choice(("a", "a", "a", "b", None, f"rare{i % 5}")), rng.choice(("x", "y", None))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(len(t or "") > 100)) for i, t, _, _ in rows if i % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels, docs["source"], docs["lang"]).collect()}
    assert len(got) == len(rows)
    p = {i: got[i].doc_score for i, *_ in rows}
    sites, paths = defaultdict(list), defaultdict(list)
    for i, _, site, path in rows:
        sites[site].append(p[i])
        paths[site, path].append(p[i])
    n = len(rows)
    mean = sum(p.values()) / n

    def strength(groups, squares, between):
        within = mean * (1 - mean)
        excess = (between - (groups - 1) * within) / (n - squares / n)
        return min(max(within / excess - 1, 1.0), 1e6) if excess > 0 else 1e6

    outer = strength(len(sites), sum(len(v) ** 2 for v in sites.values()), sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in sites.values()))
    site_rate = {s: (sum(v) + outer * mean) / (len(v) + outer) for s, v in sites.items()}
    inner = strength(len(paths) - len(sites) + 1, sum(len(v) ** 2 for v in paths.values()), sum(len(v) * (sum(v) / len(v) - site_rate[s]) ** 2 for (s, _), v in paths.items()))
    path_rate = {k: (sum(v) + inner * site_rate[k[0]]) / (len(v) + inner) for k, v in paths.items()}
    logit = lambda x: math.log(x / (1 - x))
    for i, _, site, path in rows:
        r = got[i]
        assert (r.site_rate, r.path_rate) == (pytest.approx(site_rate[site]), pytest.approx(path_rate[site, path]))
        final = 1 / (1 + math.exp(-(logit(min(max(p[i], 1e-12), 1 - 1e-12)) + logit(min(max(path_rate[site, path], 1e-6), 1 - 1e-6)) - logit(mean))))
        assert r.score == pytest.approx(final, abs=1e-6) and r.kept == (r.score >= 0.5)
    # The features of the model, by loops.
    for r in quality_classifier.measured(docs, docs["source"], docs["lang"]).collect():
        text = rows[r.doc_id][1] or ""
        words = WORD.findall(text)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        share = lambda x, y: math.sqrt(min(x / y, 1.0)) if y else 0.0
        want = (share(sum(text.count(c) for c in "#*$%&|<>"), len(words)), share(sum("A" <= c <= "Z" for c in text), sum(map(len, words))), share(text.count("!"), len(words)), share(len(inside), len(words)), share(len(lines) - len(set(lines)), len(lines)))
        assert (r.symbols, r.capitals, r.exclamations, r.repeated_words, r.repeated_lines) == pytest.approx(want)
        assert r.word_length == pytest.approx(min(sum(map(len, words)) / len(words), 20) / 10 if words else 0) and r.log_words == pytest.approx(math.log1p(len(words)) / 10)
