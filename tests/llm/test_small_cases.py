"""Nulls, empty and very long texts, ties, repeats, empty tables and clashing extra columns, operator by operator."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe, html_extract, licenses, mixing, quality_classifier, quality_rules, simhash, token_store, topk, toxicity
from tidewatch.llm.queries import tokenizer

GOOD = "the quick brown fox jumps over a lazy dog while many other small animals look on from behind trees and stones near that old river where nobody has been since last winter when snow fell for days without any pause so every road was closed until spring came back again with warm rain and green fields all around us"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, ids string, cell int"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i % 977} filler{i % 13}." for i in range(30_000))
    texts = [GOOD, GOOD, None, "", "   \n\t ", long, "one two", GOOD + " extra", "mit license\nReleased under the MIT License.", "a b c " * 40, GOOD.upper() + "!!", "<|endoftext|> x <|endoftext|>", "emoji 👍🏽 ümlaut\tñ\r\nline"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 4 == 0 else f"s{i % 3}", len(t or ""), 7, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[0], (None, GOOD, None, None, 3, 7, "clash", 1)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (7, 1, 0), (9, 0, 0), (10, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_rules(docs, spark):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.quality_report(docs).collect()}
    for row in docs.collect():
        text, w = row.text or "", words_of(row.text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        match = [g for g in got if g[0] == row.doc_id and g[1:7] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)]
        assert match, (row.doc_id, len(w), len(covered))
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 7, None}
    assert quality_rules.quality_report(docs.limit(0)).count() == 0


def test_quality_classifier(docs, labels):
    got = quality_classifier.classify(docs, labels, docs["source"], docs["lang"])
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    kept = quality_classifier.keep_good(docs, labels, docs["source"], docs["lang"])
    assert kept.columns == docs.columns and {0, 7} <= {r.doc_id for r in kept.collect()}
    assert quality_classifier.classify(docs.limit(0), labels.limit(0), docs["source"], docs["lang"]).count() == 0
    assert quality_classifier.classify(docs, labels.limit(0), docs["source"], docs["lang"]).where("kept").count() == docs.count()


def test_shrinkage(spark):
    """A sparse path stays near its site's rate, a well-known one goes its own way."""
    strength = quality_classifier._strength(0.8, 10, 1000.0, 200_000.0, 20.0)
    assert 1 <= strength <= 1e6
    assert quality_classifier._strength(0.8, 10, 1000.0, 200_000.0, 0.0) == 1e6


def brute_components(texts, most=3):
    fps = [simhash._fingerprint(t or "", 3) & (2**64 - 1) for t in texts]
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                parent[find(i)] = find(j)
    return fps, [find(i) for i in range(len(fps))]


def test_simhash(docs):
    rows = docs.collect()
    fps, groups = brute_components([r.text for r in rows])
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    for row, fp, group in zip(rows, fps, groups, strict=True):
        ids = [r.doc_id for r, g in zip(rows, groups, strict=True) if g == group and r.doc_id is not None]
        assert (row.doc_id, fp, min(ids) if ids else None) in got
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(groups))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.dedup(docs.limit(0)).count() == 0


def test_simhash_dense_cells_keep_components(spark, monkeypatch):
    """Chains and balls of fingerprints that crowd a few cells: chunks and forests give the components of all pairs."""
    import random

    monkeypatch.setattr(simhash, "FEW", 2)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(3)
    centers = [rng.getrandbits(64) for _ in range(6)]
    values = set(centers)
    for c in centers:
        for _ in range(40):
            x = c
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    parent = {v: v for v in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        assert bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3
        parent[find(r.a)] = find(r.b)
    brute = {v: v for v in signed}

    def root(x):
        while brute[x] != x:
            x = brute[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                brute[root(a)] = root(b)
    pairs = {(find(v), root(v)) for v in signed}
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_mixing(docs, spark):
    got = mixing.report(docs, block=4)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert abs(sum(t for _, t in by) - sum(r.size for r in rows)) < 1e-6 * sum(r.size for r in rows) + 1e-6
    again = mixing.report(docs.repartition(2), block=4)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    mixed = mixing.mixed_documents(docs, block=4)
    assert mixed.columns == docs.columns
    assert sum(len(words_of(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.report(docs.limit(0)).count() == 0
    assert mixing.targets([("a", 100), ("b", 10), (None, 50)]) == pytest.approx([130 * 5 / 6, 30.0, 130 / 6])


def test_targets_fill_by_weight():
    got = mixing.targets([("a", 10), ("b", 1000), ("c", 10)])
    assert got[0] == 30 and got[2] == 30 and sum(got) == pytest.approx(1020)
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)]) == [0.0]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(range(n), n, 42).tolist()) == list(range(n))


def test_bpe(docs):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = bpe.decode(bpe.encode(docs, path), path).collect()
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False)
        assert r.ids == want.ids and r.decoded == library.decode(want.ids, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_bpe_long_fragments_and_cuts():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    codec, library = bpe.codec(path), Tokenizer.from_file(path)
    for text in ("x" * 5000, "ab" * 700 + "é" * 300, "=" * 400 + "-" * 333, "ΟΔΟΣ İstanbul ǅ", "q" * 49, "q" * 51):
        import numpy as np

        assert np.frombuffer(codec.encode(text), codec.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert any(len(codec.cuts(w)) > 1 for w in ("qzxjqk", "vvxqjz", "zqxw"))


def test_token_store(docs):
    import numpy as np
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    store = token_store.write(docs, path)
    got = sorted(token_store.digest(store).collect(), key=lambda r: r.start)
    library, start = Tokenizer.from_file(path), 0
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    for r, row in zip(got, rows, strict=True):
        ids = library.encode(row.text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert store.borrowed.count() > 0  # copies share chunks
    empty = token_store.write(docs.limit(0), path)
    assert token_store.digest(empty).count() == 0


def test_chunks_follow_content():
    """The same passage after different starts gives the same chunks but for the ends."""
    import numpy as np

    rng = np.random.default_rng(1)
    body = rng.integers(0, 50_000, 20_000).astype(np.uint16)

    def addresses(ids):
        hits = (np.flatnonzero((token_store.rolling(ids) & np.uint64(token_store.MEAN - 1)) == 0) + 1).tolist()
        ends = token_store.cuts([h for h in hits if h < len(ids)], len(ids))
        return {token_store.address(ids[a:b].tobytes()) for a, b in zip([0, *ends[:-1]], ends, strict=True)}

    one, two = addresses(body), addresses(np.concatenate([rng.integers(0, 50_000, 777).astype(np.uint16), body]))
    assert len(one & two) > 0.8 * len(one)


def test_license_scan(docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect() if r.doc_id is not None}
    assert (got[8].n_base, got[8].first_word, got[8].last_word, got[8].base_labels, got[8].labels, got[8].score) == (2, 0, 5, "mit", "mit", 1.0)
    assert got[2].n_words == got[3].n_words == 0 and got[2].labels == "" and got[2].first_word is None and got[2].score == 0.0
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_join_is_exact(spark):
    import random

    rng, vocabulary = random.Random(4), ["licensed", "under", "cc", "by", "nc", "4", "0", "all", "rights", "reserved", "x", "y", "the", "mit", "license", "released"]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(400)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 4 : i * 4 + 4])) for i in range(100)], "doc_id long, text string")
    got = {(r.doc_id, b["first"], b["words"], b["label"], round(b["containment"], 9)) for r in licenses.scan(docs).collect() for b in r.blocks or ()}
    want = set()
    for d in range(100):
        text = " ".join(lines[d * 4 : d * 4 + 4]).split()
        for label, sentence in licenses.TEMPLATES:
            t = licenses.template_words(sentence)
            width = 1
            while width < len(licenses.split_words(sentence)):
                width *= 2
            for first in range(0, len(text), width):
                c = len(set(text[first : first + 2 * width]) & set(t)) / len(t)
                if c >= 0.8 - 1e-12:
                    want.add((d, first, 2 * width, label, round(c, 9)))
    assert got == want and want


def test_wrapped_notices(spark):
    """A notice is found whatever lines it stands on, after any number of words, and scattered words are none."""
    import textwrap

    rows = []
    for i, (label, sentence) in enumerate(licenses.TEMPLATES):
        for shift in (0, 1, 7, 30):
            for width in (20, 60, 1000):
                rows.append((len(rows), " ".join(["zzz"] * shift) + "\n" + textwrap.fill(sentence, width, initial_indent=" * ", subsequent_indent=" * ") + "\nzzz zzz", label))
        scattered = " ".join(w + " zzz" * 40 for w in licenses.split_words(sentence))
        rows.append((len(rows), scattered, None))
    rows.append((len(rows), "\u212a\u0130 ALL RIGHTS RESERVED", "all-rights-reserved"))
    rows.append((len(rows), "all r\u0130ghts reserved \u212a", None))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, _, label in rows:
        assert label in got[i].labels.split(",") if label else got[i].labels == ""


def test_license_scan_of_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "All rights reserved", 5, "x")], "doc_id long, text string, uid int, blocks string")
    assert [(r.doc_id, r.labels) for r in licenses.scan(docs).collect()] == [(1, "all-rights-reserved")]


def test_toxicity(spark):
    import random

    rng, rows = random.Random(1), []
    vocabulary = [a + b for a in ("ka", "lo", "mi", "re", "su", "ta", "ve", "no") for b in ("ban", "dor", "fel", "gis", "hun", "jal", "kem", "lit", "mor", "nex")]
    for i in range(240):
        w = rng.choices(vocabulary, k=rng.randint(15, 50))
        if i % 3 == 0:
            w[5], w[9] = "idiot", "scumbag,"
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "you idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i].held_out for i, _ in held)
    assert all(got[i].predicted == y for i, y in held)
    assert got[900].score == got[901].score < 0.5 and got[900].spans == []
    text = dict((i, t) for i, t, _ in rows)[0]
    assert {text[s.start : s.end] for s in got[0].spans} >= {"idiot"}
    empty = toxicity.fit(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(0), empty).count() == 0 and toxicity.score(docs, empty).where("score is null").count() == 0


def test_forward_backward_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    move = ((0.3, -0.7), (0.1, 0.9))
    lengths, e = np.array([4, 0, 6, 1]), rng.normal(size=11)
    starts = np.array([0, 4, 4, 10])
    got = toxicity.marginals(e, starts, lengths, move)
    for a, n in zip(starts, lengths, strict=True):
        total, ones = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[a + t] for t in range(n) if path[t]) + sum(move[x][y] for x, y in zip(path, path[1:], strict=False)))
            total += w
            ones += w * np.array(path, float) if n else 0
        assert np.allclose(got[a : a + n], ones / total if n else [])


def test_top_k(spark):
    import random

    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(700)]
    rows += [(1000 + i, rows[100][1]) for i in range(300)]  # many ties
    rows += [(2000, None), (2100, [1.0, None, 0.0, 0.0, 0.0]), (2200, [float("nan")] * 5), (2300, [float("inf")] * 5), (None, rows[0][1]), (2400, [1.0, 2.0]), (2401, [3.0, 4.0]), (100, rows[100][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = vectors.select("vec_id", topk.quantized(vectors["embedding"]).alias("q"))
    got = topk.top_k(q, F.col("vec_id") % 100 == 0, k=10, shard_rows=150).collect()
    import math

    clean = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(clean):
        if i % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, u, strict=True)), j, b) for b, (j, u) in enumerate(clean) if b != a and len(u) == len(v))[:10]
            want += [(i, r, j, -s) for r, (s, j, _) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(q.limit(0), F.lit(True)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{x:1}</style><script>var a="</p><p>";</script></head><body>
<header><div class="logo">Site</div></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site for you.</p></div>
<article><h1>Title &amp;&lt;b&gt;</h1><p>First  para&nbsp;graph<br>with <b>bold</b> text, long enough to be one.<p>Second &eacute; &#8364; part that isn't closed, and goes on for a while.
<div class="ad">Buy now</div><aside class="sidebar"><p>Side words here</p></aside><p>Third part of the article, again with some words in it.</p><form><input name=q><button>Go</button></form></article>
<section id="comments"><div class="comment"><p>I like it very much, thanks!</p></div></section><footer>&copy; me</footer></body>"""


def test_html(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    trees = html_extract.fit(pages)
    own = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "just text"), (1, "u", PAGE), (5, "u", "<p" + "x" * 50), (6, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    got = html_extract.extract(own, trees).collect()
    first = [r for r in got if r.page_id == 1]
    want = "Title &<b>\nFirst para graph with bold text, long enough to be one.\nSecond é € part that isn't closed, and goes on for a while.\nThird part of the article, again with some words in it."
    assert len(first) == 2 and all(r.text == want and r.n_chars == len(want) for r in first)
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (2, 3))
    assert html_extract.extract(own.limit(0), trees).count() == 0


def test_html_decoding_is_consistent():
    import random

    rng = random.Random(8)
    for _ in range(50):
        page = html_extract.parse("".join(rng.choice(["<div>", "</div>", "<p>", "text ", "<ul><li>", "</ul>", "<b>", "</b>"]) for _ in range(40)))
        odds = [rng.uniform(-2, 2) for _ in page.tags]
        kept, seen = html_extract.decode(page, odds), {}
        for i in range(1, len(page.tags)):
            p = page.parents[i]
            seen[i] = seen.get(p, 0) if not kept[i] else 1
            if kept[p] is False and seen.get(p, 0) == 1:
                assert not kept[i]
            if not kept[i] and kept[p]:
                seen[i] = 1


def test_digest_columns(spark):
    path = tokenizer("word_bpe_49k.json")
    row = bpe.encode(spark.createDataFrame([(1, "Hello world")], "doc_id long, text string"), path).select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("h"), "ids").first()
    assert row.h == hashlib.sha256(" ".join(map(str, row.ids)).encode()).hexdigest()
