"""Alignment of tokenizers against plain code."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidewatch.llm import alignment, queries
from tidewatch.llm.queries import tokenizer

A, B = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def cut(texts):
    """Groups of each text, by the ends that both sides share: lists of (ids of A, ids of B)."""
    library, model = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    own = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    symbol = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}
    bytes_a = {i: bytes(symbol[c] for c in t) for t, i in json.load(open(A))["model"]["vocab"].items()}
    bytes_b = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    for text in texts:
        ids_a, ids_b = library.encode(" " + (text or ""), add_special_tokens=False).ids, model.encode(text or "")
        sides = [[bytes_a[i] for i in ids_a], [bytes_b(i) for i in ids_b]]
        if not text or any(b"".join(s) != b" " + text.encode() for s in sides):
            yield []
            continue
        groups, i, j = [], 0, 0
        while i < len(ids_a):
            x, y, pa, pb = i + 1, j + 1, len(sides[0][i]), len(sides[1][j])
            while pa != pb:
                if pa < pb:
                    pa, x = pa + len(sides[0][x]), x + 1
                else:
                    pb, y = pb + len(sides[1][y]), y + 1
            groups.append((ids_a[i:x], ids_b[j:y]))
            i, j = x, y
        yield groups


def expected(docs):
    cuts, counts = list(cut([t for _, t in docs])), Counter()
    for groups in cuts:
        counts.update({(a, b) for x, y in groups for a in x for b in y})
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    rows = []
    for (doc_id, _), groups in zip(docs, cuts, strict=True):
        links = [counts[a, b] for x, y in groups for a in x for b in y]
        best = sum(counts[a, b] == most[a] for x, y in groups for a in x for b in y)
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), best, sum(links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(rows, key=str)


def test_pointer_jumping_finds_the_cuts_at_shared_ends():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 200)
        a, b = (np.array(sorted({*rng.choices(range(1, n + 1), k=rng.randrange(1, n + 1)), n})) for _ in range(2))
        shared = np.intersect1d(a, b)
        for ends, labels in ((a, alignment.terminals(a, b)[: len(a)]), (b, alignment.terminals(a, b)[len(a) :])):
            assert (a[labels] == shared[np.searchsorted(shared, ends)]).all()


def test_query_equals_plain_code(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = queries.op12_alignment(spark, d)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(docs)


def test_odd_texts_and_clashing_columns(spark):
    """Texts that a side doesn't give back, special strings, periodic runs (groups of many links)."""
    rng = random.Random(4)
    scripts = ["abc XYZ", "éüß", "漢字かな", "кот", "👍🏽 ​́", " \t\n\r\x00", "0123456789", "=-_.,;:!?", "<s></s><unk><|endoftext|>", "▁"]
    texts = ["", None, " ", "<|endoftext|> and <s> <0x41>", "a▁b", "=" * 5001, "x" + "ab" * 3000, "-" * 777 + "a" + "=" * 3333, "0" * 500, "hello hello hello"]
    texts += ["".join(rng.choice(rng.choice(scripts)) for _ in range(rng.randrange(1, 90))) for _ in range(120)]
    docs = [*enumerate(texts), (0, "hello"), (0, "hello"), (None, "hello there"), (7, None)]
    frame = spark.createDataFrame([(*x, 1, "p", 2, 3) for x in docs], "doc_id long, text string, block int, pairs string, n_a int, at int").repartition(3)
    got = alignment.report(frame, A, B)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(docs)
    assert alignment.report(frame.limit(0), A, B).count() == 0


def test_small_slices_and_chunks_give_the_same_links(monkeypatch):
    own = alignment.Aligner(A, B)
    texts = ["=" * 4001 + "a" * 999, "some words here, some words there", "x" + "-" * 513, ""]
    whole = alignment.aligned(own, texts)
    monkeypatch.setattr(alignment, "PAIRS", 7)
    monkeypatch.setattr(alignment, "FEW_LINKS", 1)
    cut_up = alignment.aligned(own, texts)
    for x, y in zip(whole, cut_up, strict=True):
        assert list(x) == list(y)
    assert whole[6].sum() == whole[3].sum()
