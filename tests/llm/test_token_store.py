"""The token store: each chunk once, files in order, damage found, and the encoder's memo against the library."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import token_store
from tidewatch.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "in", "er", "an", "re", "on", "ed", "sh"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(900))
    rows = [(1000 - i, " ".join(word() for _ in range(rng.randint(0, 900))) + (" " + passage if i % 3 == 0 else "") + (" " + " ".join(word() for _ in range(300)) if i % 6 == 0 else "")) for i in range(120)]
    rows += [(5, passage * 20), (5, passage * 20), (None, passage), (None, None), (6, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(7)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_round_trip_and_layout(docs):
    import zstandard

    store, plain = token_store.write(docs, PATH), library()
    want = sorted((r.doc_id is not None, r.doc_id or 0, tuple(plain.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in docs.collect())
    got = sorted(token_store.read(store).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d if known else None for known, d, _ in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(int.from_bytes(r.ids[i : i + 2], "little") for i in range(0, len(r.ids), 2))) for r in got) == want
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    # Each distinct chunk is stored once, and all that is stored is such a chunk.
    stored, distinct = [], {}
    for r in store.packs.collect():
        blob, at = zstandard.ZstdDecompressor().decompress(r.payload), 0
        for pos, (address, size) in enumerate(zip(r.addresses, r.sizes, strict=True)):
            distinct[bytes(address)] = size
            if pos not in r.theirs:
                assert token_store.address(blob[at : at + size]) == address
                stored.append(bytes(address))
                at += size
        assert at == len(blob)
    assert len(stored) == len(set(stored)) and set(stored) == set(distinct) and sum(len(r.addresses) for r in store.packs.collect()) > len(distinct) + 100
    # Files follow doc_id: within each, and from file to file.
    spans = sorted((min(d), max(d), d == sorted(d)) for d in ([-1 if x is None else x for x in r.ids] for r in store.packs.groupBy(F.input_file_name()).agg(F.collect_list(F.coalesce("doc_id", F.lit(-1))).alias("ids")).collect()))
    assert all(s[2] for s in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("column", ["payload", "root", "addresses"])
def test_damage_is_found(docs, column):
    import zstandard

    store = token_store.write(docs.where("doc_id > 990"), PATH)
    hurt = {"payload": F.lit(zstandard.ZstdCompressor().compress(b"\1\2" * 5000)), "root": F.lit(b"0" * 16), "addresses": F.transform("addresses", lambda _: F.lit(b"0" * 16))}[column]
    store.packs = store.packs.withColumn(column, hurt)
    with pytest.raises(Exception, match="the store doesn't give back a document"):
        token_store.read(store).collect()


def test_encoder_against_the_library():
    """Every character of the Latin range in every kind of place, and random texts, of any script, with special tokens and endless white space."""
    own, plain = token_store.Encoder(PATH), library()
    assert own.merge is not None
    check = lambda texts: [own.pack(f.ids) for f in plain.encode_batch_fast(texts, add_special_tokens=False)]
    latin = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    assert not any(token_store.FOREIGN.search(c) for c in latin)
    texts = [t for c in latin for t in (c, f"a{c}b", f" {c} {c}{c}", f"1{c}2 {c}.", f"x {c}", f"{c}\n{c} \n", f"'{c}s'{c}'ll", f"\t{c}  {c}")]
    assert own.encode(texts) == check(texts)
    rng = random.Random(5)
    parts = ["the", "The", "an,", "inan.", "x1", "don't", "WE'LL", "é", "日本", "a.b,c", "1,", ",", ".", "--", "<|endoftext|>", "\n", "  ", "\x85", "\xa0", "ﬁ", "א", "👍🏽", "\u3000"]
    for size in (12, 18, len(parts)):
        for _ in range(60):
            texts = ["".join(rng.choice(parts[:size]) + rng.choice(["", " ", rng.choice(parts[:size])]) for _ in range(rng.randint(0, 40))) for _ in range(20)]
            assert own.encode(texts) == check(texts)
    for text in (" " * 3_000_000 + "x", "a" * 200_000, "-" * 200_000, "\n" * 2_000_000):
        assert own.encode([text]) == check([text])


def test_other_tokenizers_go_to_their_library():
    other = token_store.Encoder(tokenizer("word_bpe_49k.json"))
    assert other.merge is None
    assert other.encode(["Hello  World", ""]) == [other.pack(other.library.encode("Hello  World", add_special_tokens=False).ids), b""]


def test_an_empty_table_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, "a b", "x", 3), (2, None, "y", 4)], "doc_id long, text string, payload string, kind int")
    got = token_store.digest(token_store.write(rows, PATH)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(1, 0, 3), (2, 3, 1)]
    assert token_store.digest(token_store.write(rows.limit(0), PATH)).collect() == []
