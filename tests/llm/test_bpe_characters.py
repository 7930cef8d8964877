"""Ids and decoded texts of every code point in every kind of place, and of random texts of many scripts, against the tokenizers library."""

import random

from tokenizers import Tokenizer

from tidewatch.llm import bpe
from tidewatch.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


def differing(texts):
    import numpy as np

    library, own, tokens = Tokenizer.from_file(PATH), bpe.codec(PATH), bpe.token_list(PATH)
    library.no_truncation()
    library.no_padding()
    found = [np.frombuffer(own.encode(t), own.dtype).tolist() for t in texts]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    decoded = library.decode_batch(wanted, skip_special_tokens=False)
    return [t for t, a, b, d in zip(texts, found, wanted, decoded, strict=True) if a != b or " ".join(tokens[i] for i in a) != d]


def test_every_code_point():
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    for begin in range(0, len(points), 20_000):
        assert differing([form.format(c) for c in points[begin : begin + 20_000] for form in ("{}", "{}irni", "te{}st A", "ab{}")]) == []


def test_random_texts_of_many_scripts():
    rng = random.Random(8)
    blocks = [(0x20, 0x7F), (0x20, 0x7F), (0xA0, 0x250), (0xA0, 0x250), (0x250, 0x2B0), (0x300, 0x370), (0x370, 0x530), (0x5D0, 0x700), (0x900, 0x980), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x2100, 0x2190), (0x3040, 0x3100), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0xFF00, 0xFFF0), (0x1F300, 0x1F650)]
    texts = []
    for _ in range(50_000):
        own = rng.sample(blocks, 2)
        texts.append("".join(chr(rng.randrange(*rng.choice(own))) if rng.random() < 0.8 else rng.choice(" \n\t'sT9") for _ in range(rng.randrange(1, 30))))
    assert differing(texts) == []
