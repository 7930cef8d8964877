"""BPE encoding and decoding by forced-boundary splitting.

A pair of characters that stands next to each other in no vocabulary token can never be
joined by a merge, nor by the merges that lead to one, since every merge yields a vocabulary
token. Such pairs mark certain cuts: a word splits at them into fragments that are encoded
independently, and the word's ids are the fragments' ids in order. Fragments and words recur
far more often than texts do, so each worker keeps a bounded memo of both.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of

#: Longest word that is remembered, and the most words or fragments in a memo.
MEMO_CHARS, MEMO_ENTRIES = 48, 300_000
#: Rows that are encoded or decoded at once.
SLICE = 256

#: Printable ASCII and small Latin letters with marks. Text that becomes this in lower case is composed, the normalizer makes the same of it, and words
#: part as below. Some capitals of this range have a small letter beyond it: such text is left to the library.
LATIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u024f]+|[0-9]|[^a-z0-9\u00c0-\u024f]+")


def byte_symbols() -> dict[int, int]:
    """The byte-level map: printable Latin-1 characters stand for their own byte, the other bytes for 256 and up, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {byte: byte if byte in own else next(rest) for byte in range(256)}


BYTE_SYMBOLS = byte_symbols()


class Memo(dict):
    """A dictionary that computes what it lacks and starts afresh beyond its bound."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[key] = value
        return value


def tokens_by_id(spec: dict) -> list[str]:
    found = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [found.get(i, "") for i in range(max(found) + 1)]


@lru_cache(maxsize=4)
def token_list(path: str) -> list[str]:
    with open(path, encoding="utf-8") as file:
        return tokens_by_id(json.load(file))


class Codec:
    """Encoder and decoder of one tokenizer file whose pre-tokenizer drops white space and whose words carry an end suffix."""

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        library = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.suffix, self.vocab = model["end_of_word_suffix"] or "", model["vocab"]
        self.ranks = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[left, right] = rank
        plain = [t.removesuffix(self.suffix) if self.suffix else t for t in self.vocab]
        #: Pairs of neighbours inside a vocabulary token: all other pairs force a cut.
        self.joined = {t[i : i + 2] for t in plain for i in range(len(t) - 1)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added, self.added_split = added, re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.tokens = tokens_by_id(spec)
        self.dtype = np.uint16 if len(self.tokens) <= 1 << 16 else np.uint32
        self.letter = "H" if self.dtype is np.uint16 else "I"
        self.fragments = Memo(self._fragment)
        self.pieces = Memo(self._piece)

    def cuts(self, word: str) -> list[str]:
        """The fragments of a word."""
        joined = self.joined
        if joined.issuperset(map(add, word, word[1:])):
            return [word]
        starts = [0, *(i for i, pair in enumerate(map(add, word, word[1:]), 1) if pair not in joined), len(word)]
        return [word[a:b] for a, b in zip(starts, starts[1:], strict=False)]

    def _fragment(self, fragment: str) -> tuple[int, ...]:
        """Ids of a fragment; the end of a word is marked by a trailing line feed, which no byte-level symbol is."""
        symbols = list(fragment)
        if symbols[-1] == "\n":
            symbols.pop()
            symbols[-1] += self.suffix
        symbols = self._merge_few(symbols) if len(symbols) < 50 else self._merge_many(symbols)
        return tuple(self.vocab[s] for s in symbols if s in self.vocab)

    def _merge_few(self, symbols: list[str]) -> list[str]:
        rank, never = self.ranks.get, 1 << 60
        ranks = [rank(pair, never) for pair in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) != never:
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((symbols[at - 1], symbols[at]), never)
            if at < len(ranks):
                ranks[at] = rank((symbols[at], symbols[at + 1]), never)
        return symbols

    def _merge_many(self, symbols: list[str]) -> list[str]:
        """The same merges by a heap over linked neighbours, for fragments of any length."""
        n, rank = len(symbols), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return [s for s in symbols if s]

    def _piece(self, piece: str) -> bytes:
        """Ids, as bytes, of a run of text between blanks."""
        ids: list[int] = []
        small = piece.lower()
        if LATIN.fullmatch(small) and not (self.added_split and self.added_split.search(piece)):
            for word in LATIN_WORDS.findall(small):
                ids += self._word(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_SYMBOLS))
            return self._pack(ids)
        for part in self.added_split.split(piece) if self.added_split else [piece]:
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                for word, _ in self.pre_tokenize(self.normalize(part)):
                    ids += self._word(word)
        return self._pack(ids)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _word(self, word: str) -> list[int]:
        cut = self.cuts(word)
        cut[-1] += "\n"
        return [i for fragment in cut for i in self.fragments[fragment]]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian integers. Words never span blanks, so blanks part the text."""
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in parts of SLICE rows, so that what is made of it is held, here and by Spark that reads it, for so many rows at most."""
    for lo in range(0, len(texts), SLICE):
        yield texts.slice(lo, SLICE)


def _encoded(own: Codec, texts: pa.Array) -> pa.ListArray:
    import numpy as np

    width = np.dtype(own.dtype).itemsize
    rows = [own.encode(t) for t in texts.to_pylist()]
    values = np.frombuffer(b"".join(rows), own.dtype).astype(np.int32)
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) // width for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _decoded(tokens: pa.Array, lists: pa.ListArray) -> pa.Array:
    import pyarrow.compute as pc

    words = pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), tokens.take(lists.flatten()))
    return pc.binary_join(words, " ")


def encode(docs: DataFrame, path: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids`` (array of int), in place of any column of that name.

    A null or empty text has an empty array, a very long text one of all its ids. Rows are encoded one by one: repeated rows get equal arrays, other columns
    stay as they are, whatever their names, and an empty table stays empty with the new column.
    """
    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for batch in batches:
            for texts in slices(batch):
                yield _encoded(own, texts)

    return docs.withColumn(ids, encoded(text_of(docs, column)))


def decode(docs: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``docs`` with the decoded text: the tokens, joined by one space as a tokenizer without a decoder does; null or no ids give an empty text.

    Very long lists are decoded whole, repeated rows alike, other columns stay, and an empty table stays empty with the new column.
    """
    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = pa.array(token_list(path))
        for batch in batches:
            for lists in slices(batch):
                yield _decoded(tokens, lists)

    return docs.withColumn(column, decoded(F.coalesce(docs[ids], F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, path: str, column: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with what ``encode`` and then ``decode`` add, both made in one Python worker a task: two would hold the tokenizer twice and send the ids to and fro."""

    @F.arrow_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        tokens = pa.array(own.tokens)
        for batch in batches:
            for texts in slices(batch):
                lists = _encoded(own, texts)
                yield pa.StructArray.from_arrays([lists, _decoded(tokens, lists)], names=["ids", "decoded"])

    found = fresh(docs, "_found")
    rows = docs.withColumn(found, both(text_of(docs, column)))
    return rows.withColumns({ids: rows[found]["ids"], decoded: rows[found]["decoded"]}).drop(found)
