"""Alignment of two tokenizers' tokens over the same bytes, by pointer jumping.

Both token sequences of a text cover the same bytes. Every token points to the farthest-right token of the other
sequence that overlaps it, as long as that one reaches as far as itself or farther; the token that ends where its counterpart
ends points to itself. Doubling (a token's pointer becomes its pointer's pointer) takes all tokens of a component to
its terminal token in as many rounds as the logarithm of the longest chain, for all texts of a slice at once. The terminal labels the group.

Links are the pairs of tokens in a group. How many documents hold a pair of ids linked is counted over the corpus: texts are worked on in blocks
of bounded size, a block states each of its id pairs once, and the counts come back to the block, so no shuffle carries a row per document and pair.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_store
from .bpe import byte_symbols
from .common import stored, text_of

#: Bytes of text that are aligned together, and that make a block; a longer text is a block of its own. Pairs that are made at once.
SLICE_BYTES, BLOCK_BYTES, PAIRS = 2 << 20, 8 << 20, 4 << 20
#: A group of more links counts its ids before it pairs them.
FEW_LINKS = 256


class ByteTokens(token_store.Encoder):
    """Tokens of a byte-level file; strings of special tokens in a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        self.special = []
        byte_of = {chr(symbol): byte for byte, symbol in byte_symbols().items()}
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        found = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items()}
        self.tokens = [found.get(i, b"") for i in range(max(found) + 1)]

    def ids(self, texts: list[str]):
        import numpy as np

        return [np.frombuffer(x, f"<u{self.width}") for x in self.encode(texts)]


class PieceTokens:
    """Tokens of a sentence-piece model with byte fallback; it puts a space before each text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        self.tokens = [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.model.vocab_size())]

    def ids(self, texts: list[str]):
        import numpy as np

        return [np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]


class Aligner:
    """Both tokenizers and the tables of their tokens' bytes, byte lengths and decimal ids."""

    def __init__(self, path_a: str, path_b: str):
        import numpy as np

        self.sides = ByteTokens(path_a), PieceTokens(path_b)
        self.bytes_of = [pa.array(s.tokens, pa.large_binary()) for s in self.sides]
        self.length_of = [np.array([len(t) for t in s.tokens], np.int64) for s in self.sides]
        self.width = len(self.sides[1].tokens)
        most = max(len(s.tokens) for s in self.sides)
        #: At 4 i + k: id i in decimal, followed by a comma, a bar, a semicolon or nothing.
        self.written = pa.array([f"{i}{mark}".encode() for i in range(most) for mark in (",", "|", ";", "")], pa.large_binary())

    def covering(self, texts: list[str]):
        """Ids of both sides for each text; none for an empty text or where a side's bytes aren't the text's."""
        import numpy as np

        wanted = [b" " + t.encode() for t in texts]
        found = [s.ids([" " + t for t in texts] if k == 0 else texts) for k, s in enumerate(self.sides)]
        none = np.zeros(0, np.int64)
        for k, lists in enumerate(found):
            if spelled(self.bytes_of[k], np.concatenate([none, *lists])) == b"".join(wanted):
                continue
            for i, ids in enumerate(lists):
                if spelled(self.bytes_of[k], ids) != wanted[i]:
                    found[0][i] = found[1][i] = none
        for i, text in enumerate(texts):
            if not text:
                found[0][i] = found[1][i] = none
        return found


def spelled(table: pa.Array, ids) -> bytes:
    """The bytes of a table at ``ids``, joined."""
    taken = table.take(pa.array(ids))
    return b"" if not len(taken) else taken.buffers()[2].to_pybytes()[: _offsets(taken)[-1]]


def _offsets(taken: pa.Array):
    import numpy as np

    return np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]


def terminals(a_ends, b_ends):
    """For each token, those of A first: the index of its component's terminal token, one of A. Ends ascend and share the last."""
    import numpy as np

    n = len(a_ends)
    over_a, over_b = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)  # the counterpart that holds a token's last byte
    succ = np.concatenate([np.where(b_ends[over_a] > a_ends, n + over_a, np.arange(n)), over_b]) if n else np.zeros(0, np.int64)
    while not np.array_equal(jumped := succ[succ], succ):
        succ = jumped
    return succ


def summed(keys, values):
    """Distinct keys in ascending order and the sums of their values."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def linked(group_a, ids_a, group_b, ids_b, doc_of_group, width: int):
    """(doc << 32 | a * width + b) of all linked id pairs in ascending order, and how many links each has."""
    import numpy as np

    n = len(doc_of_group)
    sizes = np.bincount(group_a, minlength=n) * np.bincount(group_b, minlength=n)
    sides = []
    for group, ids in ((group_a, ids_a), (group_b, ids_b)):
        many = sizes[group] > FEW_LINKS
        keys, counts = summed(group[many] << 32 | ids[many], np.ones(many.sum(), np.int64))
        keys, counts = np.concatenate([group[~many] << 32 | ids[~many], keys]), np.concatenate([np.ones((~many).sum(), np.int64), counts])
        order = np.argsort(keys >> 32, kind="stable")
        sides.append((keys[order] >> 32, keys[order] & 0xFFFFFFFF, counts[order]))
    (ga, a, ca), (gb, b, cb) = sides
    in_b = np.bincount(gb, minlength=n)
    first_b = np.cumsum(in_b) - in_b
    reach = np.cumsum(in_b[ga])
    found, begin = [], 0
    while begin < len(a):  # each entry of A meets its group's entries of B
        end = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + PAIRS, "right")))
        times = in_b[ga[begin:end]]
        left = np.repeat(np.arange(begin, end), times)
        right = first_b[ga[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        found.append(summed(doc_of_group[ga[left]] << 32 | (a[left] * width + b[right]), ca[left] * cb[right]))
        begin = end
    if len(found) == 1:
        return found[0]
    return summed(np.concatenate([np.zeros(0, np.int64), *(x[0] for x in found)]), np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)]))


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(path_a, path_b)


def aligned(own: Aligner, texts: list[str]):
    """For the texts of a slice: n_a, n_b, n_groups, n_links, the groups' hash, and the pairs and links of ``linked`` with the text's number as doc."""
    import numpy as np

    found, none = own.covering(texts), [np.zeros(0, np.int64)]
    counts = [np.array([len(x) for x in lists], np.int64) for lists in found]
    ids = [np.concatenate(none + lists).astype(np.int64) for lists in found]
    ends = [np.cumsum(own.length_of[k][ids[k]]) for k in (0, 1)]
    n_a, n_b = len(ids[0]), len(ids[1])
    labels = terminals(*ends)
    last = np.zeros(n_a, np.int64)
    last[labels] = 1
    number = np.cumsum(last) - 1
    group_a, group_b = number[labels[:n_a]], number[labels[n_a:]]
    doc_of_group = np.repeat(np.arange(len(texts)), counts[0])[last == 1]
    n_groups = np.bincount(doc_of_group, minlength=len(texts))
    in_a, in_b = np.bincount(group_a, minlength=len(doc_of_group)), np.bincount(group_b, minlength=len(doc_of_group))
    before_group = np.concatenate([[0], np.cumsum(in_a * in_b)])
    doc_ends = np.concatenate([[0], np.cumsum(n_groups)])
    n_links = np.diff(before_group[doc_ends])
    # The groups as text: A's ids, a bar, B's ids, a semicolon; nothing after a document's last.
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    codes = np.zeros(n_a + n_b, np.int64)
    at_a, at_b = np.arange(n_a) + (upto_b - in_b)[group_a], np.arange(n_b) + upto_a[group_b]
    codes[at_a], codes[at_b] = ids[0] * 4, ids[1] * 4
    codes[(upto_a + upto_b - in_b) - 1] += 1
    codes[(upto_a + upto_b) - 1] += 2
    stops = np.concatenate([[0], np.cumsum(counts[0] + counts[1])])
    codes[stops[1:][counts[0] > 0] - 1] += 1
    taken = own.written.take(pa.array(codes))
    places, text = (_offsets(taken), memoryview(taken.buffers()[2])) if len(codes) else (np.zeros(1, np.int64), memoryview(b""))
    hashes = [sha256(text[places[stops[i]] : places[stops[i + 1]]]).hexdigest() if counts[0][i] else "" for i in range(len(texts))]
    return counts[0], counts[1], n_groups, n_links, hashes, *linked(group_a, ids[0], group_b, ids[1], doc_of_group, own.width)


SPOOL = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, at binary, links binary, pairs array<bigint>, held array<int>"


def spool(docs: DataFrame, path_a: str, path_b: str, column: str = "text") -> DataFrame:
    """A row per document with its own columns, and its id pairs as places in its block's list of pairs, with the links of each.

    A block's first row holds that list, and how many of its documents hold each pair.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs, column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        own, blocks = aligner(path_a, path_b), TaskContext.get().partitionId() << 33

        def block(parts) -> pa.RecordBatch:
            """Of the slices (doc_ids, what ``aligned`` gives)."""
            nonlocal blocks
            blocks += 1
            low = np.int64((1 << 32) - 1)
            pairs, place = np.unique(np.concatenate([p[1][5] & low for p in parts]), return_inverse=True)
            held = np.bincount(place, minlength=len(pairs))
            at, links, begin = [], [], 0
            for doc_ids, (*_, keys, times) in parts:
                stops = np.searchsorted(keys >> 32, np.arange(len(doc_ids) + 1))
                for lo, hi in zip(stops, stops[1:], strict=False):
                    at.append(place[begin + lo : begin + hi].astype("<u4").tobytes())
                    links.append(times[lo:hi].astype("<u8").tobytes() if (times[lo:hi] > 1).any() else None)
                begin += len(keys)
            n = len(at)
            numbers = [pa.array(np.concatenate([p[1][k] for p in parts]), pa.int64()) for k in range(4)]
            first = [pa.array([x, *[None] * (n - 1)], pa.list_(t)) for x, t in ((pairs, pa.int64()), (held.astype(np.int32), pa.int32()))]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, blocks)), pa.array([x for p in parts for x in p[0]], pa.int64()), *numbers, pa.array([h for p in parts for h in p[1][4]]), pa.array(at, pa.binary()), pa.array(links, pa.binary()), *first],
                names=[c.split()[0] for c in SPOOL.split(", ")],
            )

        parts, ids, texts, slice_bytes, block_bytes = [], [], [], 0, 0
        for batch in token_store.sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if texts and slice_bytes + len(text) > SLICE_BYTES:
                    parts.append((ids, aligned(own, texts)))
                    block_bytes, ids, texts, slice_bytes = block_bytes + slice_bytes, [], [], 0
                    if block_bytes + len(text) > BLOCK_BYTES:
                        yield block(parts)
                        parts, block_bytes = [], 0
                ids.append(doc_id)
                texts.append(text)
                slice_bytes += len(text)
        if texts:
            parts.append((ids, aligned(own, texts)))
        if parts:
            yield block(parts)

    return rows.mapInArrow(run, SPOOL)


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def counted(rows: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(pair, n, best) of each id pair a * width + b: the documents that hold it linked, and whether no other pair of its id of A is in more."""
    width = aligner(path_a, path_b).width
    counts = rows.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n"))
    most = counts.groupBy(F.floor(F.col("pair") / width).alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.floor(F.col("pair") / width)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def report(docs: DataFrame, path_a: str, path_b: str, column: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document: tokens of space + text by the byte-level file
    ``path_a`` and of the text by the sentence-piece model ``path_b``.

    A text that is null, empty, or not given back byte for byte by both has no tokens: zeros, and an empty hash. A very long text is a block of its own. Rows that share a
    doc_id, null ids too, and repeated rows are documents of their own, each counted. An empty table gives no rows; other columns, whatever their names, are left out.
    """
    rows = stored(spool(docs, path_a, path_b, column), "aligned")
    counts = counted(rows, path_a, path_b)
    wanted = rows.where("pairs is not null").select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    back = wanted.join(counts, "pair").select("of", "pair", "n", "best")

    def digest(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        order = np.argsort(right["pair"].to_numpy())
        n, best = right["n"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        n_best, count_sum = [], []
        for at, links in zip(left["at"].to_pylist(), left["links"].to_pylist(), strict=True):
            places = np.frombuffer(at, "<u4")
            times = np.ones(len(places), np.int64) if links is None else np.frombuffer(links, "<i8")
            n_best.append(int((times * best[places]).sum()))
            count_sum.append(int((times * n[places]).sum()))
        own = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return own.add_column(5, "n_best", pa.array(n_best, pa.int64())).add_column(6, "count_sum", pa.array(count_sum, pa.int64()))

    return rows.drop("pairs", "held").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(digest, RESULT)
