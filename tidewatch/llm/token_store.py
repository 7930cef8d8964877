"""Token ids in a content-addressed store.

Format. A document's ids (little-endian integers, 2 or 4 bytes by vocabulary size) are cut into
chunks where a rolling hash over the last 16 ids meets a pattern, so equal passages give equal
chunks wherever they stand. A chunk's address is its BLAKE2b-128 digest. The store is a table of a
row per document, its files in ascending doc_id order:

* the recipe: the addresses and sizes of its chunks, the Merkle root over the addresses, its start
  (ids of all documents before it) and its number of ids,
* the pack: the chunks that the document is the first to hold (zstd).

Each distinct chunk is stored once. Reading fetches the chunks of other documents by address,
then checks every address and root.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import stored, text_of

#: Ids in the rolling window, in the shortest chunk, between chance cuts on average, and in the longest chunk.
WINDOW, LEAST, MEAN, MOST = 16, 64, 256, 2048
#: Fixed value: how the byte-level tokenizer parts a text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Anything but Latin letters, their marks and signs, and common punctuation.
FOREIGN = re.compile("[^\0-\u024f\u2010-\u2027\u20ac]")


class Encoder:
    """Ids of texts as the tokenizers library gives them, as bytes.

    A byte-level vocabulary in which each merge makes the next id can also be read as ranks of byte strings; then a faster
    library merges the same pairs in the same order (a pair whose joint string has the least rank is just the pair that the merge
    list names: the merges inside it, all of lower rank, are done, and none crossed its ends). It serves texts of Latin letters,
    for which both libraries know the same classes of characters. All other texts, and those with special tokens in
    them, go to the tokenizers library itself, as do all where the file describes another kind of tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width, self.letter = (2, "H") if self.library.get_vocab_size() <= 1 << 16 else (4, "I")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = byte_ranks(spec)
        self.merge = None
        if ranks is not None:
            import tiktoken

            self.merge = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def pack(self, ids: list[int]) -> bytes:
        return array(self.letter, ids).tobytes()

    def plain(self, text: str) -> bool:
        return (text.isascii() or not FOREIGN.search(text)) and not any(t in text for t in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        kind, out, rest = f"<u{self.width}", [b""] * len(texts), []
        for i, text in enumerate(texts):
            try:
                if self.merge is None or not self.plain(text):
                    rest.append(i)
                else:
                    out[i] = self.merge.encode_to_numpy(text, disallowed_special=()).astype(kind).tobytes()
            except ValueError:  # white space without end, which the pattern can't hold
                rest.append(i)
        for i, found in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = self.pack(found.ids)
        return out


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of the byte strings of a byte-level tokenizer file; None if its merges don't make the ids in order, or it is of another kind."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if model["type"] != "BPE" or any(model.get(x) for x in odd) or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    byte_of = {chr(symbol): byte for byte, symbol in byte_symbols().items()}
    joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    added = {t["content"] for t in spec["added_tokens"]}
    if [model["vocab"].get(t) for t in joined] != list(range(256, 256 + len(joined))) or len(model["vocab"].keys() - added) != 256 + len(joined):
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def rolling(ids):
    """For each position a polynomial hash of the last WINDOW ids, by doubling."""
    import numpy as np

    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    base, step = 0xBF58476D1CE4E5B9, 1
    while step < WINDOW:
        older = h[:-step] * np.uint64(pow(base, step, 1 << 64))
        h = h.copy()
        h[step:] += older
        step *= 2
    return h >> np.uint64(40)


def cuts(candidates, n: int) -> list[int]:
    """Ends of the chunks of ``n`` ids, from the ascending ends that the hash proposes."""
    ends, last = [], 0
    for end in [*candidates, n]:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end == n or end - last >= LEAST:
            last = int(end)
            ends.append(last)
    return ends if ends and ends[-1] == n else [*ends, n]


def merkle(addresses: list[bytes]) -> bytes:
    """Root of the binary hash tree over chunk addresses; a lone node moves up as it is."""
    level = list(addresses) or [b""]
    while len(level) > 1:
        level = [blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return blake2b(level[0], digest_size=16).digest()


def address(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=16).digest()


SPOOL = "doc_id bigint, uid bigint, n_tokens bigint, addresses array<binary>, sizes array<int>, payload binary"


def spool(docs: DataFrame, path: str, end_id: int, column: str = "text") -> DataFrame:
    """A row per document: its ids cut into chunks, their addresses and byte sizes, and the ids as bytes (zstd)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), text_of(docs, column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        own, zstd = encoder(path), zstandard.ZstdCompressor(level=3)
        width, kind, end = own.width, np.dtype(f"<u{own.width}"), own.pack([end_id])
        for part in sliced(batches, 250):
            found = [x + end for x in own.encode(part.column(2).to_pylist())]
            joined = np.frombuffer(b"".join(found), kind)
            hits = np.flatnonzero((rolling(joined) & np.uint64(MEAN - 1)) == 0) + 1
            begin, addresses, sizes = 0, [], []
            for blob in found:
                n = len(blob) // width
                lo, hi = np.searchsorted(hits, (begin + LEAST, begin + n))
                ends = cuts((hits[lo:hi] - begin).tolist(), n)
                starts = [0, *ends[:-1]]
                addresses.append([address(blob[a * width : b * width]) for a, b in zip(starts, ends, strict=True)])
                sizes.append([(b - a) * width for a, b in zip(starts, ends, strict=True)])
                begin += n
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(x) // width for x in found], pa.int64()), pa.array(addresses, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())), pa.array([zstd.compress(x) for x in found], pa.binary())],
                names=["doc_id", "uid", "n_tokens", "addresses", "sizes", "payload"],
            )

    return rows.mapInArrow(run, SPOOL)


@dataclass
class Store:
    """``packs``: a row per document with recipe and own chunks; ``theirs`` and ``lends`` are the positions of the chunks that another
    document holds for it, and of those that it holds for others. ``borrowed``: (uid, pos, address) of the chunks held by others."""

    packs: DataFrame
    borrowed: DataFrame
    width: int


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, which bound what becomes Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def delete(spark: SparkSession, df: DataFrame) -> None:
    """Drop the files of a table that ``stored`` wrote and that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


PACKS = "part int, doc_id bigint, uid bigint, local bigint, n_tokens bigint, root binary, addresses array<binary>, sizes array<int>, theirs array<int>, lends array<int>, payload binary"


def write(docs: DataFrame, path: str, end_id: int = 2, column: str = "text") -> Store:
    """Encode ``docs`` (doc_id and a text column; others are left out) and write the store into the shared folder.

    A null text counts as empty, an empty text has the end id alone, a very long text is cut into chunks like others. Rows that share a doc_id
    are documents of their own; they and null doc_ids (first) keep a fixed order. An empty table gives an empty store.

    Payloads travel once: a shuffle by doc_id range brings each document to its place in the files, and with it, as a row
    sorted just before it, the positions of the chunks that it shares. All other shuffles carry addresses and numbers alone.
    """
    spark = docs.sparkSession
    rows = stored(spool(docs, path, end_id, column), "spool")
    width = encoder(path).width
    refs = rows.select("doc_id", "uid", F.posexplode("addresses").alias("pos", "address"))
    # Addresses of several places: the first by (uid, pos) owns the chunk. Counts combine before the shuffle.
    shared = stored(refs.groupBy("address").agg(F.min(F.struct("uid", "pos", "doc_id")).alias("owner"), F.count("*").alias("n")).where("n > 1").select("address", "owner"), "shared")
    borrowed = stored(refs.join(shared, "address").where(F.struct("uid", "pos") != F.struct("owner.uid", "owner.pos")).select("doc_id", "uid", "pos", "address"), "borrowed")
    places = borrowed.select("doc_id", "uid", "pos", F.lit(True).alias("theirs")).unionByName(shared.select("owner.doc_id", "owner.uid", "owner.pos", F.lit(False).alias("theirs")))
    sides = places.groupBy("doc_id", "uid").agg(*(F.sort_array(F.collect_list(F.when(F.col("theirs") == k, F.col("pos")))).alias(name) for name, k in (("theirs", True), ("lends", False))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        held = ([], [])
        for batch in sliced(batches):
            kinds, theirs, lends = (batch.column(name).to_pylist() for name in ("kind", "theirs", "lends"))
            kept, found, payloads = [], [], {}
            for row, kind in enumerate(kinds):
                if not kind:  # what the next row shares
                    held = theirs[row], lends[row]
                    continue
                if held[0]:
                    blob, at, mine, taken = unpack.decompress(batch.column("payload")[row].as_py()), 0, [], set(held[0])
                    for pos, size in enumerate(batch.column("sizes")[row].as_py()):
                        if pos not in taken:
                            mine.append(blob[at : at + size])
                        at += size
                    payloads[len(kept)] = pack.compress(b"".join(mine))
                kept.append(row)
                found.append(held)
                held = ([], [])
            if not kept:
                continue
            own = batch.take(pa.array(kept, pa.int64())) if len(kept) < batch.num_rows else batch
            payload = own.column("payload")
            if payloads:
                payload = pa.array([payloads.get(i, x) for i, x in enumerate(payload.to_pylist())], pa.binary())
            local, counts = [], own.column("n_tokens").to_pylist()
            for n in counts:
                local.append(before)
                before += n
            roots = [merkle(a) for a in own.column("addresses").to_pylist()]
            positions = [pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in (0, 1)]
            columns = [pa.array([part] * len(kept), pa.int32()), own.column("doc_id"), own.column("uid"), pa.array(local, pa.int64()), own.column("n_tokens"), pa.array(roots, pa.binary()), own.column("addresses"), own.column("sizes"), *positions, payload]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "uid", "local", "n_tokens", "root", "addresses", "sizes", "theirs", "lends", "payload"])

    both = rows.withColumn("kind", F.lit(1)).unionByName(sides.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    packs = stored(both.repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid", "kind").mapInArrow(placed, PACKS), "packs")
    for used in (rows, shared):
        delete(spark, used)
    # A row per part of the files: its ids, and those of all parts before it.
    ends = packs.groupBy("part").agg(F.max(F.col("local") + F.col("n_tokens")).alias("ids"))
    before, offsets = 0, []
    for part, ids in sorted(ends.collect()):
        offsets.append((part, before))
        before += ids
    starts = spark.createDataFrame(offsets, "part int, before bigint")
    packs = packs.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.col("local")).drop("part", "before", "local")
    return Store(packs, borrowed.drop("doc_id"), width)


def rebuilt(store: Store, make, name: str, kind: str, made: pa.DataType) -> DataFrame:
    """doc_id, start, n_tokens and ``name`` (of the type ``kind``, in Arrow ``made``): ``make`` of the ids (bytes, little-endian) of each document, rebuilt from the store.

    A chunk that doesn't hash to its address, or a document whose chunks don't give the root in its recipe, fails the job.
    Documents that borrow no chunk are rebuilt where they lie.
    """

    def lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            found, chunks = [], []
            for addresses, sizes, theirs, lends, payload in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                blob, at, theirs, lends = unpack.decompress(payload), 0, set(theirs), set(lends)
                for pos, size in enumerate(sizes):
                    if pos not in theirs:
                        if pos in lends:
                            found.append(addresses[pos])
                            chunks.append(blob[at : at + size])
                        at += size
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(chunks, pa.binary())], names=["address", "chunk"])

    lenders = store.packs.where(F.size("lends") > 0).select("addresses", "sizes", "theirs", "lends", "payload")
    fetched = store.borrowed.join(lenders.mapInArrow(lent, "address binary, chunk binary"), "address")
    fetched = fetched.groupBy("uid").agg(F.collect_list(F.struct("pos", "chunk")).alias("fetched"))
    columns = ["doc_id", "start", "n_tokens", "root", "addresses", "sizes", "payload", "fetched"]
    alone = store.packs.where(F.size("theirs") == 0).withColumn("fetched", F.lit(None).cast("array<struct<pos:int,chunk:binary>>")).select(columns)
    mixed = store.packs.where(F.size("theirs") > 0).join(fetched, "uid", "left").select(columns)
    width = store.width

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            out = []
            for n, root, addresses, sizes, payload, fetched in zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True):
                blob, at, parts, got = unpack.decompress(payload), 0, [], {x["pos"]: x["chunk"] for x in fetched or ()}
                for pos, size in enumerate(sizes):
                    if pos in got:
                        parts.append(got[pos])
                    else:
                        parts.append(blob[at : at + size])
                        at += size
                found = [address(x) for x in parts]
                whole = b"".join(parts)
                if found != addresses or len(whole) != n * width or merkle(found) != root:
                    raise ValueError("the store doesn't give back a document: its chunks differ from its recipe")
                out.append(make(whole))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, made)], names=["doc_id", "start", "n_tokens", name])

    return alone.unionByName(mixed).mapInArrow(rebuild, f"doc_id bigint, start bigint, n_tokens bigint, {name} {kind}")


def read(store: Store) -> DataFrame:
    """doc_id, start, n_tokens and ``ids`` (bytes, little-endian) of each document, rebuilt from the store and checked."""
    return rebuilt(store, bytes, "ids", "binary", pa.binary())


def digest(store: Store) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers, of the documents as they are read back."""
    width = store.width

    def crc(ids: bytes) -> int:
        import numpy as np

        return zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())

    return rebuilt(store, crc, "ids_crc32", "bigint", pa.int64())
