"""Mixing sources to target weights by blocks.

The words of a source, its documents in a fixed pseudorandom order, are packed into blocks of a
fixed number of words. Output slots are grouped into shards; each shard draws how many of its slots
each source gets: a multinomial draw, given that the shards together meet each source's total (see
``dealt``). Slot j of a source takes block ``perm(j mod blocks)``, ``perm`` being a keyed
pseudorandom permutation of the source's block indices, so a block is taken again only after all
others of its source. Slots and blocks join by (source, block index).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, stored, text_of, words

#: Weights dealt to the sources in order, repeating; and how often a source may be taken.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents that are cut at once.
SLICE = 256


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float
    blocks: int


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: int = MOST) -> list[float]:
    """Word targets of sources (name, size) in order: shares of all words by weight, a source's never above ``most`` times its size,
    what it can't take shared again by weight."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    room, left, full = set(range(len(sizes))), float(sum(n for _, n in sizes)), {}
    while room:
        unit = left / sum(weight[i] for i in room)
        over = {i for i in room if weight[i] * unit > most * sizes[i][1]}
        if not over:
            return [float(full[i]) if i in full else weight[i] * unit for i in range(len(sizes))]
        for i in over:
            full[i] = most * sizes[i][1]
            left -= full[i]
        room -= over
    return [float(full.get(i, 0)) for i in range(len(sizes))]


def permuted(index, n, key, rounds: int = 4):
    """Pseudorandom permutation of 0..n-1 at each of ``index``: a Feistel network over the next even power of two, walked until inside.

    ``n`` and ``key`` are numbers, or arrays with a value for each index.
    """
    import numpy as np

    x, n, key = np.broadcast_arrays(np.asarray(index, np.uint64), np.asarray(n, np.uint64), np.asarray(key, np.uint64))
    bits = np.frexp(np.maximum(n, 2).astype(np.float64) - 1)[1]
    shift = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << shift) - np.uint64(1)

    def once(x, shift, mask, key):
        left, right = x >> shift, x & mask
        for r in range(rounds):
            mixed = (right ^ (key * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r * 0xD1B54A32D192ED03 + 1) & (2**64 - 1)))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0x94D049BB133111EB)
            left, right = right, (left ^ (mixed >> np.uint64(40))) & mask
        return (left << shift) | right

    x = once(x, shift, mask, key)
    while len(outside := np.flatnonzero(x >= n)):
        x[outside] = once(x[outside], shift[outside], mask[outside], key[outside])
    return x.astype(np.int64)


def drawn_half(counts, n: int, seed: list[int]):
    """How many of each kind are among ``n`` drawn from ``counts`` without putting back: multivariate hypergeometric, a kind at a time.

    From 10^9 up, beyond what the library draws, a normal of the same mean and variance stands for it, held to what is possible.
    """
    import numpy as np

    rng, out, left, want = np.random.default_rng(seed), np.zeros(len(counts), np.int64), int(counts.sum()), n
    for i, c in enumerate(counts.tolist()):
        others = left - c
        if max(c, others) < 10**9:
            k = int(rng.hypergeometric(c, others, want))
        else:
            mean = want * c / left
            k = round(rng.normal(mean, (mean * others / left * (left - want) / (left - 1)) ** 0.5))
            k = min(max(k, 0, want - others), c, want)
        out[i], left, want = k, others, want - k
    return out


def dealt(totals, width: int, a: int, b: int, seed: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(shard, slots of each source in it, slots of each source in all shards before it) of the shards ``a`` to ``b`` - 1.

    The slots of all shards are ``totals`` by source; a shard has ``width`` of them, the last the rest. Independent multinomial draws by
    shard, given their totals, are draws without putting back; those part by halves: how many of a source lie in the first
    half of the shards is drawn with a seed that the halves name, then each half parts alike. So any shard's counts, and the sums before it,
    follow from log(shards) draws, in any task, without a pass over the other shards.
    """
    import numpy as np

    def down(lo: int, hi: int, counts, before):
        if hi <= a or lo >= b:
            return
        if hi - lo == 1:
            yield lo, counts, before
            return
        mid = (lo + hi) // 2
        first = drawn_half(counts, (mid - lo) * width, [seed, lo, hi])
        yield from down(lo, mid, first, before)
        yield from down(mid, hi, counts - first, before + first)

    counts = np.asarray(totals, np.int64)
    yield from down(0, -(-int(counts.sum()) // width), counts, np.zeros_like(counts))


@dataclass
class Mix:
    """``docs``: the input with uid, size, source number and word offset in its source; ``times``: how often each (source number, block) is taken."""

    docs: DataFrame
    times: DataFrame
    sources: list[Source]
    block: int


def mix(docs: DataFrame, column: str = "text", block: int = 32, shard_slots: int = 1024, seed: int = 17, weights=WEIGHTS, most: int = MOST, bucket_rows: int = 4096, uid: str | None = None) -> Mix:
    """Plan the mix of ``docs`` (doc_id, source and a text column; other columns are left out).

    ``uid`` names a column of ``docs`` that numbers its rows, for callers that join the plan to them: it must be written, as numbers
    made anew in another scan can differ. Without it, rows are numbered here.

    A null text has size 0 and a document without words is never taken. The null source comes last and is a source like
    any other. Repeated rows are documents of their own; which of two equal rows is which makes no difference. A very long text is a number of
    words like others. An empty table gives an empty plan. The plan depends on the rows alone, not on their order or partitioning,
    so reruns agree. The table of sources, a row each, is all that comes to the driver.
    """
    spark = docs.sparkSession
    text = text_of(docs, column)
    rows = docs.select("doc_id", "source", F.size(words(text)).cast("long").alias("_size"), F.xxhash64(docs["doc_id"], text).alias("_h"), F.xxhash64(text).alias("_t"), (docs[uid] if uid else F.monotonically_increasing_id()).alias("_uid"))
    slim = stored(rows.select("doc_id", "source", "_size", "_h", "_t", "_uid"), "sizes")
    per = slim.groupBy("source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).collect()
    per.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    wanted = targets([(r["source"], r["size"]) for r in per], weights, most)
    sources = [Source(r["source"], r["size"], t, -(-r["size"] // block)) for r, t in zip(per, wanted, strict=True)]
    numbers = spark.createDataFrame([(i, s.name) for i, s in enumerate(sources)], "_s int, _name string")
    slim = slim.join(numbers, slim["source"].eqNullSafe(numbers["_name"])).drop("_name")

    # Offsets in two steps: sums of (source, bucket), then a running sum within each bucket, which stays small even for a hot source.
    buckets = max(1, sum(r["n"] for r in per) // bucket_rows)
    slim = slim.withColumn("_b", F.pmod("_h", F.lit(buckets)))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = slim.groupBy("_s", "_b").agg(F.sum("_size").alias("n")).select("_s", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "_t", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(sums, ["_s", "_b"]).withColumn("_at", F.col("_base") + F.col("_in")).drop("_base", "_in", "_b", "_h", "_t")
    placed = stored(placed, "placed")

    # Slots by source: words wanted over the mean words of a block of it; most is the cap on how often a block is taken.
    blocks = [s.blocks for s in sources]
    totals = [min(round(s.target * s.blocks / s.size), most * s.blocks) if s.size else 0 for s in sources]
    shards = -(-sum(totals) // shard_slots)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = np.array(blocks, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids = batch.column(0).slice(at, 64)
                rows = [x for _, *x in dealt(totals, shard_slots, ids[0].as_py(), ids[-1].as_py() + 1, seed)]
                n, first = (np.concatenate(x) for x in zip(*rows, strict=True))
                s = np.repeat(np.tile(np.arange(len(own)), len(rows)), n)
                j = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(permuted(j % own[s], own[s], seed * 1_000_003 + s))], names=["_s", "block"])

    taken = spark.range(shards).mapInArrow(take, "_s int, block bigint")
    times = stored(taken.groupBy("_s", "block").agg(F.count("*").alias("times")), "slots")
    return Mix(placed, times, sources, block)


def _pieces(plan: Mix) -> DataFrame:
    """(uid, first word in the document, words, times) of each piece of a document that lies in a taken block."""
    at, size, b = F.col("_at"), F.col("_size"), F.lit(plan.block)
    parts = plan.docs.where("_size > 0").select("_uid", "_s", "_at", "_size", F.explode(F.sequence(F.floor(at / b), F.floor((at + size - 1) / b))).alias("block"))
    start = F.greatest(F.col("block") * b, at) - at
    end = F.least((F.col("block") + 1) * b, at + size) - at
    return parts.join(plan.times, ["_s", "block"]).select("_uid", start.alias("start"), (end - start).alias("n"), "times")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target of its source and ``taken`` (words the mix takes from it, repeats counted) for each document.

    Nulls, empty and very long texts, repeated rows and other columns are as in ``mix``; an empty table gives no rows.
    """
    plan = mix(docs.select("doc_id", "source", options.get("column", "text")), **options)
    spark = docs.sparkSession
    sums = _pieces(plan).groupBy("_uid").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    per = spark.createDataFrame([(i, s.size, s.target) for i, s in enumerate(plan.sources)], "_s int, source_size long, target double")
    return plan.docs.join(per, "_s").join(sums, "_uid", "left").select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, column: str = "text", **options) -> DataFrame:
    """What the mix takes, as documents with the columns of ``docs``: for each document and pass a row with the words taken in that pass.

    A document that a pass takes as a whole keeps its text as it is; else the taken stretches follow each other, white space included.
    ``n_chars``, if there, is the length of the new text. Null and empty texts are never taken; an empty table gives no rows; repeated rows are
    documents of their own; other columns stay, whatever their names.
    """
    uid, parts = fresh(docs, "_uid"), fresh(docs, "pieces")
    # The plan and the cut below scan the rows apart; one written number serves both.
    keyed = stored(docs.withColumn(uid, F.monotonically_increasing_id()), "mixing")
    plan = mix(keyed, column, uid=uid, **options)
    pieces = _pieces(plan).groupBy(F.col("_uid").alias(uid)).agg(F.sort_array(F.collect_list(F.struct("start", "n", "times"))).alias(parts))
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*")
        for batch in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            rows, texts = [], []
            for row, (text, pieces) in enumerate(zip(batch.column(column).to_pylist(), batch.column(parts).to_pylist(), strict=True)):
                found = None
                for done in range(max(p["times"] for p in pieces)):
                    mine = [p for p in pieces if p["times"] > done]
                    found = found or word.findall(text)
                    whole = sum(p["n"] for p in mine) == len(found)
                    rows.append(row)
                    texts.append(text if whole else "".join("".join(found[p["start"] : p["start"] + p["n"]]) for p in mine))
            kept = batch.take(pa.array(rows, pa.int64()))
            columns = [pa.array(texts, pa.string()) if name == column else pa.array([len(t) for t in texts], kept.column(name).type) if name == "n_chars" else kept.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return keyed.join(pieces, uid).drop(uid).mapInArrow(cut, docs.schema)
