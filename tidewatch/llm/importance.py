"""Importance resampling toward a target distribution over hashed n-grams.

Every n-gram falls into a bucket by the CRC-32 of its bytes. A document is scanned once: its words are
joined by one space, and the running CRC is kept at each word's end. The CRC of any n-gram then follows from two
of these prefixes, since crc(A + B) is crc(B) plus, over GF(2), crc(A) moved on by the length of B, and moving a CRC
over n zero bytes is a linear map: the product of the maps for the powers of two in n.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_of
from .token_store import delete, sliced

#: Bytes of words: digits, small letters, and all of other scripts; capitals A-Z become small, all else parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
POLYNOMIAL = 0xEDB88320  # of CRC-32, reflected
#: Documents, and bytes of text, that are worked on together.
SLICE_ROWS, SLICE_BYTES = 500, 4 << 20


@lru_cache(maxsize=1)
def byte_table():
    """Step of the CRC register for each byte value."""
    import numpy as np

    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


@lru_cache(maxsize=32)
def shift_tables(k: int):
    """Four tables of 256: what each byte of a CRC becomes after 2^k zero bytes; the CRC's image is the sum over GF(2)."""
    import numpy as np

    if k == 0:
        alone = np.arange(256, dtype=np.uint32)
        parts = [alone << np.uint32(8 * i) for i in range(4)]
        return [(c >> np.uint32(8)) ^ byte_table()[c & np.uint32(255)] for c in parts]
    half = shift_tables(k - 1)
    return [_apply(half, t) for t in half]


def _apply(tables, crcs):
    import numpy as np

    return tables[0][crcs & np.uint32(255)] ^ tables[1][(crcs >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(crcs >> np.uint32(16)) & np.uint32(255)] ^ tables[3][crcs >> np.uint32(24)]


def shifted(crcs, lengths):
    """CRCs moved on over as many zero bytes as ``lengths`` says, element by element."""
    import numpy as np

    out, k = crcs.copy(), 0
    while len(lengths) and (lengths >> k).any():
        at = np.flatnonzero((lengths >> k) & 1)
        if len(at):
            out[at] = _apply(shift_tables(k), out[at])
        k += 1
    return out


def ngram_crcs(texts: list[bytes], longest: int):
    """Words of each text, and the CRCs of its n-grams of 1 to ``longest`` words as a list of arrays by text.

    The texts are scanned as one run of words, joined by a space; n-grams across two texts are left out. The prefix before a
    word is the one at the end of the word before it, moved on by the space.
    """
    import numpy as np

    words = [t.translate(WORD_BYTES).split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = [w for part in words for w in part]
    if not flat:
        return counts, [np.zeros(0, np.uint32) for _ in texts]
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    scan = zlib.crc32
    pieces = iter(flat)
    ends = np.fromiter(accumulate(pieces, lambda crc, word: scan(word, scan(b" ", crc)), initial=scan(next(pieces))), np.uint32, len(flat))
    # The prefix before each word: the empty one first, then each word's end and a space.
    inner = ~ends[:-1]
    starts = np.concatenate([np.zeros(1, np.uint32), ~((inner >> np.uint32(8)) ^ byte_table()[(inner ^ np.uint32(32)) & np.uint32(255)])])
    stops = np.cumsum(lengths + 1) - 1
    firsts = np.cumsum(counts) - counts
    left = np.repeat(firsts + counts, counts) - np.arange(len(flat))  # words from here to the text's end
    grams, owners = [], []
    owner = np.repeat(np.arange(len(texts)), counts)
    for n in range(1, longest + 1):
        at = np.flatnonzero(left >= n)
        span = stops[at + n - 1] - stops[at] + lengths[at]
        grams.append(ends[at + n - 1] ^ shifted(starts[at], span))
        owners.append(owner[at])
    order = np.argsort(np.concatenate(owners), kind="stable")
    per_text = np.sum([np.maximum(counts - n + 1, 0) for n in range(1, longest + 1)], axis=0)
    return counts, np.split(np.concatenate(grams)[order], np.cumsum(per_text)[:-1])


def _bounded(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most SLICE_BYTES of text, or of one row."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    begin = held = 0
    for row, size in enumerate(sizes):
        if row > begin and held + size > SLICE_BYTES:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def hashed(docs: DataFrame, id_column: str | None = "doc_id", column: str = "text", longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features and the buckets of a text's n-grams (little-endian, 2 bytes each, or 4 beyond 65,536 buckets). Without an id column ids are null."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in sliced(batches, SLICE_ROWS):
            for part in _bounded(batch, 1):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                counts, grams = ngram_crcs(texts, longest)
                found = [(g % np.uint32(buckets)).astype(kind) for g in grams]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())],
                    names=["doc_id", "n_words", "n_features", "buckets"],
                )

    own = docs[id_column] if id_column else F.lit(None)
    rows = docs.select(own.cast("long").alias("doc_id"), text_of(docs, column).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int = 10_000) -> list[int]:
    """Features of all ``rows`` in each bucket; each task sends at most one sum a bucket, so ``buckets`` rows come to the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches, SLICE_ROWS):
            for blob in batch.column(0):
                total += np.bincount(np.frombuffer(blob.as_buffer(), kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    counts = [0] * buckets
    for bucket, n in rows.where("n_features > 0").select("buckets").mapInArrow(tally, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(target share / source share)) of each bucket, one feature added to each bucket on both sides."""
    s_all, t_all, buckets = sum(source), sum(target), len(source)
    return [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(source, target, strict=True)]


def weighted(rows: DataFrame, gains: list[int]) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean gain of a document's features, 0 if it has none."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        gain = np.array(gains, np.int64)
        for batch in sliced(batches, SLICE_ROWS):
            sums = [int(gain[np.frombuffer(blob.as_buffer(), kind)].sum()) for blob in batch.column(3)]
            weights = [x // n if n else 0 for x, n in zip(sums, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int = 7) -> Column:
    """floor(1000 g) of a standard Gumbel draw g that the document's id and the seed fix; a null id counts as an empty string."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    draw = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(draw))).cast("long")


def ranked(rows: DataFrame, percent: int = 25, least_words: int = 20) -> DataFrame:
    """``rows`` (doc_id, n_words, weight, score) with rank: 1, 2, 3, ... in descending score among the drawn, null for all others.

    Scores are whole numbers whose range the bucket counts' logarithms bound, so the table of different scores is small at any size. A document's rank is
    the number of eligible documents of a higher score, summed over that table in two levels, and its place within its own score by doc_id; a
    shuffle by score serves both the join and the places.
    """
    able = F.col("n_words") >= least_words
    tall = rows.where(able).groupBy("score").agg(F.count("*").alias("_n")).withColumn("_band", F.floor(F.col("score") / 256))
    bands = tall.groupBy("_band").agg(F.sum("_n").alias("_in_band"))
    over = Window.orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("_band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    above = bands.withColumn("_over", F.coalesce(F.sum("_in_band").over(over), F.lit(0)))
    above = tall.join(above, "_band").select("score", (F.col("_over") + F.coalesce(F.sum("_n").over(inner), F.lit(0))).alias("_above"))
    drawn = percent * rows.where(able).count() // 100
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.desc(able), F.asc_nulls_last("doc_id"), "weight", "n_features"))
    rank = (F.col("_above") + place).cast("long")
    return rows.join(above, "score", "left").withColumn("rank", rank).withColumn("rank", F.when(able & (F.col("rank") <= drawn), F.col("rank"))).drop("_above")


def resample(docs: DataFrame, target: DataFrame, column: str = "text", longest: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document, drawn without replacement in proportion to its importance.

    A null or empty text has no features, weight 0, and can't be drawn, as no text under ``least_words`` words can; a very long text is scanned
    whole, and no list is made of it but of its words. Rows that share a doc_id are documents of their own with the same draw; ties go to
    the smaller doc_id, null ids last (their draw is that of an empty id), then the smaller weight. An empty table gives no rows, an empty
    target has no features (each bucket then gains by its scarcity alone). Other columns, whatever their names, are left out.
    """
    rows = stored(hashed(docs, column=column, longest=longest, buckets=buckets), "features")
    wanted = bucket_counts(hashed(target, None, column, longest, buckets), buckets)
    gains = bucket_gains(bucket_counts(rows, buckets), wanted)
    scored = weighted(rows, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = stored(scored, "scores")
    delete(docs.sparkSession, rows)
    return ranked(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")
